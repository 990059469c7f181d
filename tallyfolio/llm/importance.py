"""Operator 1, quality by importance resampling.

Two generative models over hashed n-grams: the target (documents labelled as good) and raw text (all documents).  A
document's log importance weight is the sum of the log ratios of its n-grams; adding Gumbel noise and keeping the top k
keys samples k documents without replacement in proportion to their weights.

N-grams are single tokens and pairs; a token is a run of letters and digits or a run of punctuation, as written.  A pair
of equal tokens is one common feature, so that endless repetition shows.  Counts cover every document; the model is
`buckets` pairs of counts, whatever the corpus.

The k-th key is found by counting keys in ever finer ranges (at most 4096 counts reach the driver in each round), so
nothing is sorted as a whole.

Defined cases: null and empty texts have no features and weight 0; without a labelled target, or with equal models, all
weights are 0 and only noise decides; keys tied with the k-th are all kept, so repeated rows share one fate; without
labels of both kinds k is the number of documents and all stay.  `keep` returns the rows with all their columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyfolio.llm.common import SPACE, Texts, batch_of, mixed, pieces, range_hashes, stored

BUCKETS = 1 << 10
#: Labelled documents of each half that the classifier is fitted on (the bound of that sample).
LABELS = 1 << 17
SEED = 17

_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def tokens_of(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes or punctuation bytes, and the index of each text's first token."""
    kind = np.where(SPACE[t.data], 0, np.where(_PUNCT[t.data], 2, 1)).astype(np.int8)
    edge = np.zeros(len(kind) + 1, bool)
    edge[t.offsets] = True
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    starts = np.flatnonzero(change[:-1] & (kind > 0))
    ends = np.flatnonzero(change[1:] & (kind > 0)) + 1
    return starts, ends, np.searchsorted(starts, t.offsets)


def features(t: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a batch, and the index of its text."""
    starts, ends, first = tokens_of(t)
    h = range_hashes(t.data, starts, ends, lower=False)
    text = np.repeat(np.arange(t.n), np.diff(first))
    same = text[1:] == text[:-1]
    a, b = h[:-1][same], h[1:][same]
    pair = np.where(a == b, np.uint64(1), mixed(a * np.uint64(3) + b))
    return np.concatenate((h, pair)) % np.uint64(buckets), np.concatenate((text, text[1:][same]))


def counts(docs: DataFrame, text_col: str, target: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, target, raw): n-gram counts of the rows whose column `target` is true, and of all rows."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                of, text = features(texts, buckets)
                good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                total[1] += np.bincount(of, minlength=buckets)
                total[0] += np.bincount(of[good[text]], minlength=buckets)
        used = np.flatnonzero(total[1])
        yield batch_of(bucket=used.astype(np.int32), target=total[0][used], raw=total[1][used])

    parts = docs.select(text_col, F.coalesce(F.col(target), F.lit(False)).alias("good")).mapInArrow(run, "bucket int, target long, raw long")
    return parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(model: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the two models in each bucket; the array has `buckets` entries for any corpus.

    The target model is an even mixture of its own shares and the raw ones, so that an n-gram the labelled documents
    happen not to have counts against a text only a little.
    """
    table = model.toPandas()
    both = np.zeros((2, buckets))
    both[:, table["bucket"].to_numpy()] = table[["target", "raw"]].to_numpy().T
    if not both[0].sum():
        return np.zeros(buckets)
    raw = (both[1] + 1) / (both[1].sum() + buckets)
    return np.log((both[0] / both[0].sum() + raw) / 2) - np.log(raw)


def gumbel(id_col: str, seed: int = SEED):
    """Standard Gumbel noise from a hash of the id: reruns and repeated rows agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.col(id_col).cast("string")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weighed(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """`docs` with `log_weight` and `key` (weight plus Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        table = shared.value
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                of, text = features(texts, len(table))
                weight = np.bincount(text, table[of], minlength=texts.n).astype(float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight)], names=[*part.schema.names, "log_weight"])

    rest = docs.drop("log_weight", "key")
    out = rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("log_weight", DoubleType())]))
    return out.withColumn("key", F.col("log_weight") + gumbel(id_col, seed))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of the only column: counts by range, then by range within the range that holds it."""
    (name,) = keys.columns
    x = F.col(name)
    low, high, n = keys.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n or k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    while low < high:
        at = F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)))
        ranges = keys.where(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for r in sorted(ranges, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def cut(scored: DataFrame, bins: int = 8192, reach: float = 512.0, clean: int = 4) -> float | None:
    """The log weight that parts good from bad labels best; losing a good document counts as `clean` mistakes.

    `scored` has (log_weight, good).  Only counts in `bins` ranges reach the driver.  None without both kinds of labels.
    """
    at = F.floor((F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col("log_weight"))) + reach) * (bins / (2 * reach)))
    by_bin = scored.groupBy(at.alias("bin"), "good").agg(F.count("*").alias("n")).collect()
    n = np.zeros((2, bins + 1), np.int64)
    for r in by_bin:
        n[int(r["good"]), int(r["bin"])] += r["n"]
    if not n[0].any() or not n[1].any():
        return None
    below = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(n, 1)), 1)
    wrong = clean * below[1] + n[0].sum() - below[0]
    best = np.flatnonzero(wrong == wrong.min())
    return (best[0] + best[-1]) / 2 * (2 * reach / bins) - reach


def good_labels(labels: DataFrame, half: int, id_col: str = "doc_id", most: int = LABELS) -> DataFrame:
    """(id_col, good): whether any label calls the document good.  One half fits the target, the other sets k.

    The classifier is fitted on a bounded sample: about `most` labelled documents of each half, by a hash of their ids.
    """
    own = labels.where((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half) & F.col("quality").isNotNull())
    share = min(1.0, most / max(1, own.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))
    return own.where(chosen).groupBy(F.col("doc_id").alias(id_col)).agg((F.max("quality") == 1).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratios of the two models: the raw one from all documents, the target from the good ones of half of the labels."""
    marked = docs.select(id_col, text_col).join(F.broadcast(good_labels(labels, 0, id_col)), id_col, "left")  # about LABELS rows
    return log_ratios(counts(marked, text_col, "good", buckets), buckets)


def threshold(keys: DataFrame, labels: DataFrame, id_col: str = "doc_id", k: int | None = None) -> float:
    """The k-th key of (id_col, log_weight, key).

    Without k, the other half of the labels sets it: k is the number of documents, of all, whose weight lies on the good
    side of `cut`.
    """
    if k is None:
        side = cut(keys.join(good_labels(labels, 1, id_col), id_col).select("log_weight", "good"))
        k = keys.count() if side is None else keys.where(F.col("log_weight") >= side).count()
    return kth_largest(keys.select("key"), k)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = SEED) -> DataFrame:
    """(id_col, log_weight, key, kept) of every document."""
    ratios = fit(docs, labels, id_col, text_col)
    keys = stored(weighed(docs.select(id_col, text_col), ratios, id_col, text_col, seed).drop(text_col), "importance-keys")
    return keys.withColumn("kept", F.col("key") >= F.lit(threshold(keys, labels, id_col, k)))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = SEED) -> DataFrame:
    """Pipeline stage: the rows of `docs` that the sample keeps, weighed anew rather than joined with their keys."""
    ratios = fit(docs, labels, id_col, text_col)
    keys = stored(weighed(docs.select(id_col, text_col), ratios, id_col, text_col, seed).drop(text_col), "importance-keys")
    least = threshold(keys, labels, id_col, k)
    original = [F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)]
    at_id, at_text = (f"_{docs.columns.index(c)}" for c in (id_col, text_col))
    kept = weighed(docs.select(*original), ratios, at_id, at_text, seed).where(F.col("key") >= F.lit(least))
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
