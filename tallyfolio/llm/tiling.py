"""Operator 7, benchmark decontamination by greedy string tiling.

Texts become lower-case tokens (runs of letters and digits).  Seeds are all runs of `min_match` tokens of the benchmark;
documents keep only the stretches covered by a seed, found through a bit table of fixed size, and are then joined with
the benchmark on the seeds they share.  For each document and item that share enough seeds, greedy string tiling marks
the longest match between unmarked tokens of both, again and again, with running Karp-Rabin hashes at falling lengths.
Coverage is the marked share of the item's tokens, so passages that were cut up and reordered still count.

Whole results: a tile of `min_match` tokens or more consists of seeds, so an item's tokens under shared seeds bound its
coverage from above, and pairs dropped before tiling can't reach the threshold.

Defined cases: null and empty texts match nothing; an item with fewer than `min_match` tokens has no seed and is never
reported; repeated rows are each tiled and reported as one pair; other columns are ignored by `leaks`; rows without an
id take part in `leaks` with a null id and are always kept by `clean`.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.common import ROW, Texts, batch_of, gram_hashes, numbered, pieces, range_hashes, stored

MIN_MATCH, THRESHOLD = 5, 0.5
#: Slots of the bit table that tells documents' seeds from others.
SLOTS = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[[i for i in range(256) if i >= 128 or chr(i).isalnum()]] = True


def token_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and the index of each text's first token."""
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.offsets] = True
    starts, ends, first = t._runs(~_LETTER[t.data], edge)
    return range_hashes(t.data, starts, ends) | np.uint64(1), first  # never 0, which parts stretches


def tile(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, length): longest first, none overlapping another in either."""
    a, b = text.tolist(), item.tolist()
    used_a, used_b = bytearray(len(a)), bytearray(len(b))
    tiles = []
    length = len(b)
    while length >= min_match:
        # windows of unmarked tokens by their hash
        at = defaultdict(list)
        for j, h in enumerate(gram_hashes(item, length).tolist()):
            if not any(used_b[j : j + length]):
                at[h].append(j)
        found, longest = defaultdict(list), 0
        if at:
            for i, h in enumerate(gram_hashes(text, length).tolist()):
                if h in at and not any(used_a[i : i + length]):
                    for j in at[h]:
                        n = length
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                            n += 1
                        found[n].append((i, j))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        marked = False
        for n in sorted(found, reverse=True):
            for i, j in found[n]:
                if not any(used_a[i : i + n]) and not any(used_b[j : j + n]):
                    used_a[i : i + n] = used_b[j : j + n] = b"\x01" * n
                    tiles.append((i, j, n))
                    marked = True
        if marked:  # matches that met a token marked meanwhile are looked for again
            continue
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return tiles


def _seed_table(items: DataFrame) -> np.ndarray:
    """True in the slot of every seed; as many entries for any benchmark."""
    slots = items.select(F.explode("seeds").alias("s")).select(F.pmod("s", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()
    table = np.zeros(SLOTS, bool)
    table[slots["slot"].to_numpy()] = True
    return table


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_signed(values)))


def item_tokens(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH) -> DataFrame:
    """(item_id, tokens, seeds): seeds in the order of their place; items without a seed are left out."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                h, first = token_hashes(texts)
                seeds = [gram_hashes(h[a:b], min_match) for a, b in zip(first[:-1], first[1:], strict=True)]
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in seeds])))
                yield batch_of(item_id=part.column(0), tokens=_lists(h, first), seeds=_lists(np.concatenate(seeds) if seeds else h[:0], bounds))

    return benchmark.select(id_col, text_col).mapInArrow(run, f"item_id {kind}, tokens array<bigint>, seeds array<bigint>").where("size(seeds) > 0")


def _covered(hit: np.ndarray, n: int) -> np.ndarray:
    """Tokens under windows of n tokens whose flag is set."""
    mark = np.zeros(len(hit) + n, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    return np.cumsum(mark)[:-1] > 0


def stretches(docs: DataFrame, table: np.ndarray, id_col: str, text_col: str, min_match: int = MIN_MATCH) -> DataFrame:
    """(doc, tokens, seeds) of documents with a seed: tokens under seeds, stretches parted by 0, and the distinct seeds."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches):
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                h, first = token_hashes(texts)
                grams = gram_hashes(h, min_match)
                hit = bits[grams % np.uint64(SLOTS)]
                text = np.repeat(np.arange(texts.n), np.diff(first))
                hit &= text[: len(grams)] == text[min_match - 1 :] if len(grams) else hit
                rows, tokens, seeds = [], [], []
                for d in np.unique(text[: len(grams)][hit]).tolist():
                    lo, hi = first[d], first[d + 1]
                    mine = hit[lo : hi - min_match + 1]
                    under = _covered(mine, min_match)
                    own = np.where(under, h[lo:hi], np.uint64(0))
                    own = own[under | np.concatenate(([False], under[:-1]))]  # one 0 after each stretch
                    rows.append(d)
                    tokens.append(own)
                    seeds.append(np.unique(grams[lo : hi - min_match + 1][mine]))
                if rows:
                    ends = [np.concatenate(([0], np.cumsum([len(x) for x in v]))) for v in (tokens, seeds)]
                    yield batch_of(doc=part.column(0).take(pa.array(rows)), tokens=_lists(np.concatenate(tokens), ends[0]), seeds=_lists(np.concatenate(seeds), ends[1]))

    return docs.select(id_col, text_col).mapInArrow(run, f"doc {kind}, tokens array<bigint>, seeds array<bigint>")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_id, coverage, n_tiles, longest): pairs whose coverage reaches the threshold."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = stored(item_tokens(benchmark, min_match=min_match).withColumn("item", F.monotonically_increasing_id()), "tiling-items")
    found = stored(stretches(docs, _seed_table(items), id_col, text_col, min_match).withColumn("row", F.monotonically_increasing_id()), "tiling-stretches")

    places = items.select("item", F.size("tokens").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    shared = found.select("row", F.explode("seeds").alias("seed")).join(places, "seed")
    # tokens of the item under shared seeds: neighbours at most min_match apart overlap
    at = F.array_sort(F.collect_set("at"))
    pairs = shared.groupBy("row", "item").agg(F.first("n").alias("n"), at.alias("under"))
    gaps = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("under") - 1), lambda i: F.least(F.lit(min_match), F.get("under", i) - F.get("under", i - 1))), F.lit(min_match), lambda x, y: x + y)
    bound = F.when(F.size("under") > 1, gaps).otherwise(F.lit(min_match))
    pairs = pairs.where(bound >= F.col("n") * threshold).select("row", "item")
    pairs = pairs.join(found.select("row", "doc", "tokens"), "row").join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item")

    def run(batches):
        for batch in batches:
            tiles = []
            for t, i in zip(batch.column(1), batch.column(3), strict=True):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (t, i))
                tiles.append([n for _, _, n in tile(a, b, min_match)] + [0, len(b)])
            yield batch_of(
                doc=batch.column(0), item_id=batch.column(2), coverage=np.array([sum(t[:-2]) / t[-1] for t in tiles]), n_tiles=np.array([len(t) - 2 for t in tiles], np.int32), longest=np.array([max(t[:-1]) for t in tiles], np.int32)
            )

    tiled = pairs.select("doc", "tokens", "item_id", "item_tokens").mapInArrow(run, f"doc {kind}, item_id {item_kind}, coverage double, n_tiles int, longest int")
    best = tiled.where(F.col("coverage") >= threshold).groupBy("doc", "item_id").agg(F.max(F.struct("coverage", "longest", "n_tiles")).alias("m"))
    return best.select(F.col("doc").alias(id_col), "item_id", "m.coverage", "m.n_tiles", "m.longest")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Pipeline stage: the rows of `docs` that hold no benchmark item, whatever their ids (rows are told apart by their place)."""
    rows = numbered(docs)
    gone = stored(leaks(rows, benchmark, ROW, text_col, **how).select(ROW).distinct(), "tiling-gone")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
