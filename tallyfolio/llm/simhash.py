"""Operator 8, SimHash near-duplicates by multi-index hashing.

A document's 64-bit fingerprint has a bit set where more than half of its shingle hashes have it set.  Fingerprints that
differ in at most `radius` bits are linked, and documents of one connected component are near-duplicates.

Search: fingerprints are cut into `segments` pieces.  Two fingerprints within `radius` bits differ in at most
radius // segments bits in some piece (pigeonhole), so each distinct fingerprint looks up, in the table of every piece,
all values in that small Hamming ball; the hits are verified over all 64 bits.

Large groups: identical fingerprints are one row before anything is joined.  Different fingerprints that sit in one
crowded bucket are verified in blocks of bounded size, and each block pair returns only a spanning forest of its links,
which joins the same components as all links.  Nothing is capped.

Defined cases: null text is empty; a text without words has fingerprint zero and is linked like any other; one with
fewer words than a shingle is hashed whole; null ids keep their fingerprint and have a null component; repeated rows
are all returned.  Other columns of the table are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.common import ROW, batch_of, components, numbered, stored

SHINGLE, RADIUS, SEGMENTS, SEED = 4, 4, 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    s, e = starts[:n].tolist(), ends[k - 1 :].tolist()
    for lo in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(s[lo : lo + (1 << 16)], e[lo : lo + (1 << 16)], strict=True)], ">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(total * 2 > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp): signed 64-bit fingerprint of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _cuts(segments: int) -> list[tuple[int, int]]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _balls(segments: int, radius: int) -> list[tuple[int, int, list[int]]]:
    """For each piece: shift, mask, and the flips of its Hamming ball."""
    out = []
    for lo, hi in _cuts(segments):
        flips = [sum(1 << i for i in c) for r in range(radius // segments + 1) for c in combinations(range(hi - lo), r)]
        out.append((lo, (1 << (hi - lo)) - 1, flips))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowd: int = 64) -> DataFrame:
    """Links (a, b) between different fingerprints `fp` that join all fingerprints within `radius` bits.

    Buckets with at most `crowd` fingerprints are joined directly.  The others are dealt out in blocks (see `_crowded`).
    """
    balls = _balls(segments, radius)
    piece = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask)) for lo, mask, _ in balls]
    rows = F.array(*[F.struct(F.lit(s).alias("seg"), p.alias("key")) for s, p in enumerate(piece)])
    table = stored(distinct.select("fp", F.explode(rows).alias("r")).select("fp", "r.seg", "r.key"), "simhash-table")
    sizes = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > crowd).select("seg", "key", "n")
    # Links within one bucket of exactly equal piece values, for crowded buckets
    inside = _crowded(table, big, radius)
    # Ball probes: every fingerprint, every piece, every value near its own
    def ball(seg, own, flips):
        values = F.array(*[F.lit(f).cast("long") for f in flips])
        return F.transform(values, lambda f: F.struct(F.lit(seg).alias("seg"), own.bitwiseXOR(f).alias("key"), (f == 0).alias("own")))

    near = F.concat(*[ball(seg, own, flips) for seg, (own, (_, _, flips)) in enumerate(zip(piece, balls, strict=True))])
    # Spark sizes exploded rows as if they were few and would broadcast them; merged, neither side has to fit in memory
    probe = distinct.select(F.col("fp").alias("a"), F.explode(near).alias("r")).select("a", "r.seg", "r.key", "r.own").hint("merge")
    small = table.join(big.select("seg", "key"), ["seg", "key"], "left_anti").withColumnRenamed("fp", "b")
    direct = probe.join(small, ["seg", "key"]).where("a < b")
    direct = direct.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    # Probes that fall into a crowded bucket from outside it
    strays = probe.where(~F.col("own")).join(big, ["seg", "key"]).hint("merge")
    outside = _strays(strays, table, big, radius)
    return direct.union(inside).union(outside).distinct()


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of `fps` reduced to a spanning forest."""
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(n)
    return a[keep], b[keep]


def _within(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x and y within `radius` bits, a strip at a time."""
    out = []
    for lo in range(0, len(x), 256):
        near = np.bitwise_count(x[lo : lo + 256, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(near)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        if len(i) > len(x) + len(y):  # keep the number of pairs in memory small
            i, k = _forest(np.concatenate((x, y)), i, j + (0 if same else len(x)))
            j = k - (0 if same else len(x))
        out.append((i, j))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _blocks_of(n, size: int):
    return F.ceil(n / F.lit(size)).cast("int")


def _crowded(table: DataFrame, big: DataFrame, radius: int, size: int = 512) -> DataFrame:
    """Links inside crowded buckets: members are hashed into blocks, and every pair of blocks is one group."""
    members = table.join(big, ["seg", "key"])
    n = _blocks_of(F.col("n"), size)
    members = members.select("seg", "key", "fp", n.alias("nb"), F.pmod(F.xxhash64("fp"), n).cast("int").alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    members = members.select("seg", "key", "fp", "mine", other)
    members = members.select("seg", "key", "fp", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def run(frame):
        x = frame["fp"].to_numpy().view(np.uint64)
        lo = frame["mine"].to_numpy() == frame["lo"].iloc[0]
        same = frame["lo"].iloc[0] == frame["hi"].iloc[0]
        left, right = (x, x) if same else (x[lo], x[~lo])
        i, j = _within(left, right, radius, same)
        both = left if same else np.concatenate((left, right))
        i, j = _forest(both, i, j if same else j + len(left))
        import pandas as pd

        return pd.DataFrame({"a": both[i].view(np.int64), "b": both[j].view(np.int64)})

    return members.groupBy("seg", "key", "lo", "hi").applyInPandas(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _strays(strays: DataFrame, table: DataFrame, big: DataFrame, radius: int, size: int = 512) -> DataFrame:
    """Links from fingerprints next to a crowded bucket to its members: one group for each block of members and probes."""
    members = table.join(big, ["seg", "key"])
    probes = strays.groupBy("seg", "key").agg(F.count("*").alias("p"))
    shape = probes.join(big, ["seg", "key"]).select("seg", "key", _blocks_of(F.col("n"), size).alias("nb"), _blocks_of(F.col("p"), size).alias("pb"))
    m = members.drop("n").join(shape, ["seg", "key"]).select("seg", "key", "fp", F.lit(True).alias("member"), F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("qb"))
    q = strays.drop("n").join(shape, ["seg", "key"]).select("seg", "key", F.col("a").alias("fp"), F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("mb"), F.pmod(F.xxhash64("a"), F.col("pb")).cast("int").alias("qb"))

    def run(frame):
        import pandas as pd

        x, of = frame["fp"].to_numpy().view(np.uint64), frame["member"].to_numpy()
        left, right = x[of], x[~of]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        i, j = _within(left, right, radius, False)
        both = np.concatenate((left, right))
        i, j = _forest(both, i, j + len(left))
        return pd.DataFrame({"a": both[i].view(np.int64), "b": both[j].view(np.int64)})

    return m.union(q).groupBy("seg", "key", "mb", "qb").applyInPandas(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One row per document: (id_col, fp, component), component being the smallest id that can be reached."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-distinct")
    edges = links(distinct.select("fp"), radius, segments)
    roots = components(edges, "simhash-components")
    # a component's name is its smallest document id, not its smallest fingerprint
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = labelled.groupBy("root").agg(F.min("first").alias("component"))
    classes = labelled.join(names, "root").select("fp", "component")
    return prints.join(classes, "fp").select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Pipeline stage: of each group of near-duplicate rows one stays, the one with the smallest id (null ids last), then the
    first in the table.  Rows are told apart by their place, so rows that share an id, or have none, are rows like others.

    What goes is written first, so Spark knows its size and shuffles the texts only if it is too large to be broadcast.
    """
    rows = numbered(docs)
    found = near_duplicates(rows, ROW, text_col, **how).select(ROW, "component")
    found = found.join(rows.select(ROW, F.col(id_col).alias("own")), ROW)
    first = F.min(F.struct(F.col("own").isNull().alias("nameless"), F.col("own"), F.col(ROW))).alias("first")
    kept = found.groupBy("component").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    gone = stored(found.select(ROW).join(kept, ROW, "left_anti"), "simhash-gone")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
