"""Shared helpers: reading documents, batches of text as numpy arrays, word hashes, components.

Texts travel to Python as Arrow columns.  Words are found and hashed with a few numpy operations over the bytes of
many documents at once, in blocks of bounded size, so memory does not depend on the number or length of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.session import shared_folder

#: Bytes of text that one numpy block covers.
BLOCK = 1 << 20

_MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and continue from the written table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def splitmix(x: int) -> int:
    """One step of the splitmix64 generator: a well-spread 64-bit value for each small integer."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer over an array (in place on a copy)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = splitmix(1001) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = splitmix(1002) | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@functools.cache
def byte_values(lower: bool) -> np.ndarray:
    values = np.array([splitmix(i) for i in range(256)], np.uint64)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least `size` of them."""
    return _powers(max(BLOCK, 1 << (size - 1).bit_length()))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte range.  Ranges are sorted and don't overlap; equal bytes have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    values = byte_values(lower)
    lo = 0
    while lo < len(starts):
        first = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        piece = data[first : ends[hi - 1]]
        power, inverse = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=total[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive items; shorter than n: nothing."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(_STEP)
        out += h[i : len(h) - n + 1 + i]
    return mixed(out)


class Texts:
    """Bytes of a batch of texts: `data`, and `offsets` with one more entry than texts.  Null is empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        _, offsets, data = column.buffers()
        self.n = len(column)
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
        self.offsets = at - at[0]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each run of non-space bytes, and the index of the first word of each text."""
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        return self._runs(SPACE[self.data], edge)

    def _runs(self, gap: np.ndarray, edge: np.ndarray):
        word = ~gap
        begin = word.copy()
        begin[1:] &= gap[:-1] | edge[1:-1]
        stop = word
        stop[:-1] &= gap[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 2 * BLOCK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut a batch into runs of rows with about `size` bytes of text (one longer text stays whole)."""
    i = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    lo = 0
    while lo < batch.num_rows:
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + size, "right")))
        part = batch.slice(lo, hi - lo)
        yield part, Texts(part.column(i))
        lo = hi


#: A row's place in its table.
ROW = "row place"


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with their place in the table: the same each time a written table is read."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    `edges` has two columns (a, b).  Returns (node, root): root is the smallest node that can be reached; nodes without
    an edge are absent.  Every step aggregates and joins on a node, and Spark splits a node with very many edges, so no
    component ever meets in one task.  Each round is written to the shared folder, which cuts the lineage.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, name)
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the smallest node near u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u and u itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
