"""Operator 3, repeated passages by sparse suffix arrays.

Of all suffixes of all texts only those are kept that start at a minimiser: of every `window` consecutive runs of `gram`
words, the run with the smallest hash.  The choice depends on content alone, so equal passages of gram + window - 1
words (50) keep at least one suffix in common.  Kept suffixes are sorted by what follows them, neighbours of different
documents are compared, and their match is extended right and left, a word at a time, until `least` words agree or not.
Suffixes of one gram are also sorted by so many words before them, for every number of words that a match may have there.

Scale: grams that occur once in the corpus can't match.  A first pass counts grams, and a bit table of fixed size (false
hits cost time, never results) keeps the others in the second pass.  Suffixes carry `window - 1` words to either side as
16-bit word hashes; longer passages are covered by the spans of several suffixes, which are merged.  The suffixes of a gram
meet in one task; those of a gram with more than `HOLD` get a row for each number of words to the left, and Spark sorts these
rows by range, with document and place, so even a passage in a third of all documents is spread over tasks.  Runs that touch
an edge of these partitions are compared across it at the end.

Words are runs of non-space bytes, lower-cased A-Z; grams are compared by 64-bit hashes.  Defined cases: null, empty and
texts under gram + window - 1 words have no suffix; repeats within one document alone are not reported; rows that repeat
an id are one document; rows without an id are left out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyfolio.llm.common import Texts, batch_of, gram_hashes, mixed, pieces, range_hashes, stored

GRAM, WINDOW, LEAST = 20, 31, 50
#: Suffixes of one gram that are compared in one task; grams with more are sorted in Spark.
HOLD = 50_000
#: Bits of the table of repeated grams, and bits that travel in one row of it.
TABLE_BITS, ROW_BITS = 1 << 26, 1 << 15


def minimisers(h: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and gram hash of the kept suffixes of a batch of texts (word hashes h, first word of each text)."""
    grams = gram_hashes(h, gram)
    if len(grams) < window:
        return np.empty(0, np.int64), grams[:0]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[: len(grams)] == text[gram - 1 :]
    # A run of equal grams (one word over and over) has no smallest one: every window-th place stands for its inside, and
    # all places for its first and last windows, so that runs of different lengths meet.
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1 : len(grams)] != text[: len(grams) - 1])
    at = np.arange(len(grams))
    run = at - np.maximum.accumulate(np.where(fresh, at, 0))
    final = np.append(fresh[1:], True)
    left = np.minimum.accumulate(np.where(final, at, len(grams))[::-1])[::-1] - at
    rank = np.where(run % window == 0, grams >> np.uint64(1), (grams >> np.uint64(1)) | np.uint64(1 << 63))
    views = np.lib.stride_tricks.sliding_window_view(rank, window)
    inside = text[: len(views)] == text[gram + window - 2 :][: len(views)]
    picked = np.empty(len(views), np.int64)
    for lo in range(0, len(views), 1 << 16):
        picked[lo : lo + (1 << 16)] = views[lo : lo + (1 << 16)].argmin(1)
    edge = np.flatnonzero((run + left > 0) & ((run < window) | (left < window)))
    places = np.unique(np.concatenate(((picked + np.arange(len(views)))[inside], edge)))
    places = places[whole[places]]
    return places, grams[places]


def _words(part, texts: Texts, gram: int, window: int):
    starts, ends, first = texts.words()
    h = range_hashes(texts.data, starts, ends)
    at, g = minimisers(h, first, gram, window)
    return h, first, at, g


def repeated_grams(docs: DataFrame, text_col: str, gram: int, window: int) -> np.ndarray:
    """Bit table (packed) with the slot of every gram that is kept twice or more."""

    def count(batches):
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                _, _, _, g = _words(part, texts, gram, window)
                g, n = np.unique(g, return_counts=True)
                yield batch_of(gram=g.view(np.int64), n=n.astype(np.int64))

    often = docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    slot = F.pmod("gram", F.lit(TABLE_BITS))
    slots = often.select(F.floor(slot / ROW_BITS).cast("int").alias("row"), F.pmod(slot, F.lit(ROW_BITS)).cast("int").alias("bit")).distinct()

    def pack(frame):
        import pandas as pd

        bits = np.zeros(ROW_BITS, bool)
        bits[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"row": [int(frame["row"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    table = np.zeros((TABLE_BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in slots.groupBy("row").applyInPandas(pack, "row int, bits binary").collect():
        table[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as a binary column, the bytes of 16-bit values in sorting order."""
    data = rows.astype(">u2").tobytes()
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * 2)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def suffixes(docs: DataFrame, table: np.ndarray, id_col: str, text_col: str, gram: int, window: int) -> DataFrame:
    """(gram, after, before, doc, at): kept suffixes whose gram may repeat, with the words around the gram."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    reach = np.arange(1, window)

    def run(batches):
        bits = shared.value
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                h, first, at, g = _words(part, texts, gram, window)
                slot = (g.view(np.int64) % TABLE_BITS).astype(np.int64)
                known = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                at, g = at[known], g[known]
                if not len(at):
                    continue
                short = (h >> np.uint64(48)).astype(np.uint16)
                short[short == 0] = 1
                text = np.searchsorted(first, at, "right") - 1
                after, before = at[:, None] + gram - 1 + reach, at[:, None] - reach
                right = np.where(after < first[text + 1][:, None], short[np.minimum(after, len(short) - 1)], 0)
                left = np.where(before >= first[text][:, None], short[np.maximum(before, 0)], 0)
                yield batch_of(gram=g.view(np.int64), after=_binary(right), before=_binary(left), doc=part.column(0).take(pa.array(text)), at=(at - first[text]).astype(np.int32))

    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(run, f"gram long, after binary, before binary, doc {kind}, at int")


class _Rows:
    """A run of sorted suffixes as arrays."""

    def __init__(self, gram, after, before, doc, at):
        self.gram, self.after, self.before, self.doc, self.at = gram, after, before, doc, at

    @classmethod
    def of(cls, batch: pa.RecordBatch, reach: int) -> _Rows:
        def matrix(column):
            return np.array([np.frombuffer(x, ">u2") for x in column.to_pylist()], np.uint16).reshape(-1, reach)

        doc = batch.column(3).to_numpy(zero_copy_only=False)
        return cls(batch.column(0).to_numpy(), matrix(batch.column(1)), matrix(batch.column(2)), doc, batch.column(4).to_numpy())

    def __len__(self):
        return len(self.gram)

    def __getitem__(self, which):
        return _Rows(self.gram[which], self.after[which], self.before[which], self.doc[which], self.at[which])

    def __add__(self, other: _Rows):
        return _Rows(*[np.concatenate((getattr(self, n), getattr(other, n))) for n in ("gram", "after", "before", "doc", "at")])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(1)


def matched(rows: _Rows, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after each suffix's start that it shares with suffixes of other documents; 0 after: no match.

    Rows come in suffix order.  For each number of words to the left, suffixes that agree on so many are compared with
    their neighbours in that order: of all that share these words, a neighbour shares most to the right.  So if any other
    document shares `least` words around a suffix, with any part of them to its left, a neighbour does too.
    """
    n = len(rows)
    back, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left_key = rows.gram.view(np.uint64).copy()
    alive = np.arange(n)
    for depth in range(rows.before.shape[1] + 1):
        if depth:
            left_key[alive] = mixed(left_key[alive] * np.uint64(0x9E3779B97F4A7C15) + rows.before[alive, depth - 1])
        order = alive[np.argsort(left_key[alive], kind="stable")]
        key = left_key[order]
        twin = np.zeros(len(order), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        order, key = order[twin], key[twin]
        alive = np.sort(order)  # what agrees with no other agrees with none on more words either
        if not len(order):
            break
        doc, i = rows.doc[order], np.arange(len(order))
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, i, 0))
        last = np.ones(len(order), bool)
        last[:-1] = new[1:]
        end = np.minimum.accumulate(np.where(last, i, len(order))[::-1])[::-1]
        for other in (start - 1, end + 1):
            ok = np.flatnonzero((other >= 0) & (other < len(order)))
            ok = ok[key[other[ok]] == key[ok]]
            a, b = order[ok], order[other[ok]]
            left, right = _agree(rows.before[a], rows.before[b]), gram + _agree(rows.after[a], rows.after[b])
            hit = left + right >= least
            np.maximum.at(back, a[hit], left[hit])
            np.maximum.at(ahead, a[hit], right[hit])
    return back, ahead


def _doc_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64()


def _whole(rows: DataFrame, kind: str, gram: int, window: int, least: int, hold: int) -> DataFrame:
    """Spans (doc, start, end) of suffixes whose grams have `hold` suffixes at most, each gram in one partition, in suffix order."""

    def spans(rows: _Rows):
        back, ahead = matched(rows, gram, least)
        at = np.flatnonzero(ahead)
        return batch_of(doc=pa.array(rows.doc[at]).cast(_doc_type(kind)), start=(rows.at[at] - back[at]).astype(np.int32), end=(rows.at[at] + ahead[at]).astype(np.int32))

    def run(batches):
        rows = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _Rows.of(batch, window - 1)
            rows = new if rows is None else rows + new
            other = np.flatnonzero(rows.gram != rows.gram[-1])
            if len(rows) >= hold and len(other):  # the last gram waits for the rest of its suffixes
                cut = int(other[-1]) + 1
                yield spans(rows[np.arange(cut)])
                rows = rows[np.arange(cut, len(rows))]
        if rows is not None:
            yield spans(rows)

    return rows.mapInArrow(run, f"doc {kind}, start int, end int")


def _by_left(rows: DataFrame, kind: str, window: int) -> DataFrame:
    """A row for each suffix and number of words to its left; `gram` becomes a hash of the gram and these words."""

    def run(batches):
        for batch in batches:
            some = _Rows.of(batch, window - 1)
            key, alive = some.gram.view(np.uint64).copy(), np.arange(len(some))
            for depth in range(window):
                if depth:
                    alive = alive[some.before[alive, depth - 1] != 0]
                    key[alive] = mixed(key[alive] * np.uint64(0x9E3779B97F4A7C15) + some.before[alive, depth - 1])
                which = pa.array(alive)
                if len(alive):
                    yield pa.RecordBatch.from_arrays([pa.array(key[alive].view(np.int64)), *(batch.column(i).take(which) for i in range(1, 5))], names=["gram", "after", "before", "doc", "at"])

    return rows.mapInArrow(run, f"gram long, after binary, before binary, doc {kind}, at int")


#: Rows of `_neighbours`: a span; what the driver reads of a partition; members of its first and last run, whose neighbours may be elsewhere.
SPAN, FIRST, SECOND, LAST_BUT_ONE, LAST, IN_FIRST, IN_LAST = range(7)


def _neighbours(rows: DataFrame, kind: str, gram: int, window: int, least: int, hold: int) -> DataFrame:
    """Spans of sorted suffixes compared with the nearest of other documents with the same key, and the edges of partitions.

    A run is a stretch of one key and document.  Its suffixes are compared with the row before it and the row after it.
    """

    def out(side: int, rows: _Rows, at: np.ndarray, start=None, end=None):
        one, n = rows[at], len(at)
        none = pa.nulls(n, pa.int32())
        return batch_of(
            part=np.full(n, TaskContext.get().partitionId(), np.int32), side=np.full(n, side, np.int32), gram=one.gram, after=_binary(one.after), before=_binary(one.before),
            doc=pa.array(one.doc).cast(_doc_type(kind)), at=one.at.astype(np.int32), start=none if start is None else start.astype(np.int32), end=none if end is None else end.astype(np.int32),
        )

    def compared(rows: _Rows, start: np.ndarray, end: np.ndarray, lo: int, hi: int):
        for other in (start - 1, end + 1):
            i = np.arange(lo, hi)
            i = i[(other[lo:hi] >= 0) & (other[lo:hi] < len(rows))]
            i = i[rows.gram[i] == rows.gram[other[i]]]
            left, right = _agree(rows.before[i], rows.before[other[i]]), gram + _agree(rows.after[i], rows.after[other[i]])
            hit = left + right >= least
            i, left, right = i[hit], left[hit], right[hit]
            yield out(SPAN, rows, i, rows.at[i] - left, rows.at[i] + right)

    def run(batches):
        rows, done, first = None, 0, True  # the first `done` rows (0 or 1) are there for comparison only

        def step(last: bool):
            n = len(rows)
            new = np.ones(n, bool)
            new[1:] = (rows.gram[1:] != rows.gram[:-1]) | (rows.doc[1:] != rows.doc[:-1])
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            start, end = starts[run_of], np.append(starts[1:], n)[run_of] - 1
            hi = n if last else int(starts[-1])
            if first:
                yield out(FIRST, rows, np.array([0]))
                yield out(SECOND, rows, starts[1:2])
                yield out(IN_FIRST, rows, np.arange(end[0] + 1))
            if last:
                yield out(LAST_BUT_ONE, rows, starts[-1:] - 1 if starts[-1] else starts[:0])
                yield out(LAST, rows, np.array([n - 1]))
                yield out(IN_LAST, rows, np.arange(starts[-1], n))
            yield from compared(rows, start, end, done, hi)

        for batch in batches:
            if not batch.num_rows:
                continue
            more = _Rows.of(batch, window - 1)
            rows = more if rows is None else rows + more
            if len(rows) >= hold:
                cut = np.flatnonzero((rows.gram != rows.gram[-1]) | (rows.doc != rows.doc[-1]))
                if len(cut) and cut[-1] + 1 > done:
                    yield from step(False)
                    rows, done, first = rows[np.arange(cut[-1], len(rows))], 1, False
        if rows is not None:
            yield from step(True)

    return rows.mapInArrow(run, f"part int, side int, gram long, after binary, before binary, doc {kind}, at int, start int, end int")


def _over_borders(edges: list) -> dict:
    """For the first (IN_FIRST) and last (IN_LAST) run of each partition, the row before or after it that lies in another partition."""
    parts = sorted({r["part"] for r in edges})
    of = {(r["part"], r["side"]): r for r in edges}
    found = {}
    for side, own, near, far, order in ((IN_LAST, LAST, FIRST, SECOND, parts), (IN_FIRST, FIRST, LAST, LAST_BUT_ONE, parts[::-1])):
        for i, part in enumerate(order):
            mine = of[part, own]
            for other in order[i + 1 :]:
                row = of[other, near]
                if row["gram"] == mine["gram"] and row["doc"] == mine["doc"]:  # the run goes on; what follows it there, if anything does
                    row = of.get((other, far))
                    if row is None:
                        continue
                if row["gram"] == mine["gram"]:
                    found[part, side] = row
                break
    return found


def _spread(rows: DataFrame, kind: str, gram: int, window: int, least: int, hold: int) -> DataFrame:
    """Spans (doc, start, end) of suffixes of grams of any size: every number of words to the left is sorted for itself in Spark."""
    order = ["gram", "after", "doc", "at"]
    keyed = _by_left(rows, kind, window).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(_neighbours(keyed, kind, gram, window, least, hold), "suffix-spans")
    over = _over_borders(found.where(F.col("side").between(FIRST, LAST)).collect())  # four rows a partition
    partners = {k: (np.frombuffer(r["before"], ">u2")[None], np.frombuffer(r["after"], ">u2")[None]) for k, r in over.items()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            part, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            some = _Rows.of(batch.select(["gram", "after", "before", "doc", "at"]), window - 1)
            for p, s in set(zip(part.tolist(), side.tolist(), strict=True)):
                if (p, s) not in partners:
                    continue
                before, after = partners[p, s]
                i = np.flatnonzero((part == p) & (side == s))
                left, right = _agree(some.before[i], before), gram + _agree(some.after[i], after)
                hit = left + right >= least
                i, left, right = i[hit], left[hit], right[hit]
                yield batch_of(doc=pa.array(some.doc[i]).cast(_doc_type(kind)), start=(some.at[i] - left).astype(np.int32), end=(some.at[i] + right).astype(np.int32))

    met = found.where(F.col("side") >= IN_FIRST).mapInArrow(run, f"doc {kind}, start int, end int")
    return found.where(F.col("side") == SPAN).select("doc", "start", "end").union(met)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, least: int = LEAST, hold: int = HOLD) -> DataFrame:
    """(id_col, start_word, end_word): merged stretches of each document that are parts of repeats of `least` words."""
    kind = docs.schema[id_col].dataType.simpleString()
    key = id_col
    if kind not in ("bigint", "int", "smallint", "tinyint", "string"):
        raise TypeError(f"{id_col} must be a whole number or a string")
    table = repeated_grams(docs, text_col, gram, window)
    kept = stored(suffixes(docs, table, id_col, text_col, gram, window), "suffixes")
    large = stored(kept.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hold).select("gram"), "suffix-common")
    common = large.limit(1).count() > 0
    order = ["gram", "after", "before", "doc", "at"]
    rest = kept.join(large, "gram", "left_anti").select(*order) if common else kept
    spans = _whole(rest.repartition("gram").sortWithinPartitions(*order), kind, gram, window, least, hold)
    if common:
        spans = spans.union(_spread(kept.join(large, "gram", "left_semi").select(*order), kind, gram, window, least, hold))
    spans = stored(spans, "suffix-spans")
    by = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).select(F.col("doc").alias(key), "start_word", "end_word")
