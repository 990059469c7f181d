"""Operator 11, periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that is at least max(`LEAST`, `TIMES` * q) words long and that no
neighbouring word extends.  The words of a text are appended one by one to a suffix automaton.  The states on the way from
the newest state to the root of the suffix-link tree are the suffixes of what has been read; each state has the place where
it was last seen to end, and appending a word gives all states on that way the new place.  Link-cut preferred paths keep
states of one place together, so an append meets few segments: a segment of place j whose longest suffix has l words, met
at place i, is a square of period d = i - j if l >= d.  The period can't be a multiple of a smaller one, for then the place
would be a later one.  The square's left end, i - d - l + 1, is the left end of its run, and the last place at which it is
met the right end.

Only stretches that can hold a run are read: each three consecutive words inside a run occur three times in it, so words
outside of such triples part a text (numpy over a block of texts; hashes decide only what is read).  The automaton and all
results use the words themselves.

Scale: one pass over rows, no shuffle; a text is the unit of work, at about 1 KB of memory for a word inside a stretch that
is read and 16 bytes for others.  Time is O(n log n) in the words read, however periodic.

Defined cases: null and empty texts have no words and no runs; a null id is passed on; repeated rows have one result each;
other columns are ignored; of equal ratios the run with the smallest start, then period, is first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.common import Texts, mixed, pieces, range_hashes

LEAST, TIMES = 6, 4
#: Triples of words inside a run occur at least this often in it (holds for LEAST >= 6 and TIMES >= 4).
TRIPLES = 3


class _Paths:
    """Suffix automaton of a growing list of words; its suffix-link tree as a link-cut tree.  State 0 is the root and, in
    the link-cut tree, nothing: no suffix of length zero is ever asked for."""

    def __init__(self, n: int):
        size = 2 * n + 2
        self.length, self.link = [0] * size, [0] * size
        self.to: list[dict] = [{}]
        self.left, self.right, self.up = [0] * size, [0] * size, [0] * size
        self.seen = [0] * size  # last place of a path's states, kept at the root of its splay tree
        self.newest = 0

    def append(self, word) -> int:
        """State of the text with `word` behind it; a clone joins the path of the state it is taken from."""
        to, link, length, up = self.to, self.link, self.length, self.up
        state = len(to)
        to.append({})
        length[state] = length[self.newest] + 1
        at = self.newest
        self.newest = state
        while word not in to[at]:
            to[at][word] = state
            if at == 0:
                return state  # a word never seen before: child of the root
            at = link[at]
        old = to[at][word]
        if length[at] + 1 == length[old]:
            link[state] = up[state] = old
            return state
        clone = len(to)
        to.append(dict(to[old]))
        length[clone] = length[at] + 1
        link[clone] = link[old]
        link[old] = link[state] = clone
        self._splay(old)
        above = self.left[old]
        self.left[clone] = above
        if above:
            up[above] = clone
        self.left[old] = clone
        up[clone] = old
        up[state] = clone
        while to[at].get(word) == old:
            to[at][word] = clone
            if at == 0:
                break
            at = link[at]
        return state

    def _splay(self, v: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            p = up[v]
            if not p:
                return
            on_left = left[p] == v
            if not on_left and right[p] != v:
                return
            g = up[p]
            g_left = g and left[g] == p
            if g and (g_left or right[g] == p):
                top = up[g]
                top_root = not (top and (left[top] == g or right[top] == g))
                if top_root:
                    self.seen[v] = self.seen[g]
                elif left[top] == g:
                    left[top] = v
                else:
                    right[top] = v
                up[v] = top
                if g_left and on_left:
                    a, b = right[v], right[p]
                    left[p], right[v], left[g], right[p] = a, p, b, g
                    up[p], up[g] = v, p
                    if a:
                        up[a] = p
                    if b:
                        up[b] = g
                elif not g_left and not on_left:
                    a, b = left[v], left[p]
                    right[p], left[v], right[g], left[p] = a, p, b, g
                    up[p], up[g] = v, p
                    if a:
                        up[a] = p
                    if b:
                        up[b] = g
                else:
                    a, b = left[v], right[v]
                    if g_left:  # p left of g, v right of p
                        right[p], left[v], left[g], right[v] = a, p, b, g
                        if a:
                            up[a] = p
                        if b:
                            up[b] = g
                    else:
                        right[g], left[v], left[p], right[v] = a, g, b, p
                        if a:
                            up[a] = g
                        if b:
                            up[b] = p
                    up[p] = up[g] = v
            else:
                self.seen[v] = self.seen[p]
                up[v] = g
                if on_left:
                    a = right[v]
                    left[p], right[v] = a, p
                else:
                    a = left[v]
                    right[p], left[v] = a, p
                up[p] = v
                if a:
                    up[a] = p
                return

    def access(self, state: int, place: int, found: dict) -> None:
        """Give all states above `state` the new place; squares met on the way go to `found`: (start, period) -> end."""
        right, up, seen, length = self.right, self.up, self.seen, self.length
        below, v = state, up[state]
        while v:
            self._splay(v)
            before = seen[v]
            period, most = place - before, length[v]
            if most >= (TIMES - 1) * period and most + period >= LEAST:
                found[before - most + 1, period] = place
            apart = right[v]
            if apart:
                seen[apart] = before
            right[v] = below
            below, v = v, up[v]
        seen[below] = place


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of hashable words, by start, then period."""
    paths, found = _Paths(len(words)), {}
    for place, word in enumerate(words):
        paths.access(paths.append(word), place, found)
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def stretches(h: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words (hash and text index of each) outside of which there is no run."""
    part = text.astype(np.uint64)
    at = np.arange(len(h))
    while len(at) >= LEAST:
        x, s = h[at], part[at]
        together = (s[2:] == s[:-2]) & (at[2:] - at[:-2] == 2)
        triple = mixed(mixed(mixed(x[:-2] + s[:-2] * np.uint64(0x9E3779B97F4A7C15)) + x[1:-1]) + x[2:])[together]
        if not len(triple):
            return []
        order = np.argsort(triple, kind="stable")
        edge = np.flatnonzero(np.append(True, triple[order][1:] != triple[order][:-1]))
        size = np.diff(np.append(edge, len(triple)))
        often = np.zeros(len(triple), bool)
        often[order] = np.repeat(size >= TRIPLES, size)
        first = np.flatnonzero(together)[often]
        cover = np.zeros(len(at), bool)
        for k in range(3):
            cover[first + k] = True
        kept = at[cover]
        if not len(kept):
            return []
        # a new part begins where words are missing or a text ends
        cut = np.flatnonzero(np.append(True, (np.diff(kept) > 1) | (part[kept][1:] != part[kept][:-1])))
        size = np.diff(np.append(cut, len(kept)))
        long = np.repeat(size >= LEAST, size)
        number = np.repeat(np.arange(len(cut)), size)[long]
        kept = kept[long]
        if len(kept) > 0.9 * len(at):
            cut = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(kept) else []
            ends = np.append(cut[1:], len(kept)) if len(kept) else []
            return [(int(kept[a]), int(kept[b - 1]) + 1) for a, b in zip(cut, ends, strict=True)]
        part = part.copy()
        part[kept] = number.astype(np.uint64)
        at = kept
    return []


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(id_col, n_words, runs: array of (start, length, period), collapsed: the text with each run cut to its first period).

    `order` may give, for an id and its number of words, the words (by number) that the text is read as."""
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(part, texts: Texts):
        starts, ends, first = texts.words()
        h = range_hashes(texts.data, starts, ends, lower=False)
        counts = np.diff(first)
        source = np.arange(len(h))
        if order is not None:
            for k, doc in enumerate(part.column(0).to_pylist()):
                chosen = order(doc, int(counts[k])) if counts[k] else None
                if chosen is not None:
                    source[first[k] : first[k + 1]] = first[k] + chosen
        raw = texts.data.tobytes()
        text = np.repeat(np.arange(texts.n), counts)
        runs: list[list] = [[] for _ in range(texts.n)]
        keep = np.ones(len(h), bool)
        for lo, hi in stretches(h[source], text):
            t = int(text[lo])
            words = [raw[starts[s] : ends[s]] for s in source[lo:hi].tolist()]
            for start, length, period in runs_of(words):
                runs[t].append({"start": lo - int(first[t]) + start, "length": length, "period": period})
                keep[lo + start + period : lo + start + length] = False
        s, e = starts[source].tolist(), ends[source].tolist()
        kept = keep.tolist()
        collapsed = [b" ".join([raw[s[i] : e[i]] for i in range(first[k], first[k + 1]) if kept[i]]) for k in range(texts.n)]
        columns = [part.column(0), pa.array(counts.astype(np.int64)), pa.array(runs, pa.list_(run_type)), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                yield one(part, texts)

    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def planted(doc, n: int) -> np.ndarray | None:
    """Word order of the check query: a tenth of all ids repeat a stretch of their words to the end of the text."""
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    if doc is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; null without runs."""

    def before(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        later = F.when(x["start"] != y["start"], x["start"] < y["start"]).otherwise(x["period"] < y["period"])
        return F.when(a != b, F.when(a > b, -1).otherwise(1)).when(later, -1).otherwise(1)

    return F.get(F.array_sort(runs, before), F.lit(0))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", F.when(F.size("runs") > 0, strongest(F.col("runs"))))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
