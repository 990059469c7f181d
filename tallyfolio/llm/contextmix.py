"""Operator 6, language-model scoring by online logistic context mixing.

A text's lower-cased UTF-8 bytes and one end byte are coded bit by bit.  For each bit, predictors with the last 1, 2, 3
and 4 bytes and with the current word so far as context (hashed with the bits of the current byte so far) give a
probability from their counts.  A gate, chosen by how much the contexts have seen, selects a set of weights that mixes the
predictions in the logistic domain, and an adaptive map refines the mixture.  The sum of log10 probabilities is the
text's score.

Training covers every training document: tokens and windows of five bytes are counted over the corpus (each task adds up
its own first), and the counters of all contexts follow from them, summed by slot in Spark.
Mixing weights are learnt online in every partition, over all training documents, and averaged, each bit predicted
without its own last occurrence, and so is the map.  A partition learns a place (its window and word so far) with the
number of times it was met, once or a few times, whatever that number is.  The model's slots follow the number of contexts
up to `MOST_SLOTS` for each kind, which the driver's memory sets; beyond it contexts share slots and none is left out.
Tokens, windows and their counts stay in Spark and grow with the corpus.

The base score (add-one unigrams of words) looks up counts of the most frequent tokens in a broadcast table of
`head` rows, and all others by a join on the token's hash, which no frequent token takes part in.

Defined cases: null and empty texts have one token, the end; a null id belongs to the training part; repeated rows are
scored and counted each; without training documents all counts are 0 and the model predicts every bit with one half;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.common import BLOCK, SPACE, Texts, batch_of, byte_values, mixed, pieces, powers, range_hashes, splitmix, stored

FOLDS, HELD = 7, 2
HEAD = 1 << 17
#: Slots of each context's counters (1 to 4 bytes, then the word so far): at least, at most, and per row on their way to the driver.
SLOTS = (1 << 16, 1 << 18, 1 << 20, 1 << 20, 1 << 21)
MOST_SLOTS = 1 << 22
PACK = 4096
ORDERS, CONTEXTS = 4, len(SLOTS)
#: What stands before a text and after it; neither byte occurs in UTF-8.
BEFORE, END = 0xFE, 0xFF
END_TOKEN = np.uint64(splitmix(7777))
ALPHA, LEVELS, START = 0.4, 33, 200.0
#: What the longer contexts must have seen for each level of the gate.
STEPS = {2: (1, 8, 64), 3: (1, 4, 32, 256), 4: (1, 3, 12, 60, 500)}
GATES = 5 * 4 * 5 * 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = SPACE.copy()
_APART[BEFORE] = True


def windows(t: Texts, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The five bytes that end at each byte of each text and at its end, as one number; and the index of its text.

    `before`: the four bytes that stand before each text, a row for each.
    """
    n = np.diff(t.offsets)
    first = np.concatenate(([0], np.cumsum(n + ORDERS + 1)))
    data = np.full(int(first[-1]), BEFORE, np.uint8)
    text = np.repeat(np.arange(t.n), n)
    data[np.arange(len(t.data)) + ORDERS * (text + 1) + text] = _LOWER[t.data]
    data[first[1:] - 1] = END
    if before is not None:
        data[first[:-1, None] + np.arange(ORDERS)] = before
    wide = data.astype(np.uint64)
    out = wide[ORDERS:].copy()
    for i in range(1, ORDERS + 1):
        out |= wide[ORDERS - i : len(wide) - i] << np.uint64(8 * i)
    at = np.ones(len(wide), bool)
    for i in range(ORDERS):
        at[first[:-1] + i] = False
    return out[at[ORDERS:]], np.repeat(np.arange(t.n), n + 1)


def prefixes(t: Texts) -> np.ndarray:
    """For each place of `windows`: hash of the current word's bytes before it (after a space: of no bytes)."""
    n = np.diff(t.offsets)
    text = np.repeat(np.arange(t.n), n + 1)
    at = np.arange(len(text)) - text  # the byte at this place; for a text's end, the one after it
    begin = np.zeros(len(t.data) + 1, np.int64)
    begin[1:] = np.maximum.accumulate(np.where(SPACE[t.data], np.arange(1, len(t.data) + 1), 0))
    begin = np.maximum(begin[at], t.offsets[:-1][text])
    out = np.empty(len(at), np.uint64)
    values = byte_values(True)
    for lo in range(0, len(at), BLOCK):
        j, b = at[lo : lo + BLOCK], begin[lo : lo + BLOCK]
        piece = t.data[b[0] : j[-1]]
        power, inverse = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=total[1:])
        j, b = j - b[0], b - b[0]
        out[lo : lo + BLOCK] = mixed((total[j] - total[b]) * inverse[b] + (j - b).astype(np.uint64))
    return out


class Stretches:
    """Stretches of texts, which together have every place once.

    A text is cut before each of its words.  A piece's first four places are one stretch, which follows from its bytes, the four
    bytes before it, and whether the text ends with it; its other places are another, which follows from the piece alone.
    `keys` hash what the windows and word prefixes of a stretch follow from.
    """

    def __init__(self, t: Texts):
        begins, _, first = t.words()
        text = np.repeat(np.arange(t.n), np.diff(first))
        inner = begins > t.offsets[text]
        n = 1 + np.bincount(text[inner], minlength=t.n)
        at = np.cumsum(n) - n
        text, starts, last = np.repeat(np.arange(t.n), n), np.empty(n.sum(), np.int64), np.zeros(n.sum(), bool)
        later = np.ones(len(text), bool)
        later[at] = False
        starts[at], starts[later] = t.offsets[:-1], begins[inner]
        last[at + n - 1] = True
        ends = np.append(starts[1:], t.offsets[-1])
        rest = np.flatnonzero(ends - starts + last > ORDERS)
        low = np.concatenate((np.full(ORDERS, BEFORE, np.uint8), _LOWER[t.data], np.full(ORDERS, BEFORE, np.uint8)))
        four = np.ndarray(len(t.data) + ORDERS + 1, "<u4", low, 0, (1,))  # the four bytes from each byte on
        before, head = four[starts], four[starts + ORDERS]
        for mine, bytes_there, shift in ((before, starts - t.offsets[text], -1), (head, ends - starts, 1)):
            few = np.flatnonzero(bytes_there < ORDERS)  # beyond a text's start or a piece's end
            bits = (8 * (ORDERS - bytes_there[few])).astype(np.uint32)
            full, fill = np.uint32(0xFFFFFFFF), np.uint32(BEFORE * 0x01010101)
            keep = full >> bits if shift > 0 else full << bits
            keep[bits == 32] = 0
            mine[few] = mine[few] & keep | fill & ~keep
        self.data, self.heads = t.data, len(text)
        self.text = np.concatenate((text, text[rest]))
        self.starts = np.concatenate((starts, starts[rest]))
        self.ends = np.concatenate((np.minimum(ends, starts + ORDERS), ends[rest]))
        self.last = np.concatenate((last & (ends - starts < ORDERS), last[rest]))
        self.before = np.concatenate((before, np.full(len(rest), BEFORE * 0x01010101, np.uint32))).astype("<u4")
        first = mixed((before.astype(np.uint64) << np.uint64(32) | head) ^ np.uint64(splitmix(31))) + self.last[: len(text)]
        other = range_hashes(t.data, starts[rest], ends[rest]) + (np.uint64(2) + last[rest])
        self.keys = mixed(np.concatenate((first, other)))

    def some(self, at: np.ndarray) -> Bytes:
        starts, n = self.starts[at], self.ends[at] - self.starts[at]
        offsets = np.concatenate(([0], np.cumsum(n)))
        data = self.data[np.repeat(starts - offsets[:-1], n) + np.arange(offsets[-1])]
        return Bytes(data, offsets, self.before[at, None].view(np.uint8), self.last[at], at >= self.heads)


class Bytes:
    """The bytes of some stretches."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, before: np.ndarray, last: np.ndarray, rest: np.ndarray):
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(last), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        self.texts, self.before, self.last, self.rest = Texts(column), before, last, rest

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, word prefix and index of the stretch of each place."""
        w, of = windows(self.texts, self.before)
        at = self.texts.offsets + np.arange(len(self.last) + 1)
        real = np.ones(len(w), bool)
        real[at[1:] - 1] = self.last  # only a text's end has a place of its own
        real[at[:-1][self.rest, None] + np.arange(ORDERS)] = False
        return w[real], prefixes(self.texts)[real], of[real]


class Met:
    """Distinct stretches and how often a task has met them.

    The first stretch of each slot of a table is counted there with its bytes, others and long ones are passed on; `size` and
    `long` bound what is held.
    """

    def __init__(self, size: int = 1 << 20, long: int = 32):
        self.mask, self.long = np.uint64(size - 1), long
        self.keys, self.counts, self.taker = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.held: list[tuple[np.ndarray, Bytes]] = []

    def add(self, t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yields the places (w, p, n) of stretches that are not held."""
        found = Stretches(t)
        key = found.keys | np.uint64(1 << 63)
        slot = (key & self.mask).astype(np.int64)
        here = self.keys[slot]
        new = np.flatnonzero(here == 0)
        new = new[found.ends[new] - found.starts[new] <= self.long]
        if len(new):
            self.taker[slot[new]] = new
            new = new[self.taker[slot[new]] == new]  # one for each slot
            self.keys[slot[new]] = key[new]
            self.held.append((slot[new], found.some(new)))
            here = self.keys[slot]
        held = here == key
        np.add.at(self.counts, slot[held], 1)
        other = np.flatnonzero(~held)
        if len(other):
            _, first, n = np.unique(key[other], return_index=True, return_counts=True)
            w, p, at = found.some(other[first]).places()
            yield w, p, n[at]

    def last(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The places of all that are held."""
        for slot, some in self.held:
            w, p, at = some.places()
            yield w, p, self.counts[slot][at]
        self.held = []


class Tally:
    """Counts of numbers seen by one task; merged as they come in, flushed by the caller when large."""

    def __init__(self):
        self.keys, self.counts, self.tokens = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, object)

    def add(self, keys: np.ndarray, token=None) -> None:
        """`token`: gives the bytes of the key at an index."""
        keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
        merged, first_at, at = np.unique(np.concatenate((self.keys, keys)), return_index=True, return_inverse=True)
        self.counts = np.bincount(at, np.concatenate((self.counts, counts)), len(merged)).astype(np.int64)
        if token is not None:
            old = first_at < len(self.keys)
            tokens = np.empty(len(merged), object)
            tokens[old] = self.tokens[first_at[old]]
            tokens[~old] = [token(i) for i in first[first_at[~old] - len(self.keys)].tolist()]
            self.tokens = tokens
        self.keys = merged

    def flush(self, kind: int) -> pa.RecordBatch:
        tokens = pa.array(self.tokens, pa.binary()) if len(self.tokens) else pa.nulls(len(self.keys), pa.binary())
        out = batch_of(kind=np.full(len(self.keys), kind, np.int32), key=self.keys.view(np.int64), token=tokens, n=self.counts)
        self.__init__()
        return out


class Seats:
    """A tally with a table of fixed size in front: the first number of each slot is counted there, others in `rest`."""

    def __init__(self, size: int = 1 << 20):
        self.mask, self.rest = np.uint64(size - 1), Tally()
        self.keys, self.counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)

    def add(self, keys: np.ndarray) -> None:
        slot = (mixed(keys) & self.mask).astype(np.int64)
        new = self.keys[slot] == 0
        self.keys[slot[new]] = keys[new]
        seated = self.keys[slot] == keys
        self.counts += np.bincount(slot[seated], minlength=len(self.counts))
        if not seated.all():
            self.rest.add(keys[~seated])

    def flush(self, kind: int) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.counts)
        seated = Tally()
        seated.keys, seated.counts = self.keys[at], self.counts[at]
        yield seated.flush(kind)
        yield self.rest.flush(kind)


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word and of the end of each text, the index of its text, and the words' first and last bytes."""
    starts, ends, first = t.words()
    h = np.concatenate((range_hashes(t.data, starts, ends), np.full(t.n, END_TOKEN)))
    return h, np.concatenate((np.repeat(np.arange(t.n), np.diff(first)), np.arange(t.n))), starts, ends


def counted(docs: DataFrame, text_col: str, most: int = 1 << 20) -> DataFrame:
    """(kind, key, token, n): counts of tokens (kind 0; the end has no bytes) and of five-byte windows (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]):
        words, seats = Tally(), Seats()
        for batch in batches:
            for _, texts in pieces(batch, text_col):
                h, _, starts, ends = tokens(texts)
                low = _LOWER[texts.data].tobytes()
                words.add(h, lambda i, low=low, s=starts, e=ends: low[s[i] : e[i]] if i < len(s) else b"")
                seats.add(windows(texts)[0])
                if len(words.keys) > most:
                    yield words.flush(0)
                if len(seats.rest.keys) > most:
                    yield seats.rest.flush(1)
        yield words.flush(0)
        yield from seats.flush(1)

    parts = docs.select(text_col).mapInArrow(run, "kind int, key long, token binary, n long")
    return parts.groupBy("kind", "key", "token").agg(F.sum("n").alias("n"))


def bits_of(symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of the symbols, from the highest: the bit, and the bits before it."""
    node = np.ones(len(symbol), np.uint64)
    for bit in range(7, -1, -1):
        value = symbol >> np.uint64(bit) & np.uint64(1)
        yield value, node
        node = node << np.uint64(1) | value


#: A spread value for the bits of a byte so far.
_NODES = mixed(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(splitmix(4242)))


def bases_of(context: int, w: np.ndarray, p: np.ndarray | None) -> np.ndarray:
    """Hash of each place's context: w are windows, p prefix hashes (for the last context)."""
    if context == ORDERS:
        return p
    key = w >> np.uint64(8) & np.uint64((1 << 8 * (context + 1)) - 1)
    return key << np.uint64(8) if context == 0 else mixed(key)


def slots_of(context: int, base: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """Slot of each bit's counter, of `size` slots."""
    if context == 0:
        return (base | node).view(np.int64)
    return ((base ^ _NODES.take(node.view(np.int64))) & np.uint64(size - 1)).view(np.int64)


def _level(context: int, seen: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(STEPS.get(context, ()), float), seen, "right")


#: The last bits of a prediction's fraction hold the level of what its slot has seen, so that one access gets both.
_LEVEL = 7


def _predictions(context: int, counts: np.ndarray, less: tuple[tuple[int, int], ...] = ((0, 0),)) -> np.ndarray:
    """Stretched prediction and level of every slot; for each of `less`, with so many zeros and ones taken away."""
    zero, one = counts
    out = np.empty(len(less) * len(zero), np.float32)
    for i, (fewer_zeros, fewer_ones) in enumerate(less):
        for lo in range(0, len(zero), 1 << 18):
            a, b = (np.maximum(x[lo : lo + (1 << 18)] - y, 0) for x, y in ((zero, fewer_zeros), (one, fewer_ones)))
            x = np.log((b + ALPHA) / (a + ALPHA)).astype(np.float32).view(np.uint32)
            out[i * len(zero) + lo :][: len(x)] = (x & ~np.uint32(_LEVEL) | _level(context, a + b).astype(np.uint32)).view(np.float32)
    return out


class Model:
    """Counters by context (2 x slots), mixing weights by gate, and the refining map by bits so far and level."""

    def __init__(self, counters: list[np.ndarray]):
        self.counters = counters
        self.sizes = [c.shape[1] for c in counters]
        self.weights = np.full((GATES, CONTEXTS + 1), 0.3)
        self.map = None
        self.ready: list[np.ndarray] = []  # of each slot: stretched prediction and level of what it has seen
        self.spared: list[np.ndarray] = []  # the same without the last zero of each slot, then without its last one

    def frozen(self) -> Model:
        """For scoring: predictions in place of counts."""
        out = Model([])
        out.weights, out.map, out.sizes = self.weights.astype(np.float32), None if self.map is None else self.map.astype(np.float32), self.sizes
        out.ready = [_predictions(o, counts) for o, counts in enumerate(self.counters)]
        return out

    def learning(self) -> Model:
        """For learning: predictions without a bit's last occurrence take the place of counts, context by context, so that a
        worker never holds both."""
        while self.counters:
            self.spared.append(_predictions(len(self.spared), self.counters.pop(0), ((1, 0), (0, 1))))
        return self

    def contexts(self, w: np.ndarray, p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """What the eight bits of a place share: the hash of each context, and the gate's first part, the place in the word."""
        inside, gate = np.ones(len(w), bool), np.zeros(len(w), np.int64)
        for i in range(1, ORDERS + 1):  # bytes of the current word, up to four
            inside &= ~_APART[(w >> np.uint64(8 * i) & np.uint64(255)).view(np.int64)]
            gate += inside
        return [bases_of(o, w, p) for o in range(CONTEXTS)], gate

    def inputs(self, bases: list[np.ndarray], gate: np.ndarray, node: np.ndarray, own: np.ndarray | None = None):
        """Stretched predictions of all contexts (a row for each context), and the gate: place in the word, and how much the
        longer contexts have seen.  `own`: bits whose last occurrence is left out."""
        x = np.full((CONTEXTS + 1, len(node)), 0.3, np.float32)
        for o in range(CONTEXTS):
            slot = slots_of(o, bases[o], node, self.sizes[o])
            if own is not None:
                got = self.spared[o].take(slot + own * self.sizes[o])
            elif self.ready:
                got = self.ready[o].take(slot)
            else:
                got = _predictions(o, self.counters[o][:, slot])
            x[o] = got
            if o in STEPS:
                gate = gate * (len(STEPS[o]) + 1) + (got.view(np.int32) & _LEVEL)
        return x, gate

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        s = self.weights[:, 0].take(gate) * x[0]
        for o in range(1, CONTEXTS + 1):
            s += self.weights[:, o].take(gate) * x[o]
        return np.clip(s, -16, 16, out=s)

    def chance(self, s: np.ndarray, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probability of the bit `value`: the mean of the mixture and of the map between its two nearest levels."""
        one = value == 1
        q = 1 / (1 + np.exp(np.where(one, -s, s)))
        if self.map is not None:
            at = (np.clip(s, -8, 8) + 8) * ((LEVELS - 1) / 16)
            low = np.minimum(at.astype(np.int64), LEVELS - 2)
            part = at - low
            row = node.view(np.int64) * LEVELS + low
            m = self.map.take(row) * (1 - part) + self.map.take(row + 1) * part
            q = (q + np.where(one, m, 1 - m)) / 2
        return q

    def log10(self, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each window's last byte."""
        out = np.ones(len(w))
        for lo in range(0, len(w), 1 << 13):
            some = w[lo : lo + (1 << 13)]
            bases, place = self.contexts(some, p[lo : lo + (1 << 13)])
            for value, node in bits_of(some):
                out[lo : lo + (1 << 13)] *= self.chance(self.mix(*self.inputs(bases, place, node)), node, value)
        return np.log10(out)

    def learn(self, w: np.ndarray, p: np.ndarray, n: np.ndarray, bend: np.ndarray, one: np.ndarray, both: np.ndarray, rate: float, batch: int = 8192) -> None:
        """Online steps over places (w, p) met n times.

        `bend` gathers each weight's curvature, which shortens its steps; `one` and `both` gather ones and all bits at each
        level of the map, shared between the two nearest levels of what was predicted before the step.
        """
        for lo in range(0, len(w), batch):
            some, times = w[lo : lo + batch], n[lo : lo + batch].astype(float)
            bases, place = self.contexts(some, p[lo : lo + batch])
            rows, shares, ones = [], [], []
            for value, node in bits_of(some):
                x, gate = self.inputs(bases, place, node, value.view(np.int64))
                s = self.mix(x, gate)
                at = (np.clip(s, -8, 8) + 8) * ((LEVELS - 1) / 16)
                low = np.minimum(at.astype(np.int64), LEVELS - 2)
                row, part = node.view(np.int64) * LEVELS + low, (at - low) * times
                rows += [row, row + 1]
                shares += [times - part, part]
                ones += [value, value]
                q = 1 / (1 + np.exp(-s))
                error, curve = (value - q) * times, q * (1 - q) * times
                for o in range(CONTEXTS + 1):
                    bend[:, o] += np.bincount(gate, curve * x[o] * x[o], GATES)
                    self.weights[:, o] += rate * np.bincount(gate, error * x[o], GATES) / bend[:, o]
            row, share = np.concatenate(rows), np.concatenate(shares)
            both += np.bincount(row, share, 256 * LEVELS)
            one += np.bincount(row, share * np.concatenate(ones), 256 * LEVELS)

    def set_map(self, one: np.ndarray, both: np.ndarray, weight: float = 8.0) -> None:
        level = 1 / (1 + np.exp(-(np.arange(LEVELS) * (16 / (LEVELS - 1)) - 8)))
        level = np.tile(level, 256)
        self.map = np.clip((one + weight * level) / (both + weight), 1e-6, 1 - 1e-6)


def _key(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    return mixed(w * np.uint64(0xD6E8FEB86659FD93) + p)


class Kept:
    """Values by key in a table of fixed size: each slot holds the last one."""

    def __init__(self, size: int, kind):
        self.mask, self.keys, self.values = np.uint64(size - 1), np.zeros(size, np.uint64), np.zeros(size, kind)
        self.keys[0] = 1

    def get(self, key: np.ndarray, compute) -> np.ndarray:
        """The value of each key; `compute` gives those of the keys at some indices, for keys that the table does not hold."""
        slot = (key & self.mask).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            value = compute(miss[first]).astype(out.dtype)
            out[miss] = value[back]
            at = (new & self.mask).astype(np.int64)
            self.keys[at], self.values[at] = new, value
        return out


class Cache:
    """log10 probabilities of the stretches, and below them of the places, that a worker has met."""

    def __init__(self, model: Model, size: int = 1 << 21):
        self.model, self.places, self.stretches = model, Kept(size, np.float32), Kept(size, float)

    def log10(self, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self.places.get(_key(w, p), lambda at: self.model.log10(w[at], p[at])).astype(float)

    def texts(self, t: Texts) -> np.ndarray:
        """log10 probability of each text."""
        found = Stretches(t)

        def compute(at):
            w, p, of = found.some(at).places()
            return np.bincount(of, self.log10(w, p), len(at))

        return np.bincount(found.text, self.stretches.get(found.keys, compute), t.n)


#: What this Python worker last learnt or scored with; its tasks share it.
_KEPT: dict[str, object] = {}


def _kept(name: str, make):
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def cache_of(name: str, model: Model) -> Cache:
    return _kept(name, lambda: Cache(model))


def learner(name: str, model: Model) -> Model:
    """A model for one task to learn with: its own weights, the worker's predictions."""
    ready, out = _kept(name, model.learning), Model([])
    out.sizes, out.spared = ready.sizes, ready.spared
    return out


class Places:
    """Distinct places (w, p) and how often a task has met them.

    The first place of each slot of a table is counted there, the others wait in `rest`; both have a bounded size.
    """

    def __init__(self, size: int = 1 << 21, most: int = 1 << 20):
        self.mask, self.most = np.uint64(size - 1), most
        self.keys, self.counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.w, self.p = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.rest: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, w: np.ndarray, p: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places met n times.  Yields the places (w, p, n) that there is no more room for."""
        key = _key(w, p) | np.uint64(1 << 63)
        slot = (key & self.mask).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] == 0)
        self.keys[slot[new]] = key[new]
        new = new[self.keys[slot[new]] == key[new]]
        self.w[slot[new]], self.p[slot[new]] = w[new], p[new]
        seated = self.keys[slot] == key
        np.add.at(self.counts, slot[seated], n[seated])
        other = np.flatnonzero(~seated)
        if len(other):
            distinct, first, at = np.unique(key[other], return_index=True, return_inverse=True)
            self.rest.append((distinct, w[other[first]], p[other[first]], np.bincount(at, n[other], len(distinct)).astype(np.int64)))
        if sum(len(x[0]) for x in self.rest) > self.most:
            yield self._rest()

    def _rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, w, p, n = (np.concatenate(x) for x in zip(*self.rest, strict=True))
        self.rest = []
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        return w[first], p[first], np.bincount(at, n, len(first)).astype(np.int64)

    def last(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All that are still held; in the order of a hash, not of the alphabet."""
        if self.rest:
            yield self._rest()
        at = np.flatnonzero(self.counts)
        yield self.w[at], self.p[at], self.counts[at]


def _add(counts: np.ndarray, context: int, w: np.ndarray, p: np.ndarray | None, n: np.ndarray) -> None:
    base = bases_of(context, w, p)
    for value, node in bits_of(w):
        slot, at = np.unique(slots_of(context, base, node, counts.shape[1]), return_inverse=True)
        for bit in (0, 1):
            counts[bit][slot] += np.bincount(at, np.where(value == bit, n, 0), len(slot))


def slot_sizes(found: DataFrame) -> list[int]:
    """Slots of each context: four for each (context, next byte) of the training documents, in bounds, as a power of two."""
    window = F.when(F.col("kind") == 1, F.col("key"))
    pairs = [F.approx_count_distinct(window.bitwiseAND((1 << 8 * (o + 2)) - 1)) for o in range(ORDERS)]
    letters = F.coalesce(F.sum(F.when(F.col("kind") == 0, F.length("token") + 1)), F.lit(0))  # at least as many as word contexts have
    row = found.agg(*pairs, letters).first()
    return [SLOTS[0], *(min(max(SLOTS[o], 1 << (4 * row[o]).bit_length()), max(SLOTS[o], MOST_SLOTS)) for o in range(1, CONTEXTS))]


def counters_of(found: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Counters of all contexts from the counts of windows and tokens (a space stands for what ends a word).

    They are summed in Spark, packed by 4096 slots, so the driver gets as many rows as the model has packs.
    """
    base = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
    pair = np.dtype([("slot", np.uint16), ("zero", np.float64), ("one", np.float64)])

    def run(batches):
        counts = [np.zeros((2, s)) for s in sizes]
        for batch in batches:
            kind, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            w = batch.column(1).to_numpy().view(np.uint64)[kind == 1]
            if len(w):
                for o in range(ORDERS):
                    _add(counts[o], o, w, None, n[kind == 1])
            words = batch.filter(pa.array(kind == 0))
            n, lo = n[kind == 0], 0
            for part, t in pieces(words, "token"):
                w, text = windows(t)
                p = prefixes(t)
                some = np.diff(t.offsets)[text] > 0  # the end of a text is no word
                symbol = np.where(w & np.uint64(255) == END, np.uint64(32), w & np.uint64(255))
                _add(counts[ORDERS], ORDERS, symbol[some], p[some], n[lo : lo + part.num_rows][text][some])
                lo += part.num_rows
        for b, c in zip(base, counts, strict=True):
            for at in range(0, c.shape[1], PACK):
                zero, one = c[:, at : at + PACK]
                i = np.flatnonzero(zero + one)
                if len(i):
                    data = np.empty(len(i), pair)
                    data["slot"], data["zero"], data["one"] = i, zero[i], one[i]
                    yield batch_of(pack=np.array([(b + at) // PACK]), data=pa.array([data.tobytes()], pa.binary()))

    def add(frame):
        import pandas as pd

        both = np.zeros((2, PACK))
        for x in frame["data"]:
            x = np.frombuffer(x, pair)
            both[0, x["slot"]] += x["zero"]
            both[1, x["slot"]] += x["one"]
        return pd.DataFrame({"pack": frame["pack"].iloc[:1], "data": [both.astype(np.float32).tobytes()]})

    packs = found.select("kind", "key", "token", "n").mapInArrow(run, "pack long, data binary").groupBy("pack").applyInPandas(add, "pack long, data binary")
    table = np.zeros((2, sum(sizes)), np.float32)
    for r in packs.toLocalIterator():
        table[:, r["pack"] * PACK : (r["pack"] + 1) * PACK] = np.frombuffer(r["data"], np.float32).reshape(2, PACK)
    return [table[:, b : b + s] for b, s in zip(base, sizes, strict=True)]


def most_frequent(vocabulary: DataFrame, head: int) -> DataFrame:
    """The most frequent tokens, at most `head` of them: those above a count that sixteenths of octaves set."""
    level = F.floor(F.log2("n") * 16)
    sizes = sorted((r["level"], r["n"]) for r in vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect())
    total, least = 0, math.inf
    for at, n in reversed(sizes):
        total += n
        if total > head:
            break
        least = at
    return vocabulary.where(level >= F.lit(least)) if least < math.inf else vocabulary.limit(0)


def train(docs: DataFrame, text_col: str, counters: list[np.ndarray], rate: float = 0.3) -> Model:
    """The model from its counters: weights and map, learnt in one pass over `docs`."""
    model = Model(counters)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    size = GATES * (CONTEXTS + 1)

    def learn(batches):
        own, bend = learner(name, shared.value), np.full((GATES, CONTEXTS + 1), START)
        one, both = np.zeros(256 * LEVELS), np.zeros(256 * LEVELS)
        met, places = Met(), Places()

        def found():
            for batch in batches:
                for _, texts in pieces(batch, text_col):
                    yield from met.add(texts)
            yield from met.last()

        for more in found():
            for some in places.add(*more):
                own.learn(*some, bend, one, both, rate)
        for some in places.last():
            own.learn(*some, bend, one, both, rate)
        mass = bend.reshape(-1) - START
        yield batch_of(at=np.arange(size + len(one)), a=np.concatenate((own.weights.reshape(-1) * mass, one)), b=np.concatenate((mass, both)))

    # as many rows as the model has weights and levels, for any corpus
    a, b = np.zeros(size + 256 * LEVELS), np.zeros(size + 256 * LEVELS)
    for r in docs.select(text_col).mapInArrow(learn, "at long, a double, b double").groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        a[r["at"]], b[r["at"]] = r["a"], r["b"]
    weights = np.where(b[:size] > 0, a[:size] / np.maximum(b[:size], 1e-9), model.weights.reshape(-1))
    model.weights = weights.reshape(GATES, CONTEXTS + 1)
    model.set_map(a[size:], b[size:])
    shared.destroy()
    return model


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    found = stored(counted(training, text_col), "lm-counts")
    vocabulary = found.where("kind = 0").select("key", "n")
    total, distinct = vocabulary.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    floor = total + distinct + 1
    frequent = most_frequent(vocabulary, head).toPandas().sort_values("key")
    model = train(training, text_col, counters_of(found, slot_sizes(found))).frozen()
    spark = docs.sparkSession.sparkContext
    name = uuid.uuid4().hex
    shared = spark.broadcast((model, frequent["key"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)))

    def run(batches):
        model, keys, counts = shared.value
        cache = cache_of(name, model)
        value = np.log10((counts + 1) / floor)
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                bits = cache.texts(texts)
                n_bytes = np.diff(texts.offsets) + 1
                h, of, _, _ = tokens(texts)
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                base = np.bincount(of[known], value[at[known]], texts.n).astype(float)
                # the others, by text
                rest, owner = h[~known], of[~known]
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(texts.n + 1))
                others = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(rest[order]))
                yield batch_of(id=part.column(0), held_out=part.column(2), n_tokens=np.bincount(of, minlength=texts.n), known=np.bincount(of[known], minlength=texts.n), base=base, score=bits, n_bytes=n_bytes, others=others)

    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, others array<bigint>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    others = scored.select("row", F.explode("others").alias("key")).join(vocabulary, "key", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    others = others.groupBy("row").agg(F.sum(F.log10((c + 1) / F.lit(float(floor)))).alias("more"), F.sum((c > 0).cast("long")).alias("seen"))
    out = scored.drop("others").join(others, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
