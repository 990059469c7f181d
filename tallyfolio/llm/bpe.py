"""Operator 12, byte-pair encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its last `SPAN` bytes is divisible by `EVERY`, so that equal passages of different
documents are cut into equal chunks wherever they stand.  A chunk is encoded when it is first met and looked up after that.
Cuts fall anywhere, also inside words or characters, hence what a chunk says about its edges is not to be trusted: each join
of chunks is repaired by re-encoding a window around it.  The window grows to both sides until its encoding and that of the
chunk it reaches into agree there, which is at white space: the vocabulary's rules never let a token, a normalisation or a
special token's string reach over it, so what lies beyond is encoded alike with and without the window.  A window may
swallow whole chunks (a long text without white space is one window).  Windows are words and recur like chunks: they too
are encoded once.  A new chunk is put together from such words in turn.

Scale: one pass over rows, no shuffle.  What has been encoded is kept by each Python worker over all its tasks, in two
generations of bounded size; a full one replaces the older, so memory is bounded and what recurs stays.

Defined cases: null and empty texts have no tokens, and decode to the empty text; special tokens' strings in a text are
those tokens, as the tokenizers library reads them; null ids and repeated rows have one result each; other columns are
ignored.  The vocabulary file is a parameter and must be readable on executors.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyfolio.llm.common import SPACE, Texts, mixed, pieces

VOCABULARY = os.environ.get("WORD_TOKENIZER_FILE", "/opt/tokenizers/word_bpe_49k.json")
#: Bytes that the rolling hash covers, and one cut in so many bytes.
SPAN, EVERY = 16, 256
#: Bytes (with what Python adds) of one generation of encoded words and of encoded chunks.
KEPT_WORDS, KEPT_CHUNKS = 48 << 20, 8 << 20
_STEP = 0x9E3779B97F4A7C15


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Memory:
    """Bytes to bytes, in two generations of bounded size."""

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, key: bytes):
        value = self.new.get(key)
        if value is None and self.old:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: bytes, value: bytes) -> None:
        self.size += len(key) + len(value) + 200
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, len(key) + len(value) + 200
        self.new[key] = value


class Encoder:
    """Encodes texts by chunks, with what was encoded before at hand."""

    def __init__(self, path: str, words: int = KEPT_WORDS, chunks: int = KEPT_CHUNKS):
        self.tokenizer = tokenizer(path)
        self.words, self.chunks = Memory(words), Memory(chunks)

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (32 bits each) of each string without white space."""
        got = list(map(self.words.new.get, words))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if missing:
            made = {words[i]: None for i in missing}
            for word in made:
                made[word] = self.words.get(word)
            split = {word: stem_and_tail(word) for word, ids in made.items() if ids is None}
            part_of = {part: self.words.get(part) for both in split.values() for part in both}
            fresh = [part for part, ids in part_of.items() if ids is None]
            for lo in range(0, len(fresh), 4096):
                some = fresh[lo : lo + 4096]
                for part, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                    part_of[part] = ids = array("I", e.ids).tobytes()
                    self.words.put(part, ids)
            for word, both in split.items():
                made[word] = b"".join([part_of[part] for part in both])
                if both != (word,):
                    self.words.put(word, made[word])
            for i in missing:
                got[i] = made[words[i]]
        return got

    def block(self, texts: Texts) -> list[bytes]:
        """Ids of each text of a block.

        Between two windows lies what no window touches of a chunk: whole words.  All strings of the block that are new are
        encoded in one call."""
        raw = texts.data.tobytes()
        space = np.flatnonzero(SPACE[texts.data])
        cuts = cuts_of(texts.data)
        plan: list[list] = []  # by text: ids, or the key of a new chunk (none for a window) and its words among `todo`
        todo: list[bytes] = []
        look, keep = self.chunks.get, self.chunks.put
        for lo, hi in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
            if lo == hi:
                plan.append([])
                continue
            inside = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi, "left")]
            gaps = space[np.searchsorted(space, lo) : np.searchsorted(space, hi)]
            steps, at = [], lo
            for a, b in windows(inside, gaps, lo, hi):
                if a > at:
                    steps.append((at, a, True))
                if b > a:
                    steps.append((a, b, False))
                at = b
            if at < hi:
                steps.append((at, hi, True))
            text = []
            for a, b, chunk in steps:
                key = raw[a:b]
                if not chunk:
                    text.append((None, len(todo), 1))
                    todo.append(key)
                elif (ids := look(key)) is not None:
                    text.append(ids)
                else:
                    words = key.split()
                    text.append((key, len(todo), len(words)))
                    todo.extend(words)
            plan.append(text)
        made = self.of_words(todo)
        out = []
        for text in plan:
            parts = []
            for step in text:
                if type(step) is tuple:
                    key, at, n = step
                    step = b"".join(made[at : at + n]) if n != 1 else made[at]
                    if key is not None and len(key) <= 1 << 14:
                        keep(key, step)
                parts.append(step)
            out.append(b"".join(parts))
        return out


def stem_and_tail(word: bytes) -> tuple[bytes, ...]:
    """Parts of a word that the vocabulary's rules part in any case: what ends in an ASCII letter or digit, and a tail of
    ASCII signs other than the apostrophe; ASCII letters in lower case, as the rules make them, unless the word may hold a
    special token's string."""
    if b"<|" in word:
        return (word,)
    word = word.lower()
    stem = word.rstrip(b".,;:!?$%*#")
    return (stem, word[len(stem) :]) if len(stem) < len(word) and stem[-1:].isalnum() else (word,)


def cuts_of(data: np.ndarray) -> np.ndarray:
    """Places (sorted) behind which a new chunk begins, chosen by the bytes before them alone."""
    if len(data) < SPAN:
        return np.empty(0, np.int64)
    # doubling: a hash over 2 k bytes is made of two over k bytes
    h, width, step = data.astype(np.uint64) + np.uint64(1), 1, _STEP
    while width < SPAN:
        take = min(width, SPAN - width)
        longer = len(data) - (width + take) + 1
        h = h[:longer] * np.uint64(step) + h[take : take + longer]
        width, step = width + take, step * step % (1 << 64)
    return np.flatnonzero(mixed(h) % np.uint64(EVERY) == 0) + SPAN


def windows(cuts: np.ndarray, gaps: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """The windows around cuts of a text at [lo, hi) with white space at `gaps`: to the nearest white space on either side."""
    if not len(cuts):
        return []
    k = np.searchsorted(gaps, cuts, "left")
    begin = np.where(k > 0, gaps[np.maximum(k - 1, 0)] + 1, lo) if len(gaps) else np.full(len(cuts), lo)
    end = np.where(k < len(gaps), gaps[np.minimum(k, len(gaps) - 1)], hi) if len(gaps) else np.full(len(cuts), hi)
    fresh = np.append(True, begin[1:] != begin[:-1])
    return list(zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids: array of token ids) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                ids = code.block(texts)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


@functools.cache
def _names(path: str) -> pa.Array | None:
    """Text of each token, if the vocabulary file names no decoder: tokens are then joined by spaces."""
    found = tokenizer(path)
    if found.decoder is not None:
        return None
    return pa.array([found.id_to_token(i) for i in range(found.get_vocab_size(with_added_tokens=True))], pa.large_string())


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The rows of `encoded` with `decoded`, the text of their ids (special tokens included); null ids: the empty text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    at = encoded.columns.index("ids")

    def texts_of(ids: pa.Array) -> pa.Array:
        names = _names(path)
        if names is None:
            return pa.array(["" if x is None else tokenizer(path).decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())
        offsets = ids.offsets.to_numpy()
        flat = pc.take(names, ids.values[offsets[0] : offsets[-1]])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64) - offsets[0]), flat)
        return pc.fill_null(pc.binary_join(lists, pa.scalar(" ", pa.large_string())), "").cast(pa.string())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = pa.array(part.column(at).to_pylist(), pa.list_(pa.int32())) if part.column(at).null_count else part.column(at)
                yield pa.RecordBatch.from_arrays([*part.columns, texts_of(ids)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{kinds}, decoded string")
