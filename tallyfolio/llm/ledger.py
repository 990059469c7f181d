"""Operator 9, quality rules as a bitmask ledger.

`measure` reads every text once and stores its measurements and one bit for each failed rule.  Policies are versioned
masks over these bits: `verdicts` applies one without reading texts again, and `ablation` gets what each rule of a policy
removes, alone and with others, from one count by mask.

Words are runs of bytes other than ASCII white space.  Three-word windows are compared by 64-bit hashes.

Defined cases: null is an empty text, which has no words and fails `too_short`; a window must repeat within its own text;
lines without a word are neither counted nor compared; repeated rows are each measured; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.common import SPACE, gram_hashes, mixed, pieces, range_hashes

#: Rule, and its SQL over the measurements.  The position is the bit.
RULES = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "4 * n_symbols > n_words",
    "shouting": "n_upper > n_lower",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}

#: Versioned policies: the rules that reject.  The contract's base rules are in all of them.
POLICIES = {
    "base": ("too_short", "repetitive"),
    "v1": ("too_short", "repetitive", "symbol_heavy", "shouting", "repeated_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(65, 91))] = True
_LOWER = np.zeros(256, bool)
_LOWER[list(range(97, 123))] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(h: np.ndarray, first: np.ndarray, n: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of n words found twice or more in it."""
    marked = np.zeros(len(h) + 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(h) >= n:
        grams = gram_hashes(h, n)
        at = np.flatnonzero(text[: len(grams)] == text[n - 1 :])
        keys = mixed(grams[at] + (text[at].astype(np.uint64) << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(at), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = at[order[again]]
        np.add.at(marked, hit, 1)
        np.add.at(marked, hit + n, -1)
    return _per_text(np.cumsum(marked)[:-1] > 0, first)


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = [line for line in text.split(b"\n") if _WORD.search(line)]
    return len(lines), len(lines) - len(set(lines))


def _measures(t) -> list[np.ndarray]:
    starts, ends, first = t.words()
    data, offsets = t.data, t.offsets
    points = (data & 0xC0) != 0x80
    raw = data.tobytes()
    lines = np.array([_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
    return [
        np.diff(first), _per_text(points & ~SPACE[data], offsets), _per_text(_SYMBOLS[data], offsets), lines[:, 0], lines[:, 1],
        _repeat_words(range_hashes(data, starts, ends, lower=False), first), _per_text(_UPPER[data], offsets), _per_text(_LOWER[data], offsets),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: (id_col, measurements..., failed), one row per document; bit i of `failed` is rule i."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part, texts in pieces(b, text_col):
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x.astype(np.int64)) for x in _measures(texts)]], names=[id_col, *MEASURES])

    ledger = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{m} long' for m in MEASURES)}")
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
    return ledger.withColumn("failed", F.expr(bits).cast("long"))


def mask(policy: str | tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def verdicts(ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """The ledger with `base_failed` and `kept` under one policy."""
    bad = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return ledger.withColumn("base_failed", bad).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy) | mask("base"))) == 0)


def ablation(ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only): documents that fail a rule of the policy, and those that only it removes."""
    m = mask(policy)
    by_mask = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if m >> i & 1])).alias("r")
    hit = by_mask.select("bits", "n", rules).where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return hit.groupBy("r.rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))
