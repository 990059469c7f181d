"""Operator 2, token counts as an exact length histogram.

Each document is encoded once; what is kept is the number of documents of each encoded length.  From suffix sums of this
histogram follow, without another pass over texts, the total number of tokens, any quantile of the length, and for every
context limit the documents that exceed it and the tokens left if texts are cut at it.

Suffix sums have two levels (lengths in blocks of 1024), so a window holds one block, or one row for each block.

Defined cases: null and empty texts have length 0 and are counted; very long texts, also of white space alone, are encoded
whole; special tokens' strings are ordinary text; repeated
rows are counted each; other columns are ignored.  The vocabulary file is a parameter and must be readable on executors.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.llm.common import batch_of

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that goes with the vocabulary's byte-pair merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024


@functools.cache
def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space from this length on are encoded apart: the library's pattern engine recurses over them.
LONG = 50_000
_LONG_SPACE = re.compile(r"\s{%d,}" % LONG)


def length_of(text: str | None, path: str = VOCABULARY) -> int:
    """Number of tokens of a text.

    In a run of white space before something else the pattern gives the last character to what follows (if it is a space) or
    a piece of its own, and all before it to one piece; at a text's end the whole run is one piece.  A very long run is
    therefore taken out: its piece is encoded by itself, and what follows begins with the last character.
    """
    if not text:
        return 0
    code, n, at = encoder(path), 0, 0
    for run in _LONG_SPACE.finditer(text) if len(text) >= LONG else ():
        last = run.end() if run.end() == len(text) else run.end() - 1
        n += len(code.encode_ordinary(text[at : run.start()])) + piece_length(text[run.start() : last], code)
        at = last
    return n + len(code.encode_ordinary(text[at:]))


def piece_length(piece: str, code) -> int:
    """Tokens of a text that the pattern leaves in one piece."""
    return len(code._core_bpe.encode_single_piece(piece.encode()))


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([length_of(t.as_py(), path) for t in b.column(1)], pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def histogram(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): each task counts the lengths of its own rows before anything is shuffled."""

    def run(batches):
        total: dict[int, int] = {}
        for b in batches:
            length, n = np.unique([length_of(t.as_py(), path) for t in b.column(0)], return_counts=True)
            for x, c in zip(length.tolist(), n.tolist(), strict=True):
                total[int(x)] = total.get(int(x), 0) + c
        yield batch_of(n_tokens=np.array(list(total), np.int64), n_docs=np.array(list(total.values()), np.int64))

    return docs.select(text_col).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram with sums over all lengths from each one on.

    docs_from, tokens_from: documents of at least this length, and their tokens; tokens_at_limit: tokens left if texts
    are cut at this length; docs_over: documents that lose something; share_upto: share of documents up to this length.
    """
    blocks = counts.groupBy(F.floor(F.col("n_tokens") / BLOCK).alias("block")).agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t")
    )
    rows = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).join(blocks, "block")
    on = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("docs_from", F.col("later_d") + F.sum("n_docs").over(on)).withColumn("tokens_from", F.col("later_t") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(on))
    return rows.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("docs_from") - F.col("n_docs")).alias("docs_over"),
        (F.col("all_t") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("tokens_at_limit"),
        ((F.col("all_d") - F.col("docs_from") + F.col("n_docs")) / F.col("all_d")).alias("share_upto"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, tokens_at_limit) for any context limits, also those that no document has as its length."""
    lim = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit")
    rows = sums.select(lim, "*")
    over, upto = F.col("n_tokens") > F.col("limit"), F.col("n_tokens") <= F.col("limit")
    n = F.sum(F.when(over, F.col("n_docs")).otherwise(0))
    kept = F.sum(F.when(upto, F.col("n_docs") * F.col("n_tokens")).otherwise(0))
    return rows.groupBy("limit").agg(n.alias("docs_over"), (kept + n * F.col("limit")).alias("tokens_at_limit"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    rows = sums.select(F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"), "n_tokens", "share_upto")
    return rows.where(F.col("share_upto") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
