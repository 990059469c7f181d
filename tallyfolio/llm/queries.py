"""Registered queries of the operators in this folder, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.llm import bpe, contextmix, divergence, importance, langid, ledger, lengths, mixture, periods, pii, simhash, suffixes, tiling
from tallyfolio.llm.common import read, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


@query("op4_pii")
def op4_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.find(read(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) q WHERE n > 1 GROUP BY r),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN p USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, NOT (base OR more) AS kept, FAILED AS failed
FROM (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base, (OTHERS) AS more FROM m)
"""


def _ledger_sql() -> str:
    chosen = [ledger.RULES[r] for r in ledger.POLICIES[ledger.CURRENT]]
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(ledger.RULES.values()))
    return _LEDGER_SQL.replace("OTHERS", " OR ".join(f"({r})" for r in chosen)).replace("FAILED AS", f"({bits})::BIGINT AS")


@query("op9_rule_ledger", _ledger_sql())
def op9_rule_ledger(spark, sf_dir):
    """Measurements, failed rules and verdict of every document."""
    found = ledger.verdicts(ledger.measure(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


@query("op10_mixture", mixture.ORACLE.replace("{documents}", "documents"))
def op10_mixture(spark, sf_dir):
    """Words that the mix takes from every document."""
    return mixture.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op1_importance")
def op1_importance(spark, sf_dir):
    """Importance weight of every document, and whether the sample keeps it."""
    return importance.sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and its coverage."""
    return tiling.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op2_token_lengths")
def op2_token_lengths(spark, sf_dir):
    """Exact histogram of encoded lengths with its suffix sums: totals, quantiles and truncated totals at every length."""
    return lengths.with_suffix_sums(stored(lengths.histogram(read(spark, sf_dir, "documents")), "length-histogram"))


@query("op3_suffix_repeats")
def op3_suffix_repeats(spark, sf_dir):
    """Stretches of documents that are parts of passages repeated in other documents."""
    return suffixes.repeats(read(spark, sf_dir, "documents"))


@query("op5_language")
def op5_language(spark, sf_dir):
    """Language of every page."""
    return langid.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


@query("op6_context_mixing")
def op6_context_mixing(spark, sf_dir):
    """Log probability of every document."""
    return contextmix.score(read(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, a tenth of them with a planted repeat."""
    return periods.digests(periods.find(read(spark, sf_dir, "documents"), order=periods.planted))


@query("op12_bpe_chunks")
def op12_bpe_chunks(spark, sf_dir):
    """Token ids of every document and the text they decode to, as digests."""
    whole = bpe.decode(bpe.encode(read(spark, sf_dir, "documents")))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_source_divergence", divergence.ORACLE)
def op13_source_divergence(spark, sf_dir):
    """Divergence of every two sources of a language, and the terms each source uses most above its language."""
    return divergence.audit(read(spark, sf_dir, "documents"))
