"""Operator 13, divergence of sources by Gustavson row accumulation.

Each language keeps the terms that are in enough of its documents.  A group (language, source) has a smoothed rate for each
kept term, and two groups differ by sum f(p, q), f = floor((p - q)^2 / (p + q)), over all kept terms, also those that one or
both lack.

Counts per (language, source, term) are sparse.  They are dealt by (language, term), so that a task holds whole rows of the
term-major index.  There each group's terms are scattered through the index into a dense accumulator with a place for each
peer, which is emitted once for a block of terms: no pair of postings is ever a row.  What a missing posting adds depends on
the group alone, so it's added from each group's histogram of counts and taken out again where both have the term:

    S(g, h) = V f(p0, q0) + sum over g's terms (f(p, q0) - f(p0, q0)) + sum over h's terms (f(p0, q) - f(p0, q0))
              + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

Scale: words are counted in tasks before the shuffle (a source with a third of all rows is a few counts a task), the index is
processed in blocks of `BLOCK` postings, and an accumulator is as long as one row of the result.  Rates are exact (decimal
division); sums of f are whole numbers far below 2^53.

Defined cases: null text, lang and source are '', and '' is a language and a source like any other; groups without terms have
rows all the same; a language without kept terms has divergences of 0 and no terms; a language's only source has no pair;
repeated rows count each; ties go to the item that is first in UTF-8; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.llm.common import batch_of, stored

LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes of texts counted before a task hands its counts on, and postings of one block of the index.
HELD, BLOCK = 64 << 20, 1 << 19
#: Bytes from 0x80 on are parts of characters above 0x7F, all of which belong to terms.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n: occurrences, docs: documents with the term)."""

    def run(batches):
        n: dict = {}
        d: dict = {}
        size = 0

        def flush():
            for (lang, source), terms in n.items():
                got = d[lang, source]
                keys = list(terms)
                yield batch_of(
                    lang=pa.array([lang] * len(keys), pa.string()), source=pa.array([source] * len(keys), pa.string()),
                    term=pa.array(keys, pa.binary()).cast(pa.string()), n=pa.array(terms.values(), pa.int64()), docs=pa.array([got[t] for t in keys], pa.int64()),
                )

        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()))
            for lang, source, text in zip(*columns, strict=True):
                text = text.as_py() or b""
                group = (lang, source)
                if group not in n:
                    n[group], d[group] = Counter(), Counter()
                terms = _TERM.findall(text.lower())
                n[group].update(terms)
                d[group].update(set(terms))
                size += len(text)
                if size > HELD:
                    yield from flush()
                    n, d, size = {}, {}, 0
        yield from flush()

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    each = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rate(n, total, kept):
    """1 + floor(SCALE (n + 2) / (total + 2 kept)); 1 if nothing is kept."""
    big = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))"
    return F.expr(f"1 + CASE WHEN {kept} = 0 THEN 0L ELSE {big} div CAST({total} + 2 * {kept} AS DECIMAL(20,0)) END")


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, k: number in its language, p0: rate of a missing term, v: kept terms) and the postings of kept
    terms (lang, term, source, k, n, p, p0, q: the language's rate), both written to the shared folder."""
    counts = stored(counted(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= LEAST)
    kept = stored(kept.select("lang", "term", "lang_n"), "divergence-kept")
    postings = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = names.join(postings.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "lang_total"]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = stored(groups.select("lang", "source", "k", "v", "total", "lang_total", _rate("0", "total", "v").alias("p0")), "divergence-groups")
    postings = postings.join(groups, ["lang", "source"])
    postings = postings.select("lang", "term", "source", "k", "n", _rate("n", "total", "v").alias("p"), "p0", _rate("lang_n", "lang_total", "v").alias("q"))
    return groups, stored(postings, "divergence-index")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def rows_of(term: np.ndarray, k: np.ndarray, p: np.ndarray, p0: np.ndarray):
    """For each group of one language's block of the index (sorted by term): its number and what common terms add, by peer."""
    peers = int(k.max()) + 1
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    size = np.diff(np.append(begin, len(term)))
    row = np.repeat(np.arange(len(begin)), size)
    order = np.argsort(k, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
        sums = np.zeros(peers)
        for lo in range(0, len(mine), 4096):  # scatter some terms at a time
            part = mine[lo : lo + 4096]
            n = size[row[part]]
            own = np.repeat(part, n)
            other = np.repeat(begin[row[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, a0, b, b0 = p[own], p0[own], p[other], p0[other]
            both = distance(a, b) - distance(a, b0) - distance(a0, b) + distance(a0, b0)
            sums += np.bincount(k[other], both, peers)
        yield int(k[mine[0]]), sums.astype(np.int64)


def common(postings: DataFrame) -> DataFrame:
    """(lang, k, peer, value): what terms of both groups add to their divergence, from every block of the index."""

    def emit(parts):
        rows = [(lang, own, at, sums[at]) for lang, own, sums in parts for at in [np.flatnonzero(sums)]]
        n = [len(at) for _, _, at, _ in rows]
        return batch_of(
            lang=pa.array([lang for (lang, *_), m in zip(rows, n, strict=True) for _ in range(m)], pa.string()),
            k=np.repeat(np.array([own for _, own, _, _ in rows], np.int32), n),
            peer=np.concatenate([at for _, _, at, _ in rows]).astype(np.int32), value=np.concatenate([v for *_, v in rows]),
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def block(table: pa.Table):
            lang = table.column("lang").combine_chunks().dictionary_encode()
            code = lang.indices.to_numpy()
            term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            k, p, p0 = (table.column(c).to_numpy() for c in ("k", "p", "p0"))
            for c in range(len(lang.dictionary)):
                here = code == c
                name = lang.dictionary[c].as_py()
                yield emit([(name, own, sums) for own, sums in rows_of(term[here], k[here], p[here], p0[here])])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                last = table.slice(size - 1).select(["lang", "term"]).to_pylist()[0]
                keys = table.select(["lang", "term"])
                cut = size - 1
                while cut and keys.slice(cut - 1, 1).to_pylist()[0] == last:  # the last term may go on: it stays
                    cut -= 1
                if cut:
                    yield from block(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), size - cut
        if size:
            yield from block(pa.Table.from_batches(held))

    dealt = postings.select("lang", "term", "k", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, k int, peer int, value long").groupBy("lang", "k", "peer").agg(F.sum("value").alias("value"))


def baselines(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, k, peer, value): what pairs add with all of the peer's postings missing, and the other way round."""
    peers = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "p0"))).alias("peers"))
    counts = postings.groupBy("lang", "k", "p").agg(F.count("*").alias("m"))
    counts = counts.groupBy("lang", "k").agg(F.collect_list("p").alias("p"), F.collect_list("m").alias("m"))
    rows = groups.select("lang", "k", "p0", "v").join(counts, ["lang", "k"], "left").join(peers.select("lang", F.col("peers.p0").alias("q0")), "lang")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q0 = np.array(r["q0"], np.int64)
                zero = distance(r["p0"], q0)
                sums = np.zeros(len(q0), np.int64)
                for p, m in zip(r["p"] or [], r["m"] or [], strict=True):
                    sums += m * (distance(p, q0) - zero)
                peer, own = np.arange(len(q0), dtype=np.int32), np.full(len(q0), r["k"], np.int32)
                for k, other, value in ((own, peer, sums + r["v"] * zero), (peer, own, sums)):
                    yield batch_of(lang=pa.array([r["lang"]] * len(q0)), k=k, peer=other, value=value)

    return rows.select("lang", "k", "p0", "v", "p", "m", "q0").mapInArrow(run, "lang string, k int, peer int, value long")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of a language's sources, and each group's most overused terms."""
    groups, postings = index(docs)
    sums = baselines(groups, postings).union(common(postings)).where("k <> peer").groupBy("lang", "k", "peer").agg(F.sum("value").alias("value"))
    name = groups.select("lang", "k", "source")
    pairs = sums.join(name, ["lang", "k"]).join(name.select("lang", F.col("k").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= TOP))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= LEAST_DOCS),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, v, lang_total, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2) // (total + 2 * v) AS p,
    1 + 1000000000 * (lang_n + 2) // (lang_total + 2 * v) AS q FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= TOP_TERMS
"""
ORACLE = _SQL.replace("LEAST_DOCS", str(LEAST)).replace("TOP_TERMS", str(TOP))
