"""Operator 5, language of web pages by Bayesian evidence fusion.

The log posterior of each language adds four kinds of evidence:

* text: hashed byte trigrams of the visible text, in models counted over all labelled documents; trigrams overlap, so the
  sum is scaled down to at most `trust` independent ones;
* markup: the declared language (html lang), with P(declared | language) counted over all pages;
* address suffix: P(suffix | language) in the same way;
* host: P(language | host), smoothed towards the host's domain and that towards all pages.

The counts behind the last three take each page's text language and come from grouped aggregations (host, then domain and
suffix from the hosts' sums), so a host with a third of all pages is added up before it is shuffled.  A page's own vote is
taken out of its prior.

Defined cases: null and empty pages have no text evidence, and ties go to the first language by code point; a missing
or unknown declaration is a value of its own; what opens and never closes on a page is text, and time is linear in its length; a null or odd address has an empty host; repeated rows count each; documents
without a language are left out; without any labelled document the language is null; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.common import Texts, batch_of, pieces, stored

BUCKETS = 1 << 16
TRUST, STRENGTH = 60.0, 4.0
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32

_OPEN = re.compile(rb"<(?:!--|(script|style|nav|template)\b)", re.I)
_CLOSE = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style", b"nav", b"template")} | {None: re.compile(rb"-->")}
_TAG = re.compile(rb"<[^>]*>")
_ENTITY = re.compile(rb"&#?[A-Za-z0-9]{1,10};")
_HTML, _LANG = re.compile(rb"<html\b", re.I), re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)


def shown(html: bytes | None) -> bytes:
    """The page without comments, scripts, styles, navigation and templates, each from its opening to the next closing mark.

    One pass forward: once a kind has no closing mark left, its openings are no longer looked at."""
    html = html or b""
    out, at, unclosed, begin = [], 0, set(), 0
    while opening := _OPEN.search(html, at):
        kind = opening[1] and opening[1].lower()
        closing = None if kind in unclosed else _CLOSE[kind].search(html, opening.end())
        if closing is None:
            unclosed.add(kind)
            at = opening.end()
            continue
        out.append(html[begin : opening.start()])
        at = begin = closing.end()
    return b" ".join([*out, html[begin:]])


def visible(html: bytes | None) -> bytes:
    """What a reader sees: no scripts, styles, navigation, comments, tags or entities."""
    return _seen(shown(html))


def _seen(page: bytes) -> bytes:
    end = page.rfind(b">") + 1  # no tag ends after it
    return _ENTITY.sub(b" ", _TAG.sub(b" ", page[:end]) + page[end:])


def declared(html: bytes | None) -> str:
    """The language that the page's html tag names, wherever the tag stands outside of comments and scripts."""
    return _named(shown(html))


def _named(page: bytes) -> str:
    at = 0
    while tag := _HTML.search(page, at):
        end = page.find(b">", tag.end())
        end = len(page) if end < 0 else end
        if found := _LANG.search(page, tag.end(), end):
            return found[1].decode().lower()
        at = end
    return ""


def trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of a batch, and the index of its text."""
    b = _LOWER[t.data]
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    text = np.repeat(np.arange(t.n), np.diff(t.offsets))
    inside = text[:-2] == text[2:]
    return (h >> np.uint32(16)).astype(np.int64)[inside], text[:-2][inside]


def text_model(docs: DataFrame, languages: list[str], text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """log P(trigram | language): one row per language, `BUCKETS` columns."""
    size = len(languages) * BUCKETS

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                of, text = trigrams(texts)
                total += np.bincount(part.column(1).to_numpy()[text] * BUCKETS + of, minlength=size)
        at = np.flatnonzero(total)
        yield batch_of(at=at, n=total[at])

    index = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang_col)) - 1
    parts = docs.where(F.col(lang_col).isNotNull()).select(text_col, index.cast("long").alias("k")).mapInArrow(run, "at long, n long")
    table = parts.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size)
    counts[table["at"].to_numpy()] = table["n"].to_numpy()
    counts = counts.reshape(len(languages), BUCKETS) + 0.5
    return np.log(counts / counts.sum(1, keepdims=True))


def read_pages(pages: DataFrame, model: np.ndarray, languages: list[str]) -> DataFrame:
    """(page_id, host, domain, suffix, declared, text: log likelihood by language, vote: index of the text's language)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    known = set(languages)

    def run(batches):
        table = shared.value
        for batch in batches:
            for part, _ in pieces(batch, "html"):
                raw = [x.as_py() for x in part.column(1).cast(pa.large_binary())]
                raw = [shown(x) for x in raw]
                texts = Texts(pa.array([_seen(x) for x in raw], pa.binary()))
                of, text = trigrams(texts)
                n = np.bincount(text, minlength=texts.n)
                scale = np.minimum(1, TRUST / np.maximum(n, 1))
                like = np.stack([np.bincount(text, table[of, k], texts.n) * scale for k in range(len(languages))], 1)
                vote = np.where(n > 0, like.argmax(1), -1)
                says = [d if d in known else ("?" if d else "") for d in map(_named, raw)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1, dtype=np.int32) * len(languages)), pa.array(like.reshape(-1)))
                yield batch_of(page_id=part.column(0), host=part.column(2), declared=pa.array(says, pa.string()), text=lists, vote=vote.astype(np.int32))

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    out = pages.select("page_id", "html", host.alias("host")).mapInArrow(run, f"page_id {kind}, host string, declared string, text array<double>, vote int")
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return out.withColumn("domain", domain).withColumn("suffix", F.element_at(labels, -1))


def _votes(rows: DataFrame, keys: list[str], n: int, of=None) -> DataFrame:
    """Votes for each language by key, as one array."""
    each = [F.sum(F.when(F.col("vote") == k, 1).otherwise(0) if of is None else F.col(of)[k]) for k in range(n)]
    return rows.groupBy(*keys).agg(F.array(*each).alias("n"))


def identify(pages: DataFrame, docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared) of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    languages = sorted(r[0] for r in docs.select("lang").where("lang IS NOT NULL").distinct().collect())
    if not languages:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"))
    n = len(languages)
    rows = stored(read_pages(pages, text_model(docs, languages), languages), "langid-pages")
    hosts = stored(_votes(rows, ["host", "domain", "suffix"], n), "langid-hosts")
    domains = _votes(hosts, ["domain"], n, "n").withColumnRenamed("n", "domain_n")
    suffixes = _votes(hosts, ["suffix"], n, "n").withColumnRenamed("n", "suffix_n")
    priors = hosts.join(domains, "domain").join(suffixes, "suffix").select("host", F.col("n").alias("host_n"), "domain_n", "suffix_n")
    every = np.array(_votes(hosts, [], n, "n").first()[0] or [0] * n, float)
    says = {r["declared"]: np.array(r["n"], float) for r in _votes(rows, ["declared"], n).collect()}  # a row per language and two
    n_suffix = suffixes.count()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            like, host, domain, suffix = (np.stack([np.asarray(x.as_py(), float) for x in batch.column(i)]) for i in (3, 5, 6, 7))
            vote, spoken = batch.column(4).to_numpy(), batch.column(2).to_pylist()
            own = (vote[:, None] == np.arange(n)[None]).astype(float)  # a page's own vote
            world = every - own
            p = (world + 1) / (world + 1).sum(1, keepdims=True)
            for level in (domain - own, host - own):
                p = (level + strength * p) / (level.sum(1, keepdims=True) + strength)
            markup = np.stack([says[d] for d in spoken]) - own
            total = like + np.log(p) + np.log((markup + 1) / (world + len(says))) + np.log((suffix - own + 1) / (world + n_suffix))
            best = total.argmax(1)
            chance = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            names = np.array(languages, object)
            seen = pa.array([languages[v] if v >= 0 else None for v in vote.tolist()], pa.string())
            yield batch_of(page_id=batch.column(0), lang=pa.array(names[best].tolist(), pa.string()), probability=chance, text_lang=seen, declared=batch.column(2))

    fused = rows.join(priors, "host").select("page_id", "host", "declared", "text", "vote", "suffix", "host_n", "domain_n", "suffix_n")
    fused = fused.select("page_id", "host", "declared", "text", "vote", "host_n", "domain_n", "suffix_n")
    return fused.mapInArrow(run, f"page_id {kind}, lang string, probability double, text_lang string, declared string")
