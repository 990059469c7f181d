"""Operators 11 to 13 against brute force, and the defined result of odd input."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyfolio.llm import bpe, divergence, periods
from tallyfolio.llm.common import Texts
from tallyfolio.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs int, ids string, n int, k long, p double, rank int, value string, part int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source); the other columns clash with the operators' own names."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 0.5, 6, "y", 7) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ünd", "THE", "the", "日本", "😀", "İ", "<|endoftext|>", "it's", "é"]
    rows = [(0, None, None, None), (1, "", "en", "b"), (2, " \n\t\x0b ", "en", None), (3, "one", None, "a"), (4, "x " * 9000, "de", "b"), (None, "a b a b a b a b", "en", "a"), (None, None, None, None)]
    for i in range(5, 130):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        if i % 3 == 0:
            words += words[-rng.randrange(1, 6) :] * rng.randrange(1, 8)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None])))
    return [*rows, rows[10], rows[10], rows[10]]


@pytest.fixture(scope="module")
def folder(spark, odd_rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("new")
    table(spark, odd_rows).write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length, part = j - i + q, w[i : j + q]
            if j > i and length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def brute_periodic(doc, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        size, letters = rng.randrange(0, 60), rng.choice([1, 2, 2, 3, 5])
        w = []
        while len(w) < size:
            w += [rng.randrange(letters) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 7)
        want = brute_runs(w)
        assert periods.runs_of(w) == want
        h = np.array([zlib.crc32(bytes([x])) * 2654435761 for x in w], np.uint64)
        parts = periods.stretches(h, np.zeros(len(w), np.int64))
        assert sorted((lo + s, n, q) for lo, hi in parts for s, n, q in periods.runs_of(w[lo:hi])) == want


def test_long_runs_take_linear_time():
    assert periods.runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    assert periods.runs_of(list(range(700)) * 100) == [(0, 70_000, 700)]
    nested = (["a"] * 10 + ["b"]) * 2000
    assert periods.runs_of(nested)[0] == (0, 10, 1) and (0, 22_000, 11) in periods.runs_of(nested)


def test_op11_against_brute_force(spark, folder, odd_rows):
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, folder).collect()), key=repr)
    assert got == sorted((brute_periodic(i, t) for i, t, *_ in odd_rows), key=repr)
    assert sum(r[1] for r in got) > 20


def test_op11_empty_table_and_order(spark):
    empty = table(spark, [])
    assert periods.digests(periods.find(empty)).count() == 0
    one = periods.find(table(spark, [(1, "a b c", None, None)]), order=lambda doc, n: np.zeros(n * 3, np.int64)[:n]).first()
    assert one.collapsed == "a a a" and one.runs == []


# op12


def test_chunks_of_hostile_texts(monkeypatch):
    rng = random.Random(3)
    parts = ["hello", "World", "it's", "́", "e", "é", "Å", "ﬁ", "<|endoftext|>", "<|start", "oftext|>", "<|", " ", "  ", "\n", "\t", " ", " ", "\x0b", "\x0c", "\r", "\x1c", "\x85"]
    parts += ["123", "１２", "日本語", "한", "한", "ΣΑΣ", "İ", "!!!", "'", "'s", "…", "😀", "👨‍👩‍👧", "ß", "ẞ", "</w>", "\u0000"]
    monkeypatch.setattr(bpe, "EVERY", 5)
    monkeypatch.setattr(bpe, "SPAN", 3)
    whole, code = bpe.tokenizer(bpe.VOCABULARY), bpe.Encoder(bpe.VOCABULARY, 20_000, 20_000)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(20)]
        for text, ids in zip(texts, code.block(Texts(pa.array(texts))), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_equal_passages_have_equal_chunks():
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(1000)}" for _ in range(2000)).encode()
    one, two = np.frombuffer(b"some words " + passage, np.uint8), np.frombuffer(b"other text before it " + passage, np.uint8)
    a, b = bpe.cuts_of(one) - 11, bpe.cuts_of(two) - 21
    assert len(a) > 10 and set(a[a > bpe.SPAN]) == set(b[b > bpe.SPAN])


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 200_000, "é" * 100_000, "ab " * 300_000])
def test_long_texts(text):
    ids = bpe.Encoder(bpe.VOCABULARY).block(Texts(pa.array([text, "x"])))
    assert np.frombuffer(ids[0], np.uint32).tolist() == bpe.tokenizer(bpe.VOCABULARY).encode(text, add_special_tokens=False).ids


def test_memory_keeps_what_recurs():
    memory = bpe.Memory(2000)
    for i in range(100):
        memory.put(b"k%d" % i, b"v")
        assert memory.get(b"k0") is not None
    assert memory.get(b"k1") is None and len(memory.new) + len(memory.old) < 30


def test_op12_against_the_library(spark, folder, odd_rows):
    whole = bpe.tokenizer(bpe.VOCABULARY)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc, text, *_ in odd_rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, QUERIES["op12_bpe_chunks"](spark, folder).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(table(spark, []))).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r.decoded for r in bpe.decode(nulls).orderBy("doc_id").collect()] == ["", ""]


# op13


def duck(sql, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("least", [1, 3, 10, 1000])
def test_op13_against_sql(spark, folder, least, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST", least)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sql = divergence._SQL.replace("LEAST_DOCS", str(least)).replace("TOP_TERMS", "10")
    got = [tuple(r) for r in divergence.audit(docs).collect()]
    assert sorted(got) == sorted(duck(sql, folder))
    assert len(got) > 20 and (least < 1000 or not any(r[4] for r in got))


def test_op13_terms_and_small_blocks(spark, folder, monkeypatch):
    assert divergence._TERM.findall("Ab-c1É日_x\x7f\x00É".encode().lower()) == [b"ab", b"c", "É日".encode(), b"x", "É".encode()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(map(tuple, divergence.audit(docs).collect()))
    assert divergence.audit(docs.limit(0)).count() == 0
    _, postings = divergence.index(docs)
    rows = postings.where("lang = 'en'").orderBy("term").toPandas()
    term, k, p, p0 = rows["term"].factorize()[0], *(rows[c].to_numpy() for c in ("k", "p", "p0"))
    sums = {own: v for own, v in divergence.rows_of(term, k, p, p0)}
    for g in sums:
        for h in sums:
            both = [(a, a0, b, b0) for t, i, a, a0 in zip(term, k, p, p0, strict=True) if i == g for u, j, b, b0 in zip(term, k, p, p0, strict=True) if u == t and j == h]
            f = lambda x, y: (int(x) - int(y)) ** 2 // (int(x) + int(y))
            assert sums[g][h] == sum(f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0) for a, a0, b, b0 in both)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert want == sorted(map(tuple, divergence.audit(docs).collect()))
