import random

import pytest

from tallyfolio.llm import simhash
from tallyfolio.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def docs_of(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in texts], schema).repartition(3)


def slow_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in prints:
        for j, y in prints:
            if i < j and (x ^ y).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def texts_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "a b c d e"), (7, "x " * 5000)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 40, 200, 600]))] for _ in range(n // 4)]
    for i in range(8, n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    return out


def test_fingerprint_and_components(spark):
    texts = texts_of(1, 250)
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in texts]
    want = slow_components(prints)
    assert {i: f for i, (f, _) in got.items()} == dict(prints)
    assert {i: c for i, (_, c) in got.items()} == want
    assert len(set(want.values())) < len(texts) - 20


@pytest.mark.parametrize("crowd,segments", [(0, 3), (3, 2), (64, 4)])
def test_links_of_random_fingerprints(spark, crowd, segments):
    """Crowded buckets take another way to the same components."""
    rng = random.Random(crowd)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centers)
    for _ in range(400):
        x = rng.choice(centers)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [simhash._signed(x) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), segments=segments, crowd=crowd)
    for r in edges.collect():
        assert 0 < ((r.a ^ r.b) % 2**64).bit_count() <= 4
    roots = {r.node: r.root for r in components(edges).collect()}
    got = {x: roots.get(x, x) for x in signed}
    assert got == slow_components([(x, x % 2**64) for x in signed])


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(120))
    rows = docs_of(spark, [(5, text), (3, text), (3, text), (9, "something else entirely here"), (None, "no id"), (None, text)])
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 9), (True, 0)]


def test_empty_table(spark):
    none = docs_of(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)]
    roots = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(roots) == 301 and {r.root for r in roots} == {0}
