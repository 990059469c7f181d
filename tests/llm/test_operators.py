"""Small cases for the other operators: brute force, and the defined result of odd input."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallyfolio.llm import contextmix, importance, langid, ledger, lengths, mixture, suffixes, tiling

# the operators' own column names, as extra columns of the table
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size string, n int, seeds string, failed string, target double, log_weight string, part long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source)"""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "x", 2, "y", "z", 0.5, "w", 7) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["é", "Ünd", "THE", "the", "日本", "😀"]
    rows = [(0, None, None, None), (1, "", "en", "b"), (2, " \n\t ", "en", None), (3, "one", None, "a"), (4, "x " * 9000, "de", "b"), (None, "no id at all", "en", "a"), (None, None, None, None)]
    for i in range(5, 60):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None])))
    return [*rows, rows[10], rows[10], rows[10]]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return table(spark, odd_rows).cache()


# op1


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, key string")


def test_importance_finds_junk(spark):
    rng = random.Random(1)
    words = [a + b for a in "abcdefgh" for b in "xyzuvw"]
    good = [(i, " ".join(rng.choice(words) for _ in range(150)), "en", "s") for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choice(words) + rng.choice(["%%%", "$$$"]) for _ in range(150)), "en", "s") for i in range(40)]
    docs = table(spark, good + bad)
    labels = labels_of(spark, [(i, int(i < 1000), 0, "k") for i, *_ in good + bad if i % 2])
    got = {r.doc_id: r.kept for r in importance.sample(docs, labels).collect()}
    assert len(got) == 240
    assert sum(got[i] for i, *_ in good) >= 198 and sum(got[i] for i, *_ in bad) <= 2
    kept = importance.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_importance_of_odd_tables(spark, odd, odd_rows):
    none = labels_of(spark, [])
    assert importance.sample(odd, none).where("kept").count() == len(odd_rows)
    nulls = labels_of(spark, [(None, 1, 0, None), (5, None, None, None), (6, 1, 1, None), (7, 0, 0, None), (8, 0, 0, None), (9, 1, 0, None)])
    assert importance.sample(odd, nulls).count() == len(odd_rows)
    assert importance.keep(odd.limit(0), nulls).count() == 0
    assert {r.kept for r in importance.sample(odd, nulls).collect() if r.doc_id == odd_rows[10][0]} in ({True}, {False})


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 100) for _ in range(500)] + [3.25] * 50
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 77, 300, 549, 550):
        assert importance.kth_largest(keys, k, bins=7) == (sorted(values)[-k] if k < 550 else -math.inf)


# op2


def test_lengths(spark, odd, odd_rows):
    want = Counter(lengths.length_of(t) for _, t, *_ in odd_rows)
    assert lengths.length_of("a<|endoftext|>b") > 2
    sums = lengths.with_suffix_sums(lengths.histogram(odd)).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == want
    all_lengths = sorted(want.elements())
    for n, r in got.items():
        assert r.docs_from == sum(x >= n for x in all_lengths) and r.tokens_from == sum(x for x in all_lengths if x >= n)
        assert r.docs_over == sum(x > n for x in all_lengths) and r.tokens_at_limit == sum(min(x, n) for x in all_lengths)
    for r in lengths.at_limits(sums, [1, 7, 100, 10**6]).collect():
        assert r.tokens_at_limit == sum(min(x, r.limit) for x in all_lengths) and r.docs_over == sum(x > r.limit for x in all_lengths)
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == all_lengths[math.ceil(r.share * len(all_lengths)) - 1]
    assert sorted(r.n_tokens for r in lengths.encoded_lengths(odd).collect()) == all_lengths
    assert lengths.with_suffix_sums(lengths.histogram(odd.limit(0))).count() == 0


# op3


def slow_repeats(rows, least):
    """Words of each document in a window of `least` words that another document has too."""
    where = defaultdict(set)
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts[i] = [w.lower() for w in WORDS.findall(t or "")]
    for i, w in texts.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                out[i].update(range(k, k + least))
    return out


def test_repeats(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 70, 200)]
    rows = []
    for i in range(60):
        words = fresh(rng.randrange(5, 150))
        if i % 3:
            p = passages[i % 4]
            words += p + fresh(rng.randrange(0, 40))
        rows.append((i, " ".join(words), "en", "s"))
    short = fresh(48)
    rows += [(100, " ".join(fresh(20) + short), "en", "s"), (101, " ".join(short + fresh(30)), "en", "s")]
    rows += [(110, "again " * 300, "en", "s"), (None, " ".join(passages[0]), None, None), (111, None, None, None), (1, rows[1][1], "en", "s")]
    got = defaultdict(set)
    for r in suffixes.repeats(table(spark, rows)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == slow_repeats(rows, 50)
    assert suffixes.repeats(table(spark, [])).count() == 0


# op5


def test_declaration_after_a_long_comment():
    banner = b"<!-- <html lang='fr'> " + b"licence " * 1250 + b"-->"
    assert langid.declared(banner + b"<html class=a lang='de'><p>x") == "de"
    assert langid.declared(b"\n" * 9000 + b"<HTML lang=en>") == "en"
    assert langid.declared(banner + b"<html><p>x") == langid.declared(None) == ""


def test_languages(spark):
    en, de = "the cat and the dog are in the house with them", "der hund und die katze sind nicht in dem haus mit"
    docs = table(spark, [(1, en * 20, "en", "s"), (2, de * 20, "de", "s"), (3, None, "de", "s"), (4, "x", None, "s")])
    rows = [(i, f"http://a{i % 3}.example.de/x", f"<html lang='de'><script>{en}</script><body>{de}</body></html>", "x") for i in range(12)]
    rows += [(100 + i, f"https://u@b.example.com:80/{i}", f'<html lang="en"><p>{en}</p></html>', "x") for i in range(12)]
    rows += [(200, "http://a1.example.de/", None, None), (201, "http://b.example.com", "", None), (202, None, "<p>" + de, None), (203, "odd", "<html lang=xx>" + en, None), (None, None, None, None), (200, "http://a1.example.de/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = defaultdict(list)
    for r in langid.identify(pages, docs).collect():
        got[r.page_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert {got[i][0].lang for i in range(12)} == {"de"} and {got[100 + i][0].lang for i in range(12)} == {"en"}
    assert [r.lang for r in got[200]] == ["de", "de"] and got[201][0].lang == "en"  # the host and the suffix decide
    assert got[202][0].lang == "de" and got[203][0].declared == "?" and got[203][0].lang == "en"
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


# op6


def test_base_score_and_held_out(spark, odd, odd_rows):
    got = contextmix.score(odd, head=8).collect()  # most tokens take the join
    tokens = lambda t: [*("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORDS.findall(t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, t, *_ in odd_rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in odd_rows:
        x = tokens(t)
        want[i, held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.n_bytes == len((t or "").encode()) + 1 for r in got for i, t, *_ in odd_rows if i == r.doc_id and i is not None)
    assert contextmix.score(odd.limit(0)).count() == 0


def test_model_is_a_distribution_and_learns(spark):
    rng = random.Random(6)
    syllables = ["ba", "ko", "ti", "re", "un"]
    rows = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(80)), "en", "s") for i in range(120)]
    got = contextmix.score(table(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(-r.score for r in held) * math.log2(10) / sum(r.n_bytes for r in held) < 2.2
    # the probabilities of all continuations of a context add up to one
    model = contextmix.Model([np.random.default_rng(1).integers(0, 9, (2, s)).astype(np.float32) for s in contextmix.SLOTS])
    model.set_map(np.arange(256 * 33.0) % 5, np.full(256 * 33, 9.0))
    w = np.uint64(0x6162632000) + np.arange(256, dtype=np.uint64)
    assert abs((10 ** model.log10(w, np.full(256, 77, np.uint64))).sum() - 1) < 1e-9


# op7


def test_weights_are_learnt_from_all_training_documents(spark, odd, odd_rows, monkeypatch):
    seen, train = [], contextmix.train
    monkeypatch.setattr(contextmix, "train", lambda docs, *more: seen.append(docs.count()) or train(docs, *more))
    contextmix.score(odd)
    assert seen == [sum(i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in odd_rows)]
    # places are learnt with their full counts, also where a table has no room for them
    rng = np.random.default_rng(2)
    met, got, want = contextmix.Places(size=64, most=100), Counter(), Counter()
    for _ in range(20):
        w, p = rng.integers(1, 30, 300).astype(np.uint64), rng.integers(1, 9, 300).astype(np.uint64)
        n = rng.integers(1, 5, 300)
        for a, b, c in zip(w.tolist(), p.tolist(), n.tolist(), strict=True):
            want[a, b] += c
        for some in met.add(w, p, n):
            for a, b, n in zip(*some, strict=True):
                got[int(a), int(b)] += int(n)
    for some in met.last():
        for a, b, n in zip(*some, strict=True):
            got[int(a), int(b)] += int(n)
    assert got == want


def test_model_holds_every_word(spark, odd, monkeypatch):
    scores = lambda: sorted((r.doc_id or -1, r.n_bytes, round(r.score, 6)) for r in contextmix.score(odd, head=4).collect())
    few = scores()
    assert few == sorted((r.doc_id or -1, r.n_bytes, round(r.score, 6)) for r in contextmix.score(odd).collect())
    # every letter of every training token is counted in the word contexts, whatever the number of slots
    found = contextmix.counted(odd, "text").cache()
    letters = sum((len(r.token) + 1) * r.n for r in found.where("kind = 0").collect() if len(r.token))
    for slots in (1 << 14, 1 << 21):
        counters = contextmix.counters_of(found, [*contextmix.SLOTS[:4], slots])
        assert counters[4].sum() == 8 * letters and counters[3].sum() == 8 * found.where("kind = 1").groupBy().sum("n").first()[0]
    # slots grow with the number of contexts
    monkeypatch.setattr(contextmix, "SLOTS", (1 << 16, 1 << 8, 1 << 8, 1 << 8, 1 << 8))
    monkeypatch.setattr(contextmix, "MOST_SLOTS", 1 << 12)
    assert contextmix.slot_sizes(found.limit(0)) == [1 << 16] + [1 << 8] * 4
    assert contextmix.slot_sizes(found)[3:] == [1 << 12] * 2


def test_grams_over_the_bound_are_compared_whole(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    line = fresh(30)
    lefts, rights = [fresh(25) for _ in range(20)], [fresh(25) for _ in range(20)]
    rows = []
    for i in range(160):  # all share the line; some share words to its left or right too, or both in part
        left = fresh(15) + lefts[i % 20][5:] if i % 3 else fresh(40)
        right = rights[i * 7 % 20][: rng.randrange(5, 25)] if i % 2 else []
        rows.append((i, " ".join([*left, *line, *right, *fresh(20)]), "en", "s"))
    rows += [(300, " ".join(line * 12), "en", "s"), (301, " ".join(line * 9), "en", "s")]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for hold in (3, 20, 50_000):
            got = defaultdict(set)
            for r in suffixes.repeats(table(spark, rows), hold=hold).collect():
                got[r.doc_id].update(range(r.start_word, r.end_word))
            assert got == slow_repeats(rows, 50), hold
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_reordered_passages_are_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [[word() for _ in range(40)] for _ in range(20)]
    benchmark = spark.createDataFrame([(i, " ".join(x), "s") for i, x in enumerate(items)] + [(90, None, None), (91, "", None), (92, "too few words", None), (None, None, None)], "item_id long, text string, seeds string")
    cut = items[3][25:] + [word()] + items[3][:12] + [word()] + items[3][12:25]
    half, less = items[4][:20], items[5][:19]
    noise = lambda n: [word() for _ in range(n)]
    texts = {1: noise(30) + items[2] + noise(9), 2: cut, 3: noise(40) + half, 4: noise(40) + less, 5: noise(300), 6: [w.upper() + "," for w in items[6]] + items[7]}
    docs = table(spark, [(i, " ".join(t), "en", "s") for i, t in texts.items()] + [(7, None, None, None), (1, " ".join(texts[1]), "en", "s"), (None, " ".join(items[8]), None, None)])
    got = {(r.doc_id, r.item_id): (round(r.coverage, 6), r.n_tiles) for r in tiling.leaks(docs, benchmark).collect()}
    assert got == {(1, 2): (1.0, 1), (2, 3): (1.0, 3), (3, 4): (0.5, 1), (6, 6): (1.0, 1), (6, 7): (1.0, 1), (None, 8): (1.0, 1)}
    clean = tiling.clean(docs, benchmark)
    assert clean.columns == docs.columns and sorted((r.doc_id or 0) for r in clean.collect()) == [4, 5, 7]
    assert tiling.leaks(docs.limit(0), benchmark).count() == 0 and tiling.leaks(docs, benchmark.limit(0)).count() == 0


def slow_tiles(a, b, least):
    used_a, used_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        total += n


def test_tiling_equals_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        b = [rng.randrange(1, 60) for _ in range(rng.randrange(0, 40))]
        a = []
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            a += b[i : i + rng.randrange(20)] + [0]
        got = tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        assert sum(n for *_, n in got) == slow_tiles(a, b, 3)


# op9


def test_ledger(spark, odd, odd_rows):
    more = [(300, "a b c\na b c\n \nA B c\n x", "en", "s"), (301, "w " * 60, "en", "s"), (302, "SHOUT LOUD " * 30, "en", "s"), (303, " ".join(f"tok{i} |" for i in range(60)), "en", "s")]
    rows = odd_rows + more
    ledger_rows = ledger.measure(table(spark, rows)).cache()
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        words, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        want[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in ledger_rows.collect()) == want
    verdict = {r.doc_id: r for r in ledger.verdicts(ledger_rows).collect()}
    assert not verdict[300].kept and verdict[301].base_failed and not verdict[302].kept and not verdict[303].kept and not verdict[303].base_failed
    removed = {r.rule: (r.n_failed, r.n_only) for r in ledger.ablation(ledger_rows).collect()}
    bits = [r.failed for r in ledger_rows.collect()]
    for i, rule in enumerate(ledger.RULES):
        assert removed.get(rule, (0, 0)) == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    assert ledger.measure(odd.limit(0)).count() == 0


# op10


def test_mixture(spark, odd, odd_rows):
    got = mixture.mix(odd).select("doc_id", "size", "source_size", "target", "taken").collect()
    frame = odd.select("doc_id", "text", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("frame", frame)
    want = con.execute(mixture.ORACLE.replace("{documents}", "(SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM frame)")).fetchall()
    rounded = lambda rows: Counter((*r[:3], round(r[3], 6), r[4]) for r in rows)
    assert rounded(map(tuple, got)) == rounded(want)
    assert all(r.taken <= 3 * r.size for r in got)
    taken, target = Counter(), {}
    for r in mixture.mix(odd).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(0 <= target[s] - taken[s] < 1 for s in target)
    assert mixture.mix(odd.limit(0)).count() == 0


def test_targets_are_reshared_until_none_is_above(spark):
    rng = random.Random(9)
    for _ in range(6):
        sizes = [(f"s{i:02}", rng.choice([0, 1, 5, 100, 5000])) for i in range(rng.randrange(1, 9))] + [(None, 7)]
        weight = {s: (1, 2, 3)[i % 3] for i, (s, _) in enumerate(sizes)}
        size, open_, want = dict(sizes), {s for s, _ in sizes}, {}
        left = sum(size.values())
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * size[s]}
            if not over:
                want |= share
                break
            for s in over:
                want[s] = 3 * size[s]
                left -= want[s]
            open_ -= over
        got = {r.source: r.target for r in mixture.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        assert got == pytest.approx(want)
