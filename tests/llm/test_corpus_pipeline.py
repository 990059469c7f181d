"""The pipeline on a small planted table, and each stage on odd input."""

import random

import pytest

import corpus_pipeline
from tallyfolio.llm import mixture

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(200), "en", f"s{i % 3}", 0) for i in range(120)]
    docs += [(500 + i, " ".join(rng.choice(words) + "%%%" for _ in range(200)), "en", "s0", 0) for i in range(30)]
    docs += [(600, docs[0][1], "en", "s1", 0), (601, docs[1][1] + " end", "en", "s1", 0)]
    item = text(40)
    docs += [(700, text(100) + " " + item + " " + text(100), "en", "s2", 0), (701, "write to me@mail.example.com " + text(150), "en", "s2", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(not 500 <= i < 600), 0) for i, *_ in docs if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], folder).cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    good = {i for i in ids[0] if not 500 <= i < 600}
    assert len(ids[1] & good) >= len(good) - 2 and len(ids[1] - good) <= 1
    assert ids[1] - ids[2] <= {600, 601} and 0 in ids[2] and 1 in ids[2] and 600 not in ids[2]
    assert ids[2] - ids[3] == {700}
    assert ids[4] == ids[3] and [r.text for r in seen[4].where("doc_id = 701").collect()][0].startswith("write to [EMAIL] ")
    assert ids[5] == ids[4]
    final = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, folder).collect()}
    assert final == {(r.doc_id, r.taken) for r in seen[5].collect()} == {(r.doc_id, r.taken) for r in mixture.mix(seen[4]).collect()}


def test_stages_on_odd_and_empty_tables(spark, folder):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "text without an id", None, "s", 18), (3, "a " * 20000, "en", None, 40000), (4, "same text here", "en", "s", 14), (5, "same text here", "en", "s", 14)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_rows_with_repeated_and_missing_ids(spark, folder):
    """Rows are told apart by their place: no clean row is lost for its id, no dirty one kept for want of one."""
    rng = random.Random(12)
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one, two, three = text(150), text(150), text(150)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rows = [(5, one), (5, two), (5, one), (None, three), (None, three), (7, three), (None, two), (8, text(90) + " " + item), (None, text(90) + " " + item), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["SimHash near-dedup"](spark, docs, folder)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id, (r.text or "")[:20]) for r in kept.collect())
    want = [(False, 5, one), (False, 5, two), (False, 7, three), (False, 8, rows[7][1]), (True, None, rows[8][1]), (False, 9, "")]
    assert got == sorted((a, b, t[:20]) for a, b, t in want)
    left = stages["benchmark decontamination"](spark, docs, folder)
    assert sorted(r.n_chars for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 10]
