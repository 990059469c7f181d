"""Price table: pruning, upserts, failures; strategy documents from files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyfolio.sources import price_store, strategy

DAY = dt.date(2024, 1, 1)


def prices(spark, rows):
    return spark.createDataFrame([(t, DAY + dt.timedelta(days=d), float(c), s) for t, d, c, s in rows], "ticker string, date date, close double, load_seq int")


def content(spark, path):
    return {(r.ticker, r.date): (r.close, r.load_seq) for r in price_store.scan_prices(spark, path).collect()}


def parts(path):
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in path.iterdir() if p.is_dir()}


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "prices"
    price_store.write_prices(prices(spark, [(f"T{i}", d, i, 1) for i in range(60) for d in range(5)] + [("T1", 0, 9, 0)]), str(path), buckets=16)
    before = parts(path)
    assert len(before) > 8 and content(spark, str(path))["T1", DAY] == (1.0, 1)
    new = prices(spark, [("T1", 0, 7, 2), ("T1", 9, 8, 2), ("", 0, 1, 2), (None, 0, 1, 2), ("T2", 1, 5, 0)])
    price_store.upsert_prices(new, str(path), buckets=16)
    after, got = parts(path), content(spark, str(path))
    assert 1 <= sum(before[p] != after[p] for p in before) <= 2
    assert got["T1", DAY] == (7.0, 2) and got["T1", DAY + dt.timedelta(days=9)] == (8.0, 2) and got["T2", DAY + dt.timedelta(days=1)] == (2.0, 1) and len(got) == 301
    price_store.upsert_prices(new, str(path), buckets=16)
    assert content(spark, str(path)) == got
    price_store.upsert_prices(new.limit(0), str(path), buckets=16)
    assert content(spark, str(path)) == got


def test_failed_upsert_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "prices")
    price_store.write_prices(prices(spark, [(f"T{i}", 0, i, 1) for i in range(30)]), path, buckets=8)
    before = content(spark, path)
    bad = prices(spark, [(f"T{i}", 0, 99, 2) for i in range(30)]).withColumn("close", F.when(F.col("ticker") == "T7", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        price_store.upsert_prices(bad, path, buckets=8)
    assert content(spark, path) == before


def test_scan_prunes_partitions_and_pushes_days(spark, tmp_path):
    path = str(tmp_path / "prices")
    price_store.write_prices(prices(spark, [(f"T{i}", d, i, 1) for i in range(60) for d in range(5)]), path, buckets=16)
    wanted = spark.createDataFrame([("T3",), ("T3",), ("none",), (None,)], "ticker string")
    out = price_store.scan_prices(spark, path, wanted, DAY, DAY + dt.timedelta(days=1), buckets=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "GreaterThanOrEqual(date" in plan
    assert {(r.ticker, r.date) for r in out.collect()} == {("T3", DAY), ("T3", DAY + dt.timedelta(days=1))}
    fx = price_store.scan_fx(spark, path, spark.createDataFrame([(" eur ",)], "currency string"), DAY, DAY, buckets=16)
    assert [tuple(r) for r in fx.collect()] == [("EUR", DAY, 1.0)]


def test_strategy_files(spark, tmp_path):
    texts = {"a": json.dumps({"strategy": {"target_etf_pct": 60, "target_non_etf_pct": "30", "target_cash_pct": 10, "target_currency_pct": {"usd": 40}}}, indent=2), "b": "{", "c": '{"max_pair_correlation": 0.5, "target_style_pct": 3}', "d": "[]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = strategy.read_strategies(spark, f"{tmp_path}/*.json")
    got = {r.path[-6]: r for r in good.collect()}
    assert set(got) >= {"a"} and got["a"].target_etf_pct == 60 and got["a"].target_currency_pct == {"usd": 40.0}
    assert {r.path[-6] for r in bad.collect()} | set(got) == {"a", "b", "c", "d"} and {"b", "d"} <= {r.path[-6] for r in bad.collect()}
    strategy.write_strategy(good.where(F.col("path").endswith("a.json")).drop("path"), f"{tmp_path}/out")
    back, none = strategy.parse_documents(spark.read.text(f"{tmp_path}/out").withColumnRenamed("value", "text"), ())
    assert back.first().asDict() == {k: v for k, v in got["a"].asDict().items() if k != "path"} and none.count() == 0


def test_rows_over_block_borders(spark, tmp_path):
    """Files cut into blocks of a few bytes against the parse of the whole text."""
    import csv
    import io
    import random

    from tallyfolio.sources import exports

    rng, files = random.Random(3), {}
    cells = ["a", "", " b ", '"q"', '"x""y"', '"two\nlines"', '"three\n\n""lines"""', 'in"side', '"sep, ; \t"', '"é"', '"end" tail', '""', "1,5"]
    for n in range(6):
        sep = rng.choice([",", ";", "\t"])
        rows = [sep.join(["Date", "Note", "Amount"])] + [sep.join(rng.choice(cells[:-1]) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
        rows = [r if r.strip() else sep * 2 for r in rows]
        files[f"f{n}"] = (sep, ("﻿" if n == 1 else "") + "\n".join(rows) + ("\n" if n % 2 else ""), "latin-1" if n == 2 else "utf-8")
    files["open"] = (",", 'a,b\n1,"never closed\nx,y\n', "utf-8")
    for name, (_, text, encoding) in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    want = {}
    for name, (sep, text, _) in files.items():
        kept, width = [], 0
        for raw in csv.reader(io.StringIO(text.lstrip("﻿")), delimiter=sep):
            width = width or len(raw)
            fitted = exports.fit_row(raw, width, sep)
            if not kept or any(fitted):
                kept.append(fitted)
        want[name] = kept
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c, x in zip(before, ("97", "1"), strict=True):
            spark.conf.set(c, x)
        found = exports.read_rows(spark, f"{tmp_path}/*.csv").collect()
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    got = {}
    for r in sorted(found, key=lambda r: r.row_seq):
        got.setdefault(r.path.split("/")[-1][:-4], []).append((r.row_seq, [c.rstrip("\n") for c in r.cells]))
    for name, rows in want.items():
        assert got[name] == [(i, [c.rstrip("\n") for c in r]) for i, r in enumerate(rows)], name


def test_many_tails_of_one_row(spark):
    """10^5 continuation rows of one row, and a row after them."""
    from tallyfolio.sources import exports

    n = 100_000
    tail = F.array(F.lit(""), F.lit(""), *[F.when(F.col("id") % 3 == k, F.concat(F.lit(f"{name}"), F.col("id"))).otherwise("") for k, name in enumerate("pdo")])
    tails = spark.range(2, n + 2).select(F.lit("/x/A/Account.csv").alias("path"), F.col("id").alias("row_seq"), tail.alias("cells"))
    fixed = [(0, ["Date", "Time", "Product", "Description", "Order Id"]), (1, ["01-02-2024", "10:00", "P", "D", "O"]), (n + 2, ["02-02-2024", "10:00", "Q", "E", ""])]
    rows = tails.unionByName(spark.createDataFrame([("/x/A/Account.csv", i, c) for i, c in fixed], "path string, row_seq long, cells array<string>"))
    got = {r.row_seq: r.cells for r in exports.repair_rows(rows.repartition(5)).collect()}
    ids = range(2, n + 2)
    assert set(got) == {0, 1, n + 2} and got[n + 2][2] == "Q"
    assert got[1][2] == " ".join(["P", *[f"p{i}" for i in ids if i % 3 == 0]]) and got[1][3] == " ".join(["D", *[f"d{i}" for i in ids if i % 3 == 1]])
    assert got[1][4] == "".join(["O", *[f"o{i}" for i in ids if i % 3 == 2]])
