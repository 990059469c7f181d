"""Steps whose tasks and shuffles must not grow faster than the input."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfolio import session
from tallyfolio.operators import costbasis, fx_repair, holdings, ranks
from tallyfolio.plans import catalog
from tallyfolio.plans.sample_views import SampleViews
from tallyfolio.sources import exports, price_store

SAMPLE = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def by_hand(trades):
    """Open quantity and cost after each trade, trade by trade."""
    out, held, cost = [], 0.0, 0.0
    for quantity, spend in trades:
        if quantity > 0:
            held, cost = held + quantity, cost + spend
        else:
            left = max(held + quantity, 0.0)
            cost = cost * (left / held) if held > 0 else 0.0
            held = left
        if held <= 1e-9:
            held, cost = 0.0, 0.0
        out.append((held, cost))
    return out


def test_tasks_follow_rows(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.tasks_for(spark, 0) == 1
    assert session.tasks_for(spark, 10 * n * session.TASK_ROWS) == 10 * n


@pytest.mark.parametrize("large", [1 << 18, 8])
def test_cost_basis_of_small_and_large_keys(spark, monkeypatch, large):
    monkeypatch.setattr(costbasis, "LARGE", large)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, n in (("A", 40), ("B", 5), ("C", 1)):
        trades = [(float(q), float(abs(q) * 3 + i)) for i, q in enumerate(rng.integers(-6, 9, n)) if q]
        want[key] = by_hand(trades)
        rows += [(key, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, q, -s) for i, (q, s) in enumerate(trades)]
    rows.append((None, dt.datetime(2024, 1, 1), 0, 1.0, -1.0))
    tx = spark.createDataFrame(rows, "instrument_id string, datetime timestamp_ntz, row_seq int, quantity double, total_eur double").withColumn("fees_eur", F.lit(0.0))
    got = {}
    for r in costbasis.trade_cost_basis(tx).orderBy("instrument_id", "row_seq").collect():
        got.setdefault(r["instrument_id"], []).append((r["open_quantity"], r["cost_basis_eur"]))
    assert got.keys() == want.keys()
    for key in want:
        np.testing.assert_allclose(got[key], want[key], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("large", [1 << 18, 8])
def test_equal_trades_count_each(spark, monkeypatch, large):
    monkeypatch.setattr(costbasis, "LARGE", large)
    rows = [(f"I{i % 5}", dt.datetime(2024, 1, 1 + n // 2), n // 2, 3.0, -2.0) for i in range(5) for n in range(20)]
    tx = spark.createDataFrame(rows, "instrument_id string, datetime timestamp_ntz, row_seq int, quantity double, total_eur double").withColumn("fees_eur", F.lit(0.0))
    daily = {(r["instrument_id"], r["date"].day): (r["open_quantity"], r["cost_basis_eur"]) for r in costbasis.daily_cost_basis(tx).collect()}
    assert daily == {(f"I{i}", d): (6.0 * d, 4.0 * d) for i in range(5) for d in range(1, 11)}


def test_cost_basis_sorts_parts_of_bounded_size(spark):
    tx = spark.range(20).select(
        F.lit("A").alias("instrument_id"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("datetime"), F.col("id").alias("row_seq"),
        F.lit(1.0).alias("quantity"), F.lit(-1.0).alias("total_eur"), F.lit(0.0).alias("fees_eur"),
    )
    assert "REPARTITION_BY_NUM" in plan_of(costbasis.open_cost_basis(tx))


@pytest.mark.parametrize("large", [1 << 19, 3])
def test_ranks_of_small_and_large_keys(spark, monkeypatch, large):
    monkeypatch.setattr(ranks, "LARGE", large)
    rows = [(k, float(i * 7 % 11), i) for k, n in (("A", 9), ("B", 2), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = {(r["k"], r["i"]): r["n"] for r in ranks.numbered(df, ["k"], [F.col("v").desc(), F.col("i")], "n").collect()}
    want = {}
    for key in ("A", "B", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want |= {(key, r[2]): n for n, r in enumerate(own, 1)}
    assert got == want


def test_small_keys_are_ranked_where_they_are_dealt(spark):
    df = spark.range(50).select((F.col("id") % 5).alias("account_label"), (F.col("id") % 2 == 0).alias("is_etf"), "id")
    ranked = ranks.numbered(df, ["account_label", "is_etf"], [F.col("id")], "n", by=["account_label"])
    assert plan_of(ranked.groupBy("account_label").count()).count("Exchange ") == 1


@pytest.mark.parametrize(
    "name",
    ["trim_actions", "action_required", "holdings_report", "over_target_flags", "holdings_catalog", "next_steps", "correlated_pairs", "strategy_checks", "spread_action_plan"],
)
def test_reported_holdings_are_built_once(spark, monkeypatch, name):
    built, make = [], SampleViews._quantities
    monkeypatch.setattr(SampleViews, "_quantities", lambda self: built.append(1) or make(self))
    catalog.QUERIES[name](spark, SAMPLE)
    assert len(built) == 1


def test_aggregated_holdings_move_once_behind_the_join(spark):
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views = SampleViews(spark, SAMPLE)
        held = views.snapshot().where("NOT is_cash_like")
        more = plan_of(holdings.aggregate_holdings(held, per_account=False)).count("Exchange ") - plan_of(held).count("Exchange ")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert more == 0


def test_prices_are_grouped_in_parts_of_bounded_size(spark):
    assert "REPARTITION_BY_NUM" in plan_of(SampleViews(spark, SAMPLE).prices())


def test_upsert_groups_in_parts_of_bounded_size(spark, monkeypatch, tmp_path):
    plans, loads = [], price_store.latest_loads
    monkeypatch.setattr(price_store, "latest_loads", lambda rows: plans.append(plan_of(rows)) or loads(rows))
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 1), ("B", dt.date(2024, 1, 1), 2.0, 1)], "ticker string, date date, close double, load_seq int")
    price_store.write_prices(rows, str(tmp_path / "prices"), buckets=4)
    price_store.upsert_prices(rows.where("ticker = 'A'").selectExpr("ticker", "date", "9.0 AS close", "2 AS load_seq"), str(tmp_path / "prices"), buckets=4)
    assert "REPARTITION_BY_NUM" in plans[-1]
    got = sorted((r["ticker"], r["close"], r["load_seq"]) for r in price_store.scan_prices(spark, str(tmp_path / "prices")).collect())
    assert got == [("A", 9.0, 2), ("B", 2.0, 1)]


def test_torn_rows_are_dealt_by_block(spark):
    rows = [("/e/P1/Account.csv", 0, ["Date", "Time", "Product", "Description", "Order Id"])]
    rows += [("/e/P1/Account.csv", 2 * i + 1, ["01-01-2024", "10:00", f"p{i}", "d", f"o{i}"]) for i in range(30)]
    rows += [("/e/P1/Account.csv", 2 * i + 2, ["", "", "x", "", ""]) for i in range(30)]
    fixed = exports.repair_rows(spark.createDataFrame(rows, "path string, row_seq long, cells array<string>"))
    assert "REPARTITION_BY_NUM" in plan_of(fixed)
    assert sorted(r["cells"][2] for r in fixed.where("row_seq > 0").collect()) == sorted(f"p{i} x" for i in range(30))


def test_an_exchange_reaches_two_stretches_of_days_at_most(spark):
    days = spark.range(400).select(F.date_add(F.lit(dt.date(1969, 6, 1)), F.col("id").cast("int")).alias("day"))
    near = [F.date_add("day", i) for i in range(-fx_repair.LOOKAROUND_DAYS, fx_repair.LOOKAROUND_DAYS + 1)]
    found = days.select(fx_repair.stretches("day").alias("s"), F.array(*[fx_repair.stretch(d) for d in near]).alias("of_days")).collect()
    assert all(len(r["s"]) <= 2 and set(r["of_days"]) == set(r["s"]) for r in found)
