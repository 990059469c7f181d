"""Findings of round 4: nothing is left out, and no wide table is broadcast or sorted for want of a measured size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyfolio.llm import simhash
from tallyfolio.operators import holdings, performance, timeseries
from tallyfolio.plans import catalog, series_queries
from tallyfolio.plans.sample_views import SampleViews

SAMPLE = "/root/testdata/sf0.001"


def test_holders_are_joined_over_all_portfolios(spark):
    """the labels of all holders, distinct, trimmed and in order, next to their count."""
    rows = [("P2", 1.0), ("P10", 2.0), ("P2", 4.0), (" P1 ", 8.0), ("P1", 16.0), ("", 32.0), (None, 64.0)]
    rows = [(a, "I1", "x", "i", "t", True, "EUR", q, q) for a, q in rows] + [(None, None, "x", None, "t", None, None, 1.0, None)]
    kind = "account_label string, instrument_id string, product string, isin string, ticker string, is_etf boolean, currency string, quantity double, value_eur double"
    got = {r["instrument_id"]: r.asDict() for r in holdings.aggregate_holdings(spark.createDataFrame(rows, kind), per_account=False).collect()}
    assert (got["I1"]["account_label"], got["I1"]["portfolio_count"], got["I1"]["quantity"]) == ("P1, P10, P2", 5, 127.0)
    assert (got[None]["account_label"], got[None]["portfolio_count"], got[None]["value_eur"]) == ("", 0, 0.0)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def unbroadcast(spark, make):
    """What `make` gives while no table is small enough to be broadcast, with as many partitions as the sample has tasks."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "1"}
    saved = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, x in wanted.items():
            spark.conf.set(k, x)
        return make()
    finally:
        for k, x in saved.items():
            spark.conf.set(k, x)


def test_latest_valued_holdings_by_hand(spark):
    """positions that are listed, only held, closed, or without a portfolio or instrument; an instrument known twice."""
    kind = "account_label string, instrument_id string, product string, isin string, ticker string, is_etf boolean, currency string, quantity double, value_eur double"
    listed = [
        ("A", "I1", "x", "i1", "t1", True, "EUR", 2.0, 10.0), ("A", "I1", "y", "i1", "t1", True, "EUR", 4.0, 8.0),
        ("A", "I4", "z", "i4", "t4", False, "EUR", 2.0, 6.0), ("A", None, "n", None, "", None, "", 5.0, 5.0), (None, "I1", "m", "i1", "t1", True, "EUR", 1.0, 3.0),
    ]
    held = [("A", "I1", 3.0), ("A", "I2", -2.0), ("A", "I3", 0.0), ("A", None, 7.0), (None, "I1", 9.0), ("B", "I2", 1.0), ("B", "I9", 1.0)]
    known = [("I1", "own", "o1", "w1", "USD", False), ("I2", "two", "o2", "w2", "USD", True), ("I2", "two", "o2", "w2", "USD", True), ("I3", "c", "o3", "w3", "USD", True)]
    out = holdings.latest_valued_holdings(
        spark.createDataFrame(listed, kind),
        spark.createDataFrame(held, "account_label string, instrument_id string, latest_quantity double"),
        spark.createDataFrame([("I1", 5.0), ("I2", 4.0)], "instrument_id string, latest_price_eur double"),
        spark.createDataFrame(known, "instrument_id string, product string, isin string, ticker string, currency string, is_etf boolean"),
    )
    assert out.columns == ["account_label", "instrument_id", "product", "isin", "ticker", "is_etf", "currency", "quantity", "last_px_eur", "value_eur"]
    two = ("A", "I2", "two", "o2", "w2", True, "USD", 2.0, 4.0, 8.0)
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
        ("A", "I1", "x", "i1", "t1", True, "EUR", 3.0, 5.0, 15.0), ("A", "I1", "y", "i1", "t1", True, "EUR", 3.0, 5.0, 15.0),
        ("A", "I4", "z", "i4", "t4", False, "EUR", 2.0, 3.0, 6.0), ("A", None, "n", None, "", None, "", 5.0, 1.0, 5.0), (None, "I1", "m", "i1", "t1", True, "EUR", 1.0, 5.0, 5.0),
        two, two, ("B", *two[1:7], 1.0, 4.0, 4.0), ("B", *two[1:7], 1.0, 4.0, 4.0), ("B", "I9", "I9", "I9", "", False, "", 1.0, None, 0.0),
        ("A", None, None, None, "", False, "", None, None, 0.0), (None, "I1", "own", "o1", "w1", False, "USD", None, 5.0, 0.0),
    ]))


def test_latest_values_meet_by_instrument(spark):
    """holdings and trades move once to their instrument and are joined there."""
    plan = unbroadcast(spark, lambda: plan_of(catalog.QUERIES["latest_valued_holdings"](spark, SAMPLE)))
    assert "hashpartitioning(account_label" not in plan and "hashpartitioning(of" not in plan


def test_packed_steps_of_any_size(spark):
    """a step beyond 48 bits or a day beyond 2059 keeps its row as pairs; a trade without a price has its day."""
    net = [("A", "I1", dt.date(2020, 1, 1), 2.0), ("A", "I1", dt.date(2020, 1, 3), 3.0), ("B", "I2", dt.date(2020, 1, 1), -1.0), ("C", "I3", dt.date(2020, 1, 2), 1.0)]
    prices = [("I1", dt.date(2020, 1, 1), 1.5), ("I1", dt.date(2020, 1, 5), 1.25), ("I2", dt.date(2020, 1, 1), 3e9), ("I2", dt.date(2070, 1, 1), 1e9)]
    end = dt.date(2070, 2, 1)
    moves = timeseries.price_moves(spark.createDataFrame(prices, "instrument_id string, date date, price_eur double"), dt.date(2020, 1, 1), end)
    packed = timeseries.position_steps(spark.createDataFrame(net, "account_label string, instrument_id string, date date, net_quantity double"), moves, end, every_trade=True)
    assert {r[0]: r[1] for r in packed.select("account_label", F.col("wide").isNotNull()).collect()} == {"A": False, "B": True, "C": False}
    got = sorted(tuple(r) for r in timeseries.opened_steps(packed, "account_label").collect())
    assert got == [
        ("A", dt.date(2020, 1, 1), 3_000_000), ("A", dt.date(2020, 1, 3), 4_500_000), ("A", dt.date(2020, 1, 5), -1_250_000),
        ("B", dt.date(2020, 1, 1), -3 * 10**15), ("B", dt.date(2070, 1, 1), 2 * 10**15), ("C", dt.date(2020, 1, 2), 0),
    ]


def test_trades_are_read_and_dealt_once(spark):
    """One shuffle by portfolio and instrument for sums and windows, and none for the first days."""
    v = SampleViews(spark, SAMPLE)
    assert plan_of(timeseries.daily_trades(v.tx())).count("Exchange hashpartitioning(account_label") == 1
    plan = unbroadcast(spark, lambda: plan_of(catalog.QUERIES["cash_share"](spark, SAMPLE)))
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "partial_min" not in plan


def test_days_are_not_dealt_again_beside_the_combined_ones(spark):
    """the events of portfolios stay where they were dealt when those of all together are added."""
    plan = plan_of(catalog.QUERIES["daily_portfolio_value"](spark, SAMPLE))
    assert "Exchange hashpartitioning(account_label" in plan and "Union" in plan
    top = plan[: plan.index("posexplode")]
    assert "hashpartitioning(account_label" not in top


def days(spark):
    rows = [("A", dt.date(2020, 1, 30) + dt.timedelta(days=n), 100.0 + n, 10.0 * (n > 1), 50.0 + n % 2 * 10, 50.0) for n in range(5)]
    rows += [("B", dt.date(2020, 2, 10), 7.0, None, 1.0, 1.0), (None, dt.date(2020, 2, 1), 1.0, 1.0, 90.0, 1.0)]
    return spark.createDataFrame(rows, "account_label string, date date, portfolio_value double, total_deposits double, cash_from_statement double, cash_from_changes double")


def test_gaps_and_growth_read_the_days_once(spark):
    """One pass over the daily metrics, with the same rows."""
    m = days(spark)
    gaps, growth = timeseries.cash_gap_issues(m), performance.growth_table(m)
    for out in (gaps, growth):
        assert plan_of(out).count("Scan ExistingRDD") == 1 and "Join" not in plan_of(out)
    assert [tuple(r) for r in gaps.collect()] == [("A", "Cash statement vs change-cumsum mismatch", 2, 10.0, "2020-01-31, 2020-02-02")]
    got = {(r["account_label"], r["period"]): (r["start_date"], r["end_date"], r["start_eur"], r["end_eur"], r["deposited_cash_eur"]) for r in growth.collect()}
    assert got == {
        ("A", "1D"): ("2020-02-02", "2020-02-03", 103.0, 104.0, 0.0), ("A", "MTD"): ("2020-01-31", "2020-02-03", 101.0, 104.0, 10.0),
        ("B", "MTD"): ("2020-02-10", "2020-02-10", 7.0, 7.0, None),
    }


def test_metrics_read_several_times_are_written_once(spark):
    """later plans read event days, not trades."""
    v = SampleViews(spark, SAMPLE)
    plan = plan_of(series_queries.metrics(v, written=True))
    assert "daily_events" in plan and "lineitem" not in plan and "Exchange" not in plan


def test_exploded_probes_are_not_broadcast(spark, monkeypatch):
    """rows that an explode multiplies look small to Spark; no join may take them to the driver."""
    plans, star = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges, name: plans.append(plan_of(edges)) or star(edges, name))
    docs = spark.createDataFrame([(i, f"word{i % 7} and other text of document {i}") for i in range(40)], "doc_id long, text string")
    simhash.near_duplicates(docs).count()
    (plan,) = plans
    for join in plan.split("BroadcastExchange")[1:]:
        assert "Generate explode" not in join[: join.find("FileScan")].split("Aggregate")[0]
