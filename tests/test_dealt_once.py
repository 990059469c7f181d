"""Findings of round 3: holdings are dealt once, and later steps by portfolio or by instrument leave them where they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyfolio.operators import allocation, holdings
from tallyfolio.plans import holding_queries as Q
from tallyfolio.plans.sample_views import SampleViews
from tallyfolio.session import materialize_dealt

SAMPLE = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ranked_holdings_are_not_dealt_again(spark):
    """ranking, catalog order and buy candidates read the snapshot where it was written."""
    rows = Q.targeted(SampleViews(spark, SAMPLE))
    assert exchanges(rows) == 0
    assert exchanges(holdings.ordered_catalog(rows)) == 0
    assert exchanges(allocation.buy_candidates(rows)) == 0


def test_over_target_flags_stay_in_their_portfolio(spark):
    """F32: the composite key is looked up without a join that deals both sides by it."""
    v = SampleViews(spark, SAMPLE)
    rows = Q.targeted(v)
    assert exchanges(holdings.over_target_counts(holdings.flag_over_target(rows, holdings.over_target(rows, Q.strategy(v))))) == 0


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_holdings_are_aggregated_where_they_meet_their_instrument(spark, threshold):
    """with a broadcast join, too, no row moves behind it."""
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        held = Q.held(SampleViews(spark, SAMPLE))
        assert exchanges(holdings.aggregate_holdings(held, per_account=False)) == exchanges(held)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_report_reads_holdings_by_instrument(spark):
    """the snapshot lies by instrument already, so nothing of it moves for price and cost."""
    v = SampleViews(spark, SAMPLE)
    totals = Q.recon(v, by="instrument_id")
    price = v.instruments().select("instrument_id", F.lit(1.0).alias("latest_price_eur"), F.lit(None).cast("date").alias("latest_price_date"))
    cost = v.instruments().select("instrument_id", F.lit(1.0).alias("cost_basis_eur"))
    report = holdings.holdings_report(v.snapshot(), totals, price, cost, dealt=True)
    assert exchanges(report) == 2  # price and cost, one row per instrument
    assert "REPARTITION_BY_COL" not in report._jdf.queryExecution().executedPlan().toString()


def test_dealt_table_keeps_every_row(spark):
    rows = [(None, 1), ("A", 1), ("A", 1), ("B", None), ("", 2)] * 3
    df = spark.createDataFrame(rows, "account_label string, n int")
    out = materialize_dealt(df, "a-name", "account_label", 4)
    assert out.schema == df.schema and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert exchanges(out.groupBy("account_label").count()) == 0


def test_flags_and_counts_by_hand(spark):
    """A missing portfolio is never marked, a key counts once a sleeve, a portfolio without any mark has zeros."""
    kind = "account_label string, isin string, product string, ticker string, is_etf boolean, over_target_eur double"
    rows = [
        ("A", "x1", "P", "T", True, 1.0), ("A", "X1 ", "P", "T", False, 2.0), ("A", "X1", "P", "T", False, 3.0), ("A", "X2", "P", "T", None, 4.0),
        ("A", None, "Q", "T", True, 5.0), ("B", "X1", "P", "T", True, 6.0), (None, "X1", "P", "T", True, 7.0),
    ]
    over = [("A", "X1", "P", "T", True, 10.0), ("A", "X1", "P", "T", True, 12.0), ("A", "X2", "P", "T", True, None), ("A", "", "q", "t", True, 9.0), (None, "X1", "P", "T", True, 8.0)]
    segment = spark.createDataFrame(rows, kind)
    flags = holdings.flag_over_target(segment, spark.createDataFrame(over, kind))
    got = sorted((r["account_label"] or "", r["isin"] or "", r["is_etf"] is True, r["over_target_eur"], r["is_over_target_threshold"]) for r in flags.collect())
    assert got == sorted([
        ("A", "x1", True, 12.0, True), ("A", "X1 ", False, 12.0, True), ("A", "X1", False, 12.0, True), ("A", "X2", False, 0.0, False),
        ("A", "", True, 9.0, True), ("B", "X1", True, 0.0, False), ("", "X1", True, 0.0, False),
    ])
    assert set(flags.columns) == set(segment.columns) | {"is_over_target_threshold"}
    counts = {r[0]: (r[1], r[2]) for r in holdings.over_target_counts(flags).collect()}
    assert counts == {"A": (2, 1), "B": (0, 0), None: (0, 0)}


def test_sleeve_values_by_hand(spark):
    rows = [("A", "I1", True, 1.25), ("A", "I1", False, 2.0), ("A", "I1", True, None), ("A", None, True, 4.0), ("A", "I2", None, 8.0), (None, "I3", True, 1.0)]
    held = spark.createDataFrame(rows, "account_label string, instrument_id string, is_etf boolean, value_eur double")
    got = {r[0]: tuple(r)[1:] for r in holdings.sleeve_values(held).collect()}
    assert got == {"A": (5.25, 10.0, 1, 2, 2), None: (1.0, 0.0, 1, 0, 1)}


def test_returns_of_held_instruments_are_computed_once(spark):
    """block counts and pairs read the same written returns."""
    v = SampleViews(spark, SAMPLE)
    v.share_snapshot()
    plan = Q.correlated(v)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "lineitem.parquet" not in plan
