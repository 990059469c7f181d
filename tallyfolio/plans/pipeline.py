"""Whole analysis of any number of portfolios: export folders in, named result tables out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.operators import (
    allocation, costbasis, holdings, instruments, ledger, normalize, performance, quality, reconcile, series, timeseries,
)
from tallyfolio.session import materialize
from tallyfolio.sources import exports
from tallyfolio.sources.tables import classification_issues, strict_classification

ACCOUNT = "account_label"
COMBINED = "Combined"


@dataclass
class PipelineInputs:
    """Normalized tables plus market data; every table holds all portfolios.

    `benchmarks` is (series, ticker, currency); `prices` is (instrument_id, date,
    close) and also carries the benchmark tickers; `fx` is (currency, date,
    eur_per_unit).
    """

    transactions: DataFrame
    portfolio: DataFrame
    account: DataFrame
    instruments: DataFrame
    prices: DataFrame
    fx: DataFrame
    strategy: DataFrame
    benchmarks: DataFrame | None = None
    manual_values: DataFrame | None = None
    reported: DataFrame | None = None
    as_of: dt.date | None = None
    classification: DataFrame | None = None
    issues: dict[str, DataFrame] = field(default_factory=dict)


#: Findings that make the figures worthless: `load_exports` refuses them unless told otherwise.
FATAL = ("unparseable_accounts", "classification", "snapshot_without_value")


def refuse(issues: dict[str, DataFrame]) -> None:
    """ValueError that names the fatal findings, with a few examples of each."""
    found = {name: [r.asDict() for r in issues[name].limit(3).collect()] for name in FATAL if name in issues}
    found = {name: rows for name, rows in found.items() if rows}
    if found:
        raise ValueError("; ".join(f"{name}: {rows}" for name, rows in found.items()))


def load_exports(spark: SparkSession, root: str, classification: DataFrame, strict: bool = True) -> PipelineInputs:
    """Read every `root/<portfolio>/{Transactions,Portfolio,Account}.csv` in one pass per kind.

    Market data and strategy are left for the caller to fill in.  With `strict`, fatal findings raise ValueError; without,
    they are only listed in `issues`.
    """
    located, issues = {}, {}
    for name in exports.REQUIRED_FILES:
        rows = exports.repair_rows(exports.read_rows(spark, f"{root}/*/{name}"))
        located[name] = exports.located_rows(rows)
        issues[f"missing_columns_{name}"] = exports.missing_columns(exports.resolve_columns(rows))
    issues["file_set"] = quality.file_set_check(
        exports.list_files(spark, f"{root}/*/*"), exports.REQUIRED_FILES
    )
    tx = materialize(normalize.normalize_transactions(located["Transactions.csv"]), "transactions")
    pf = materialize(normalize.normalize_portfolio(located["Portfolio.csv"]), "portfolio")
    account = materialize(normalize.normalize_account(located["Account.csv"]), "account")
    known = strict_classification(classification)
    if known.isEmpty():
        raise ValueError("the classification has no usable row")
    dim = materialize(instruments.resolve_instruments(instruments.base_instruments(pf, tx), known), "instruments")
    issues["classification"] = classification_issues(classification)
    issues["unparseable_accounts"] = normalize.unparseable_accounts(normalize.raw_account(located["Account.csv"]))
    tx, pf = instruments.attach_metadata(tx, dim), instruments.attach_metadata(pf, dim)
    issues["snapshot_without_value"] = normalize.snapshot_violations(pf)
    issues["instruments"] = dim.where(F.col("issue").isNotNull()).select("instrument_id", "product", "issue")
    issues["missing_values"] = quality.missing_value_issues(tx, pf, account)
    issues["ledger_coverage"] = quality.ledger_coverage(tx, account)
    if strict:
        refuse(issues)
    return PipelineInputs(tx, pf, account, dim, None, None, None, classification=known, issues=issues)


def _combined_rows(rows: DataFrame) -> DataFrame:
    """The rows once more under the Combined label."""
    return rows.unionByName(rows.withColumn(ACCOUNT, F.lit(COMBINED)))


def analyze(inputs: PipelineInputs) -> dict[str, DataFrame]:
    """All result tables, lazy but for what several of them read (the daily metrics above all), which is written first.

    Per-portfolio results come from keyed passes over all portfolios, Combined from
    aggregation of the same rows.
    """
    tx, account, dim = inputs.transactions, inputs.account, inputs.instruments
    snapshot = inputs.portfolio
    start, end = timeseries.activity_span(tx, account, as_of=inputs.as_of)
    # written once: most tables below read it, and an executor that is lost costs a read, not the largest join again
    metrics = timeseries.portfolio_metrics(tx, account, dim, inputs.prices, inputs.fx, as_of=inputs.as_of, combined=True, span=(start, end))
    metrics = materialize(metrics, "metrics")
    latest = timeseries.latest_metrics(metrics)
    events = timeseries.eur_prices(inputs.prices, dim, inputs.fx)
    moves = timeseries.price_moves(events, start, end)
    prices_now = holdings.latest_prices(events)
    trades = timeseries.known_trades(timeseries.daily_trades(tx), dim)
    quantities = holdings.latest_quantities(trades)
    both_quantities = quantities.unionByName(
        quantities.groupBy("instrument_id").agg(F.sum("latest_quantity").alias("latest_quantity")).withColumn(ACCOUNT, F.lit(COMBINED))
    )
    rates = reconcile.latest_fx(inputs.fx, end)
    eur_ledger = ledger.with_eur_amounts(account, ledger.daily_fx(inputs.fx, start, end))
    out: dict[str, DataFrame] = {"metrics": metrics}

    # Reconciliation
    per_portfolio = reconcile.reconcile(snapshot, account, rates)
    totals = reconcile.with_combined(per_portfolio)
    direct = reconcile.combined_direct(snapshot, account, rates)
    detail = reconcile.cash_detail(account, rates)
    out["reconciliation"] = reconcile.reconciliation_table(totals)
    out["totals"] = totals
    out["totals_check"] = reconcile.totals_check(totals, direct)
    out["snapshot_vs_rebuilt"] = reconcile.snapshot_vs_rebuilt(totals, latest)
    out["cash_overview"] = reconcile.cash_overview(totals, latest, inputs.reported)
    out["portfolio_overview"] = reconcile.portfolio_overview(totals, direct, inputs.reported)
    out["latest_balances"] = reconcile.latest_balance_check(detail)
    out["positions_reconciliation"] = reconcile.position_attribution(_combined_rows(snapshot), both_quantities, prices_now)

    # Holdings and targets, on rebuilt values
    open_rows = holdings.unified_product_names(snapshot.where(~F.coalesce("is_cash_like", F.lit(False))))
    valued = holdings.latest_valued_holdings(
        holdings.aggregate_holdings(_combined_rows(open_rows)), both_quantities, prices_now, dim
    )
    table_totals = latest.select(
        ACCOUNT, F.col("cash").alias("cash_value_eur"), F.col("portfolio_value").alias("total_value_eur")
    )
    tables = holdings.four_tables(valued, table_totals, inputs.strategy)
    out.update({f"table_{k}": t for k, t in tables.items()})
    targeted = holdings.with_targets(valued, table_totals, inputs.strategy)
    out["holdings_catalog"] = holdings.ordered_catalog(holdings.holdings_catalog(targeted, inputs.strategy))
    out["product_name_variants"] = holdings.product_name_variants(snapshot.where(~F.coalesce("is_cash_like", F.lit(False))))
    sleeves = holdings.sleeve_values(valued)
    split = holdings.cash_split(table_totals, sleeves, inputs.strategy)
    out["cash_split"] = split
    out["recent_trades"] = holdings.recent_trades(tx.drop("product", "ticker"), dim, prices_now)

    # Spread
    known = inputs.classification if inputs.classification is not None else dim.withColumn("row_seq", F.lit(0))
    # written once: many tables below read these few columns, and the keyword rules make long plans
    traits = materialize(instruments.resolve_characteristics(dim, known), "characteristics")
    classified = [c for c in holdings.CLASS_COLUMNS if c in traits.columns]
    spread = holdings.holdings_for_spread(valued.drop(*classified).join(traits.select("instrument_id", *classified), "instrument_id", "left"))
    out["characteristic_matches"] = instruments.match_counts(traits)
    by_category = allocation.category_allocation(spread, table_totals)
    by_currency = allocation.currency_allocation(spread, _combined_rows(detail), table_totals)
    out["category_allocation"] = by_category
    out["currency_allocation"] = allocation.attach_targets(
        by_currency, "currency", "total_eur", table_totals, inputs.strategy, "target_currency_pct"
    )
    out["etf_non_etf"] = allocation.sleeve_table(sleeves, table_totals, inputs.strategy)
    top = allocation.concentration(spread, table_totals)
    out["concentration"] = top
    weights = targeted.withColumn("value_pct_total", F.col("value_pct"))
    pairs = series.with_names_and_weights(series.held_correlations(events, valued, inputs.strategy, start, end), weights)
    out["correlation_warnings"] = pairs
    industry = by_category.where(F.col("dimension") == "industry")
    style = by_category.where(F.col("dimension") == "style")
    kpis = allocation.spread_kpis(sleeves, table_totals, top, by_currency, industry, pairs)
    over = tables["over_target"]
    out["strategy_checks"] = allocation.strategy_checks(kpis, inputs.strategy)
    out["spread_action_plan"] = allocation.spread_action_plan(kpis, split, over, inputs.strategy)
    plans = {
        "Currency": allocation.bucket_buy_plan(by_currency, "currency", "total_eur", split, inputs.strategy, "target_currency_pct"),
        "Industry": allocation.bucket_buy_plan(industry, "category", "value_eur", split, inputs.strategy, "target_industry_pct"),
        "Style": allocation.bucket_buy_plan(style, "category", "value_eur", split, inputs.strategy, "target_style_pct"),
    }
    out["next_steps"] = allocation.next_steps(over, allocation.buy_candidates(targeted), split, inputs.strategy, plans)
    out["metadata_conflicts"] = allocation.metadata_conflicts(open_rows)

    # Performance
    trailing = performance.trailing_performance(metrics)
    out["period_performance"] = trailing
    out["monthly_performance"] = performance.monthly_performance(metrics)
    out["drawdown_summary"] = performance.drawdown_summary(metrics)
    out["performance_action_plan"] = allocation.performance_action_plan(
        latest, trailing, over, performance.contribution_pace(metrics)
    )
    out["performance_dashboard"] = performance.performance_dashboard(metrics, _combined_rows(tx), _combined_rows(account), dim)
    out["performance_summary"] = performance.performance_summary(out["performance_dashboard"], latest)
    out["growth"] = performance.growth_table(metrics)
    out["contribution_pace"] = performance.contribution_pace(metrics)
    out["cash_share"] = timeseries.cash_share(metrics)
    out["monthly_start_values"] = performance.monthly_start_values(
        metrics.where(F.col(ACCOUNT) != COMBINED), inputs.manual_values
    )
    if inputs.benchmarks is not None:
        quotes = inputs.prices.withColumnRenamed("instrument_id", "ticker")
        levels = performance.benchmark_levels(quotes, inputs.fx, inputs.benchmarks, start, end)
        out["benchmark_levels"] = levels
        out["benchmark_statistics"] = performance.benchmark_statistics(metrics, levels)

    # Ledger, audit and strategy report
    categories = ledger.category_summary(eur_ledger, combined=True)
    out["account_categories"] = categories
    out["costs_summary"] = ledger.costs_summary(categories)
    out["quarterly_costs"] = ledger.quarterly_costs(account, tx)
    out["ledger_listing"] = ledger.ledger_listing(account)
    out["cash_timeline"] = timeseries.cash_timeline(metrics)
    cost = costbasis.open_cost_basis(tx, ("instrument_id",))
    report = holdings.holdings_report(_combined_rows(snapshot), table_totals, prices_now, cost)
    out["holdings_report"] = report
    trims = holdings.trim_actions(report, table_totals, inputs.strategy)
    out["trim_actions"] = trims
    out["action_required"] = holdings.action_required(split, trims)
    out["daily_cost_basis"] = costbasis.daily_cost_basis(tx)
    out["peak_position_values"] = series.position_value_peaks(trades, moves, end)
    out["normalized_latest"] = series.normalized_latest(events, start, end)

    # Quality
    out["activity_range"] = quality.activity_range(tx, account)
    out["cash_gap_issues"] = timeseries.cash_gap_issues(metrics)
    out["missing_metric_issues"] = timeseries.missing_metric_issues(metrics)
    out["price_fill_stats"] = timeseries.price_fill_stats(inputs.prices, dim, inputs.fx, start, end)
    out["duplicate_uploads"] = quality.duplicate_uploads(tx, account, snapshot)
    out.update(inputs.issues)
    return out
