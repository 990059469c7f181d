"""Cash-ledger operators: EUR conversion, daily series, category and cost tables.

Ledger rows carry two kinds of rates and they must not be mixed: the row's own
`fx_rate` is foreign currency per EUR (divide), the market FX history is EUR per
foreign unit (multiply).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.functions.numbers import MONEY, money, money_sum0
from tallyfolio.functions.rules import COST_TYPES
from tallyfolio.functions.text import day, iso_second, quarter_label

ACCOUNT = "account_label"


def effective_eur_change():
    """change_eur, or the raw change of an EUR row."""
    return F.coalesce(
        F.col("change_eur"), F.when(F.upper(F.col("currency")) == "EUR", F.col("raw_change"))
    )


def daily_fx(fx: DataFrame, start, end) -> DataFrame:
    """Market FX on every calendar day: forward filled, first rate filled backward.

    One row per currency and day, so a dated lookup is a plain equi join that
    Spark may broadcast when its measured size allows.
    """
    w = Window.partitionBy("currency").orderBy("date")
    first = F.row_number().over(w) == 1
    return (
        fx.where(F.col("eur_per_unit").isNotNull() & F.col("date").between(F.lit(start), F.lit(end)))
        .select(F.upper("currency").alias("currency"), "date", "eur_per_unit")
        .withColumn("until", F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.lit(end)))
        .withColumn("since", F.when(first, F.lit(start)).otherwise(F.col("date")))
        .select("currency", "eur_per_unit", F.explode(F.sequence("since", "until")).alias("date"))
    )


def with_eur_amounts(ledger: DataFrame, fx_daily: DataFrame) -> DataFrame:
    """Dated FX join: add `date`, `change_eur_filled`, `balance_eur_filled`.

    Rows without a timestamp are dropped.  A row without its own EUR amount takes
    the market rate of its day (1 for EUR).
    """
    rate = F.when(F.col("currency") == "EUR", F.lit(1.0)).otherwise(F.col("eur_per_unit"))
    rows = (
        ledger.where(F.col("datetime").isNotNull())
        .withColumn("date", day("datetime"))
        .withColumn("currency", F.upper("currency"))
    )
    return (
        rows.join(fx_daily, ["currency", "date"], "left")
        .withColumn("change_eur_filled", F.coalesce("change_eur", F.col("raw_change") * rate))
        .withColumn("balance_eur_filled", F.coalesce("balance_eur", F.col("raw_balance") * rate))
        .drop("eur_per_unit")
    )


def daily_ledger(eur_ledger: DataFrame) -> DataFrame:
    """Cash change, external flow and statement balance per portfolio and day, in one pass.

    `cash_change` leaves out internal transfers, `flow` keeps deposits and
    withdrawals only, `statement` is the last balance of the day per currency,
    summed (rows without a currency have no statement balance).
    """

    def total(flag):
        return F.sum(F.when(flag, money("change_eur_filled")))

    internal = F.coalesce("is_internal_transfer", F.lit(False))
    external = F.coalesce("is_external_flow", F.lit(False))
    zero = F.lit(0).cast(MONEY)
    known = F.col("currency").isNotNull()
    per_currency = eur_ledger.groupBy(ACCOUNT, "date", "currency").agg(
        total(~internal).alias("cash_change"),
        total(external).alias("flow"),
        F.max_by(money("balance_eur_filled"), F.struct("datetime", "row_seq")).alias("balance"),
    )
    return per_currency.groupBy(ACCOUNT, "date").agg(
        F.coalesce(F.sum("cash_change"), zero).alias("cash_change"),
        F.coalesce(F.sum("flow"), zero).alias("flow"),
        F.when(F.bool_or(known), F.coalesce(F.sum(F.when(known, F.col("balance"))), zero)).alias("statement"),
    )


def category_summary(eur_ledger: DataFrame, combined: bool = False) -> DataFrame:
    """Count, net, inflow and outflow per ledger category (and for all portfolios)."""
    change = F.coalesce("change_eur_filled", F.lit(0.0))
    rows = eur_ledger.select(
        ACCOUNT,
        F.coalesce("type", F.lit("other")).alias("category"),
        change.alias("v"),
        "is_internal_transfer",
        "is_external_flow",
    )
    per = rows.groupBy(ACCOUNT, "category").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(money("v")).alias("net_eur"),
        F.sum(money(F.greatest(F.col("v"), F.lit(0.0)))).alias("inflow_eur"),
        F.sum(money(F.greatest(-F.col("v"), F.lit(0.0)))).alias("outflow_eur"),
        F.coalesce(F.bool_or("is_internal_transfer"), F.lit(False)).alias("is_internal_transfer"),
        F.coalesce(F.bool_or("is_external_flow"), F.lit(False)).alias("is_external_flow"),
    )
    if combined:
        # The second level works on one row per portfolio and category.
        total = per.groupBy("category").agg(
            F.sum("row_count").alias("row_count"),
            *[F.sum(c).alias(c) for c in ("net_eur", "inflow_eur", "outflow_eur")],
            F.bool_or("is_internal_transfer").alias("is_internal_transfer"),
            F.bool_or("is_external_flow").alias("is_external_flow"),
        )
        per = per.unionByName(total.withColumn(ACCOUNT, F.lit("Combined")))
    money_cols = {c: F.col(c).cast("double") for c in ("net_eur", "inflow_eur", "outflow_eur")}
    return per.withColumns(money_cols)


def costs_summary(categories: DataFrame) -> DataFrame:
    """One cost and income row per portfolio from the category summary."""

    def pick(column: str, category: str):
        return money_sum0(F.when(F.col("category") == category, F.col(column)))

    costs = F.col("transaction_fee_eur") + F.col("account_fee_eur") + F.col("dividend_tax_eur")
    return (
        categories.groupBy(ACCOUNT)
        .agg(
            *[pick("outflow_eur", t).alias(f"{t}_eur") for t in COST_TYPES],
            pick("inflow_eur", "promo").alias("promo_income_eur"),
        )
        .withColumn("total_costs_eur", costs)
        .withColumn("total_income_eur", F.col("promo_income_eur"))
        .withColumn("net_cost_minus_income_eur", F.col("total_costs_eur") - F.col("total_income_eur"))
    )


def quarterly_costs(ledger: DataFrame, tx: DataFrame) -> DataFrame:
    """Costs by type with trade and market counts per quarter and portfolio (full outer join)."""
    outflow = F.greatest(-F.coalesce("change_eur", F.lit(0.0)), F.lit(0.0))
    keys = ["quarter", ACCOUNT]
    costs = (
        ledger.where(F.col("datetime").isNotNull() & F.col("type").isin(*COST_TYPES))
        .select(quarter_label("datetime").alias("quarter"), ACCOUNT, "type", outflow.alias("cost"))
        .groupBy(*keys)
        .agg(
            *[money_sum0(F.when(F.col("type") == t, F.col("cost"))).alias(f"{t}_eur") for t in COST_TYPES],
            money_sum0("cost").alias("total_costs_eur"),
        )
    )
    traded = F.coalesce(F.col("quantity"), F.col("total_eur"), F.lit(0.0)) != 0.0
    market = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    activity = (
        tx.where(F.col("datetime").isNotNull() & traded)
        .select(
            quarter_label("datetime").alias("quarter"),
            ACCOUNT,
            F.when(~market.isin("", "NAN", "NONE"), market).alias("market"),
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("trade_count"), F.countDistinct("market").alias("market_count"))
    )
    numbers = [f"{t}_eur" for t in COST_TYPES] + ["total_costs_eur"]
    return costs.join(activity, keys, "full").select(
        *keys,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers],
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
        F.coalesce("market_count", F.lit(0)).alias("market_count"),
    )


def quarterly_cost_rollup(quarterly: DataFrame) -> DataFrame:
    """All portfolios per quarter."""
    sums = [f"{t}_eur" for t in COST_TYPES] + ["total_costs_eur"]
    return quarterly.groupBy("quarter").agg(
        *[money_sum0(c).alias(c) for c in sums],
        F.sum("trade_count").alias("trade_count"),
        F.max("market_count").alias("max_market_count"),
    )


AUDIT_COLUMNS = (
    "type", "description", "currency", "raw_change", "change_eur", "raw_balance", "balance_eur",
    "fx_rate", "is_external_flow", "is_internal_transfer", "is_cost", "is_income",
)


def ledger_listing(ledger: DataFrame, last: int | None = None) -> DataFrame:
    """Ledger rows per portfolio with their position in it; `last`: only the newest so many.

    A position is the rows of earlier days (sums per day, then one window over days) plus the rank within the day, so
    no task ever sorts a whole portfolio.
    """
    day = F.to_date("datetime")
    rows = ledger.withColumn("_day", day)
    days = rows.groupBy(ACCOUNT, "_day").agg(F.count(F.lit(1)).alias("_rows"))
    # rows without a time come last, as the newest
    by_day = Window.partitionBy(ACCOUNT).orderBy(F.col("_day").asc_nulls_last())
    days = days.withColumn("_before", F.coalesce(F.sum("_rows").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    days = days.withColumn("n", F.sum("_rows").over(Window.partitionBy(ACCOUNT)))
    days = days.select(F.col(ACCOUNT).alias("_account"), F.col("_day").alias("_on"), "_before", "n")
    same = F.col(ACCOUNT).eqNullSafe(F.col("_account")) & F.col("_day").eqNullSafe(F.col("_on"))
    in_day = Window.partitionBy(ACCOUNT, "_day").orderBy("datetime", "row_seq")
    top = rows.withColumn("_rank", F.row_number().over(in_day)).join(days, same).withColumn("row_number", F.col("_before") + F.col("_rank"))
    if last is not None:
        top = top.where(F.col("row_number") > F.col("n") - last)
    present = [c for c in AUDIT_COLUMNS if c in ledger.columns]
    return top.select(
        "row_number",
        ACCOUNT,
        iso_second("datetime").alias("datetime"),
        *present,
    )
