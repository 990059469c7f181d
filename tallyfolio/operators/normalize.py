"""Located export rows to the normalized transactions, portfolio and account tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.functions import rules
from tallyfolio.functions.numbers import parse_decimal
from tallyfolio.functions.text import is_isin, parse_day_first
from tallyfolio.operators.fx_repair import repair_fx_rates
from tallyfolio.sources.exports import cell


def normalize_transactions(located: DataFrame) -> DataFrame:
    """13 columns; the description falls back to the product, the type to the description."""
    product = cell("product")
    description = F.when(cell("description") == "", product).otherwise(cell("description"))
    isin = F.nullif(cell("isin"), F.lit(""))
    rows = located.select(
        "account_label",
        "row_seq",
        parse_day_first(cell("date"), cell("time")).alias("datetime"),
        product.alias("product"),
        isin.alias("isin"),
        F.nullif(cell("symbol"), F.lit("")).alias("symbol"),
        parse_decimal(cell("quantity")).alias("quantity"),
        parse_decimal(cell("price")).alias("price"),
        parse_decimal(cell("tx_value_eur")).alias("value_eur"),
        parse_decimal(cell("total_eur")).alias("total_eur"),
        F.upper(cell("tx_currency")).alias("currency"),
        description.alias("description"),
        F.when(cell("tx_type") == "", description).otherwise(cell("tx_type")).alias("type"),
        (
            F.coalesce(parse_decimal(cell("fee")), F.lit(0.0)) + F.coalesce(parse_decimal(cell("autofx")), F.lit(0.0))
        ).alias("fees_eur"),
        F.coalesce(isin, product).alias("instrument_id"),
    )
    return rows.withColumn("quantity", rules.signed_quantity("quantity", "total_eur", "type", "description"))


def normalize_portfolio(located: DataFrame) -> DataFrame:
    """Snapshot rows; the combined column is an ISIN or a symbol, value falls back to price x quantity."""
    code, product = cell("symbol_isin"), cell("product")
    isin = F.when(is_isin(code), code)
    quantity, price = parse_decimal(cell("amount")), parse_decimal(cell("closing"))
    return located.select(
        "account_label",
        "row_seq",
        product.alias("product"),
        isin.alias("isin"),
        F.when(~is_isin(code), F.nullif(code, F.lit(""))).alias("symbol"),
        quantity.alias("quantity"),
        price.alias("price"),
        F.coalesce(parse_decimal(cell("pf_value_eur")), price * quantity).alias("value_eur"),
        F.nullif(F.upper(cell("pf_currency")), F.lit("")).alias("currency"),
        F.coalesce(isin, product).alias("instrument_id"),
        rules.is_cash_like(product, isin).alias("is_cash_like"),
    )


def snapshot_violations(portfolio: DataFrame) -> DataFrame:
    """Non-cash snapshot rows that still have no value."""
    return portfolio.where(F.col("value_eur").isNull() & ~F.col("is_cash_like")).select(
        "account_label", "row_seq", "product", "isin"
    )


def raw_account(located: DataFrame) -> DataFrame:
    """Account rows before FX repair; the currency falls back to the balance's currency."""
    currency = F.coalesce(
        F.nullif(F.upper(cell("change_currency")), F.lit("")), F.nullif(F.upper(cell("balance_currency")), F.lit(""))
    )
    return located.select(
        "account_label",
        "row_seq",
        parse_day_first(cell("date"), cell("time")).alias("datetime"),
        F.to_date(parse_day_first(cell("value_date"))).alias("value_date"),
        F.nullif(cell("order_id"), F.lit("")).alias("order_id"),
        cell("description").alias("description"),
        cell("type").alias("given_type"),
        currency.alias("currency"),
        parse_decimal(cell("change_amount")).alias("raw_change"),
        parse_decimal(cell("balance_amount")).alias("raw_balance"),
        (cell("change_amount") != "").alias("has_change_text"),
        (cell("balance_amount") != "").alias("has_balance_text"),
        parse_decimal(cell("fx")).alias("fx_rate"),
    )


def unparseable_accounts(raw: DataFrame) -> DataFrame:
    """Portfolios whose change or balance column has text but not a single number."""
    counts = raw.groupBy("account_label").agg(
        F.count_if("has_change_text").alias("c_text"),
        F.count("raw_change").alias("c_num"),
        F.count_if("has_balance_text").alias("b_text"),
        F.count("raw_balance").alias("b_num"),
    )
    bad_change = (F.col("c_text") > 0) & (F.col("c_num") == 0)
    bad_balance = (F.col("b_text") > 0) & (F.col("b_num") == 0)
    return counts.where(bad_change | bad_balance).select(
        "account_label", bad_change.alias("change_unparseable"), bad_balance.alias("balance_unparseable")
    )


def classify_account(raw: DataFrame) -> DataFrame:
    """Types, flags and EUR amounts of repaired account rows (foreign amounts divide by their rate)."""
    inferred = rules.account_type("description", "raw_change")
    own = F.when(F.col("currency") == "EUR", F.lit(1.0)).when(F.col("fx_rate") > 0, F.col("fx_rate"))
    given = F.col("given_type") if "given_type" in raw.columns else F.lit("")
    return (
        raw.withColumn("type", rules.given_or_inferred_type(given, inferred))
        .withColumns(rules.type_flags())
        .withColumn("change_eur", F.col("raw_change") / own)
        .withColumn("balance_eur", F.col("raw_balance") / own)
    )


ACCOUNT_COLUMNS = (
    "account_label", "row_seq", "datetime", "order_id", "description", "type", "currency", "raw_change", "raw_balance",
    "fx_rate", "change_eur", "balance_eur", "is_external_flow", "is_internal_transfer", "is_cost", "is_income",
)


def normalize_account(located: DataFrame) -> DataFrame:
    return classify_account(repair_fx_rates(raw_account(located))).select(*ACCOUNT_COLUMNS)
