"""Instrument dimension: classification lookup, metadata attach and merge.

Dimensions are joined without hints: Spark broadcasts them when their measured size
is under the threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.functions import rules
from tallyfolio.functions.text import blank_to_null, clean_text, first_text, is_isin, upper_key

CLASS_TEXT = (
    "primary_style", "secondary_factor", "gics_sector", "gics_industry_group", "gics_industry", "gics_sub_industry",
)
METADATA = (
    "instrument_id", "ticker", "currency", "is_etf", "is_not_etf", "is_cash_like", "asset_class", *CLASS_TEXT,
)


def base_instruments(portfolio: DataFrame, tx: DataFrame) -> DataFrame:
    """One row per instrument from both tables: the smallest product name wins.

    Aggregated rather than sorted, so a very common instrument costs one partial row per task.
    """
    cols = ["instrument_id", "product", "isin", "symbol", "currency"]
    rows = portfolio.select(*cols).unionByName(tx.select(*cols))
    rest = F.struct("product", "isin", "symbol", "currency")
    return rows.groupBy("instrument_id").agg(F.min_by(rest, rest).alias("r")).select("instrument_id", "r.*")


def _first_by_key(classification: DataFrame, key: str, prefix: str) -> DataFrame:
    """First classification row per upper-cased key, as one struct."""
    record = F.struct(
        *[c for c in ("ticker", "currency", "asset_class", *CLASS_TEXT)]
    )
    rows = classification.withColumn("k", upper_key(key)).where(F.col("k") != "")
    return rows.groupBy(F.col("k").alias(f"{prefix}_key")).agg(F.min_by(record, "row_seq").alias(prefix))


def resolve_instruments(base: DataFrame, classification: DataFrame) -> DataFrame:
    """Precedence lookup: instrument id, else ISIN, else ticker; ticker and currency only fill blanks.

    `issue` names rows without a classification or without a ticker (cash rows have none).
    """
    rows = (
        base.withColumn("is_cash_like", rules.is_cash_like("product", "isin"))
        .withColumn("ticker", F.when(~is_isin("symbol"), F.col("symbol")))
        .withColumn("id_key", upper_key("instrument_id"))
        .withColumn("isin_key", upper_key("isin"))
        .withColumn("ticker_key", upper_key("ticker"))
    )
    by_id = _first_by_key(classification, "instrument_id", "a")
    by_ticker = _first_by_key(classification, "ticker", "c")
    matched = (
        rows.join(by_id, F.col("id_key") == F.col("a_key"), "left")
        .join(
            by_id.withColumnsRenamed({"a": "b", "a_key": "b_key"}),
            (F.col("isin_key") == F.col("b_key")) & (F.col("isin_key") != F.col("id_key")),
            "left",
        )
        .join(by_ticker, F.col("ticker_key") == F.col("c_key"), "left")
        .withColumn("m", F.when(~F.col("is_cash_like"), F.coalesce("a", "b", "c")))
    )
    hit = F.col("m").isNotNull()
    cash = F.col("is_cash_like")
    ticker = F.when(hit & (upper_key("ticker") == ""), blank_to_null("m.ticker")).otherwise(F.col("ticker"))
    currency = F.when(hit & (clean_text("currency") == ""), F.coalesce(blank_to_null("m.currency"), F.col("currency")))
    heuristic = rules.looks_like_etf("product", "isin")
    out = matched.select(
        "instrument_id",
        "product",
        "isin",
        "symbol",
        currency.otherwise(F.col("currency")).alias("currency"),
        ticker.alias("ticker"),
        F.when(cash, "Cash").when(hit, F.col("m.asset_class")).otherwise("").alias("asset_class"),
        *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in CLASS_TEXT],
        "is_cash_like",
        F.when(cash, False).when(hit, F.col("m.asset_class") == "ETF").otherwise(heuristic).alias("is_etf"),
        F.coalesce(~cash & (F.col("m.asset_class") == "Equity"), F.lit(False)).alias("is_not_etf"),
        hit.alias("hit"),
    )
    return out.withColumn(
        "issue",
        F.when(cash, None)
        .when(~F.col("hit"), "classification missing")
        .when(upper_key("ticker") == "", "ticker missing"),
    ).drop("hit")


def attach_metadata(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Left join of the instrument columns; a NULL currency is filled from the instrument."""
    meta = instruments.select(*[c for c in METADATA if c in instruments.columns]).withColumnRenamed(
        "currency", "currency_instrument"
    )
    clash = [c for c in meta.columns if c != "instrument_id" and c in rows.columns]
    meta = meta.drop(*clash)
    return (
        rows.join(meta, "instrument_id", "left")
        .withColumn("currency", F.coalesce("currency", "currency_instrument"))
        .drop("currency_instrument")
    )


def resolve_characteristics(instruments: DataFrame, classification: DataFrame) -> DataFrame:
    """Two-key lookup with `matched_by`; blanks and unmatched rows use the keyword rules."""
    base = instruments.select(
        *[clean_text(c).alias(c) for c in ("instrument_id", "ticker", "product")],
        F.upper(clean_text("currency")).alias("currency"),
        F.coalesce("is_etf", F.lit(False)).alias("is_etf"),
        *([F.col("account_label")] if "account_label" in instruments.columns else []),
    )
    cls = (
        classification.withColumn("asset_class", rules.asset_class("asset_class"))
        .withColumn("primary_style", rules.allowed_or_blank("primary_style", rules.PRIMARY_STYLES))
        .withColumn("secondary_factor", rules.allowed_or_blank("secondary_factor", rules.SECONDARY_FACTORS))
    )
    joined = (
        base.join(_first_by_key(cls, "instrument_id", "a"), F.upper("instrument_id") == F.col("a_key"), "left")
        .join(_first_by_key(cls, "ticker", "c"), F.upper("ticker") == F.col("c_key"), "left")
        .withColumn("m", F.coalesce("a", "c"))
        .withColumn(
            "matched_by", F.when(F.col("a").isNotNull(), "instrument_id").when(F.col("c").isNotNull(), "ticker").otherwise("none")
        )
    )

    def given(c):
        return blank_to_null(f"m.{c}")

    style = F.coalesce(given("primary_style"), rules.style_bucket("product", "ticker", "is_etf"))
    multi = F.when(F.col("is_etf"), "Multi-Sector").otherwise("Unclassified")
    return (
        joined.withColumn("raw_style", style)
        .withColumn("gics_industry", F.coalesce(given("gics_industry"), rules.industry_bucket("product", "ticker", "is_etf")))
        .select(
            *[c for c in base.columns if c != "currency"],
            F.coalesce(blank_to_null(F.upper("m.currency")), F.col("currency")).alias("currency"),
            F.coalesce(given("asset_class"), F.when(F.col("is_etf"), "ETF").otherwise("Equity")).alias("asset_class"),
            F.when(F.col("raw_style").isin(*rules.PRIMARY_STYLES), F.col("raw_style")).otherwise("Unclassified").alias(
                "primary_style"
            ),
            F.coalesce(given("secondary_factor"), rules.factor_bucket("product", "ticker", "raw_style")).alias(
                "secondary_factor"
            ),
            F.coalesce(given("gics_sector"), multi).alias("gics_sector"),
            F.coalesce(given("gics_industry_group"), F.col("gics_industry")).alias("gics_industry_group"),
            "gics_industry",
            F.coalesce(given("gics_sub_industry"), F.col("gics_industry")).alias("gics_sub_industry"),
            "matched_by",
        )
    )


def match_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("matched_by").agg(F.count(F.lit(1)).alias("rows"))


def merge_instruments(instruments: DataFrame) -> DataFrame:
    """One row per instrument over all portfolios: first non-blank per attribute by ticker, max of flags."""
    order = F.struct(F.coalesce(blank_to_null("ticker"), F.lit("￿")).alias("t"), F.col("row_seq"))
    return instruments.groupBy("instrument_id").agg(
        *[
            F.nullif(first_text(c, order), F.lit("")).alias(c)
            for c in ("product", "isin", "symbol", "currency", "ticker")
        ],
        F.coalesce(F.bool_or("is_etf"), F.lit(False)).alias("is_etf"),
        F.coalesce(F.bool_or("is_cash_like"), F.lit(False)).alias("is_cash_like"),
    )


def first_instruments(instruments: DataFrame) -> DataFrame:
    """Keep the first row per instrument by row_seq (aggregate form of distinct-by-key)."""
    rest = [c for c in instruments.columns if c != "instrument_id"]
    return (
        instruments.groupBy("instrument_id").agg(F.min_by(F.struct(*rest), "row_seq").alias("r")).select("instrument_id", "r.*")
    )


def unique_labels(labels: DataFrame, key: str = "instrument_id", label: str = "label", start: int = 4) -> DataFrame:
    """Suffix repeated labels with #2, #3, ... in key order.

    Keys are numbered within those that share their first `start` characters, and counts of the smaller beginnings are
    added, so that a label of very many instruments is spread over tasks.
    """
    rows = labels.withColumn("_start", F.substring(F.col(key), 1, start))
    counts = rows.groupBy(label, "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(label).alias("_label"), F.col("_start").alias("_with"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(label, "_start").orderBy(key))
    same = F.col(label).eqNullSafe(F.col("_label")) & F.col("_start").eqNullSafe(F.col("_with"))
    numbered = rows.withColumn("_own", own).join(counts, same).withColumn("n", F.col("_before") + F.col("_own"))
    suffixed = F.when(F.col("n") == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" #"), F.col("n")))
    return numbered.withColumn(label, suffixed).select(*labels.columns)
