"""Holdings: aggregation, naming, valuation, ranking and the four report tables.

Holdings are one row per portfolio and instrument after aggregation, so ranking
windows per portfolio and sleeve see at most one row per listed instrument.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.functions.numbers import MONEY, money, money_sum0
from tallyfolio.functions.text import (
    blank_to_null, clean_text, first_text, holding_key, join_distinct,
)
from tallyfolio.operators.ranks import numbered
from tallyfolio.session import materialize

ACCOUNT = "account_label"
NAME_KEYS = ["instrument_id", "isin", "ticker", "is_etf"]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join in which NULL keys match, still hash-partitionable."""
    r = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"_{k}" for k in keys])


def unified_product_names(holdings: DataFrame) -> DataFrame:
    """The first product name of each instrument replaces its variants.

    "First" is the smallest row_seq; found by aggregation and joined back, so a very
    common instrument is never sorted in one task.
    """
    chosen = holdings.groupBy(*NAME_KEYS).agg(
        F.min_by(clean_text("product"), "row_seq").alias("chosen"),
        F.countDistinct(clean_text("product")).alias("variants"),
    )
    renamed = _null_safe_join(holdings, chosen, NAME_KEYS)
    return renamed.withColumn(
        "product", F.when(F.col("variants") > 1, F.col("chosen")).otherwise(F.col("product"))
    ).drop("chosen", "variants")


def product_name_variants(holdings: DataFrame) -> DataFrame:
    """Instruments with several product names: occurrences per name and portfolio.

    Long form, so a name used by very many portfolios is many rows, not one huge row.
    """
    rows = holdings.withColumn("product", clean_text("product"))
    chosen = (
        rows.groupBy(*NAME_KEYS)
        .agg(F.min_by("product", "row_seq").alias("chosen_product"), F.countDistinct("product").alias("names"))
        .where(F.col("names") > 1)
        .drop("names")
    )
    per_name = rows.groupBy(*NAME_KEYS, "product", ACCOUNT).agg(F.count(F.lit(1)).alias("occurrences"))
    return _null_safe_join(per_name, chosen, NAME_KEYS, "inner")


def snapshot_name_conflicts(snapshot: DataFrame) -> DataFrame:
    """Instruments whose snapshot names differ beyond case and spacing, with every source row."""
    rows = (
        snapshot.where(~F.coalesce("is_cash_like", F.lit(False)))
        .select(
            ACCOUNT,
            F.trim(F.coalesce("instrument_id", F.lit(""))).alias("instrument_id"),
            F.trim(F.coalesce("ticker", F.lit(""))).alias("ticker"),
            F.trim(F.coalesce("product", F.lit(""))).alias("product"),
            *([F.col("portfolio_source")] if "portfolio_source" in snapshot.columns else []),
        )
        .where((F.col("instrument_id") != "") & (F.col("product") != ""))
        .dropDuplicates()
    )
    folded = F.lower(F.regexp_replace("product", r"\s+", " "))
    conflicts = (
        rows.groupBy("instrument_id")
        .agg(F.countDistinct(folded).alias("names"), F.min(blank_to_null("ticker")).alias("conflict_ticker"))
        .where(F.col("names") > 1)
    )
    return rows.drop("ticker").dropDuplicates().join(conflicts.drop("names"), "instrument_id").withColumn(
        "conflict_ticker", F.coalesce("conflict_ticker", F.lit(""))
    )


def aggregate_holdings(holdings: DataFrame, per_account: bool = True) -> DataFrame:
    """One row per instrument (and portfolio): summed quantity and value, joined currencies.

    Over all portfolios together the distinct holders are counted and their labels joined, in order; `holders` lists them as rows.
    """
    keys = [*([ACCOUNT] if per_account else []), "instrument_id", "product", "isin", "ticker", "is_etf"]
    extra = [] if per_account else [F.collect_set(ACCOUNT).alias("labels")]
    out = holdings.groupBy(*keys).agg(
        *extra,
        join_distinct("currency").alias("currency"),
        money_sum0("quantity").alias("quantity"),
        money_sum0("value_eur").alias("value_eur"),
    )
    if per_account:
        return out
    named = F.array_distinct(F.array_compact(F.transform("labels", blank_to_null)))
    joined = F.array_join(F.array_sort(named), ", ").alias(ACCOUNT)
    return out.select(*keys, joined, F.size("labels").cast("bigint").alias("portfolio_count"), "currency", "quantity", "value_eur")


def holders(holdings: DataFrame) -> DataFrame:
    """Which portfolios hold an instrument, one row each."""
    label = blank_to_null(ACCOUNT)
    return holdings.where(label.isNotNull()).select("instrument_id", label.alias(ACCOUNT)).dropDuplicates()


CLASS_COLUMNS = (
    "asset_class", "primary_style", "secondary_factor", "gics_sector",
    "gics_industry_group", "gics_industry", "gics_sub_industry",
)


def open_filter(quantity="quantity", value="value_eur"):
    return (F.abs(F.coalesce(F.col(quantity), F.lit(0.0))) > 1e-9) | (
        F.abs(F.coalesce(F.col(value), F.lit(0.0))) > 1e-6
    )


def holdings_for_spread(holdings: DataFrame) -> DataFrame:
    """Open holdings per portfolio and instrument with the first non-blank class attributes."""
    clean = holdings.select(
        ACCOUNT,
        F.coalesce("instrument_id", F.lit("")).alias("instrument_id"),
        F.trim(F.coalesce("product", F.lit(""))).alias("product"),
        F.trim(F.coalesce("ticker", F.lit(""))).alias("ticker"),
        F.coalesce(blank_to_null(F.upper("currency")), F.lit("UNKNOWN")).alias("currency"),
        F.coalesce("is_etf", F.lit(False)).alias("is_etf"),
        "quantity",
        F.coalesce("value_eur", F.lit(0.0)).alias("value_eur"),
        (F.col("row_seq") if "row_seq" in holdings.columns else F.lit(0)).alias("row_seq"),
        *[F.col(c) if c in holdings.columns else F.lit("").alias(c) for c in CLASS_COLUMNS],
    )
    order = F.struct("row_seq")
    return (
        clean.groupBy(ACCOUNT, "instrument_id", "product", "ticker", "currency", "is_etf")
        .agg(
            money_sum0("quantity").alias("quantity"),
            money_sum0("value_eur").alias("value_eur"),
            *[first_text(c, F.struct(order, F.col(c))).alias(c) for c in CLASS_COLUMNS],
        )
        .where(open_filter())
    )


def latest_valued_holdings(
    aggregated: DataFrame, latest_quantity: DataFrame, latest_price: DataFrame, instruments: DataFrame
) -> DataFrame:
    """Latest quantity x latest price, falling back to the snapshot's own numbers.

    Positions held but absent from the snapshot are appended with their instrument data.  `latest_quantity` is
    (account_label, instrument_id, latest_quantity), `latest_price` is (instrument_id, latest_price_eur).

    Both meet as rows of one key instead of in joins, so tables that are dealt by instrument stay where they are.
    """
    keys = [ACCOUNT, "instrument_id"]
    cols = [*keys, "product", "isin", "ticker", "is_etf", "currency", "quantity", "value_eur"]
    of = F.col("instrument_id").alias("of")  # a column of its own in both: Spark sees that they are dealt alike
    listed = aggregated.select(of, *[c for c in cols if c != "instrument_id"], F.lit(None).cast("double").alias("latest"), F.lit(False).alias("is_held"))
    held = latest_quantity.select(of, ACCOUNT, F.col("latest_quantity").cast("double").alias("latest"), F.lit(True).alias("is_held"))
    pair = Window.partitionBy("of", ACCOUNT)
    known = F.col("of").isNotNull() & F.col(ACCOUNT).isNotNull()  # missing keys match none
    rows = listed.unionByName(held, allowMissingColumns=True).select(
        "*", F.when(known, F.max("latest").over(pair)).alias("latest_quantity"), F.when(known, F.min("is_held").over(pair)).alias("absent")
    )
    rows = rows.where(~F.col("is_held") | (F.coalesce("absent", F.lit(True)) & (F.abs("latest") > 1e-12)))
    meta = instruments.select("instrument_id", *[F.col(c).alias(f"own_{c}") for c in ("product", "isin", "ticker", "is_etf", "currency")])
    rows = rows.join(meta, F.col("is_held") & (F.col("of") == F.col("instrument_id")), "left").drop("instrument_id").withColumnRenamed("of", "instrument_id")
    missing = {"product": F.col("instrument_id"), "isin": F.col("instrument_id"), "ticker": F.lit(""), "is_etf": F.lit(False), "currency": F.lit("")}
    rows = rows.withColumns({c: F.when(F.col("is_held"), F.coalesce(f"own_{c}", other)).otherwise(F.col(c)) for c, other in missing.items()})
    rows = rows.join(latest_price, "instrument_id", "left")
    raw_quantity, raw_value = F.abs("quantity"), F.abs("value_eur")
    own_price = F.when(raw_quantity > 1e-12, raw_value / raw_quantity)
    quantity = F.abs(F.coalesce("latest_quantity", "quantity"))
    price = F.coalesce(F.col("latest_price_eur"), own_price)
    return rows.select(
        *keys,
        "product",
        "isin",
        "ticker",
        "is_etf",
        "currency",
        quantity.alias("quantity"),
        price.alias("last_px_eur"),
        F.abs(F.coalesce(quantity * price, raw_value, F.lit(0.0))).alias("value_eur"),
    )


def latest_prices(events: DataFrame) -> DataFrame:
    """Newest EUR price and its date per instrument."""
    priced = events.where(F.col("price_eur").isNotNull())
    return priced.groupBy("instrument_id").agg(
        F.max_by("price_eur", "date").alias("latest_price_eur"), F.max("date").alias("latest_price_date")
    )


def latest_quantities(trades: DataFrame, keys=(ACCOUNT, "instrument_id")) -> DataFrame:
    return trades.groupBy(*keys).agg(F.sum("net_quantity").alias("latest_quantity"))


def ranked_targets(holdings: DataFrame, strategy: DataFrame, partition: list[str], dealt: bool = False) -> DataFrame:
    """Rank by value inside each sleeve; the first N share the sleeve target equally.

    `strategy` has one row, or one per portfolio when it carries account_label.  `dealt`: holdings lie in buckets of `partition`.
    """
    order = [F.col("value_eur").desc_nulls_last(), F.col("instrument_id"), F.col("product"), F.col("ticker")]
    wanted = F.greatest(
        F.when(F.col("is_etf"), F.col("desired_etf_holdings")).otherwise(F.col("desired_non_etf_holdings")), F.lit(0)
    )
    target = F.when(F.col("is_etf"), F.col("target_etf_pct")).otherwise(F.col("target_non_etf_pct"))
    out = holdings.withColumn("is_etf", F.coalesce("is_etf", F.lit(False)))
    out = numbered(out, [*partition, "is_etf"], order, "target_rank_in_segment", by=partition, dealt=dealt)
    pick = ["target_etf_pct", "target_non_etf_pct", "desired_etf_holdings", "desired_non_etf_holdings"]
    joined = with_strategy(out, strategy, pick)
    kept = (wanted > 0) & (F.col("target_rank_in_segment") <= wanted)
    return joined.withColumn(
        "target_per_holding_pct", F.when(kept, F.try_divide(target, wanted)).otherwise(0.0)
    ).drop(*pick)


def with_strategy(rows: DataFrame, strategy: DataFrame, columns: list[str]) -> DataFrame:
    """Attach strategy columns: by portfolio, or the single shared row as scalars.

    The shared strategy is one row by contract, so it is read as plan parameters.
    """
    if ACCOUNT in strategy.columns:
        return rows.join(strategy.select(ACCOUNT, *columns), ACCOUNT, "left")
    row = strategy.select(*columns).first()
    for c in columns:
        v = row[c]
        if isinstance(v, dict):
            lit = F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) if v else F.create_map()
            rows = rows.withColumn(c, lit.cast("map<string,double>"))
        else:
            rows = rows.withColumn(c, F.lit(v))
    return rows


def with_targets(holdings: DataFrame, totals: DataFrame, strategy: DataFrame, dealt: bool = False) -> DataFrame:
    """Weights, per-holding targets and excess against each portfolio's total value."""
    ranked = ranked_targets(holdings, strategy, [ACCOUNT], dealt)
    total = F.col("total_value_eur")
    return (
        ranked.join(totals.select(ACCOUNT, "total_value_eur"), ACCOUNT)
        .withColumn("value_pct", F.try_divide("value_eur", total) * 100.0)
        .withColumn("target_value_eur", F.col("target_per_holding_pct") / 100.0 * total)
        .withColumn("over_target_eur", F.col("value_eur") - F.col("target_value_eur"))
    )


def holdings_catalog(targeted: DataFrame, strategy: DataFrame) -> DataFrame:
    """Status columns of every holding."""
    over = F.coalesce("over_target_eur", F.lit(0.0))
    rows = with_strategy(targeted, strategy, ["min_over_value_eur"])
    flag = over > F.col("min_over_value_eur")
    return (
        rows.withColumn("is_over_target_threshold", flag)
        .withColumn(
            "target_status",
            F.when(over > 1e-9, "Over target").when(over < -1e-9, "Under target").otherwise("At target"),
        )
        .withColumn("threshold_status", F.when(flag, "Above threshold").otherwise("At/below threshold"))
        .withColumn("holding_type", F.when(F.col("is_etf"), "ETF").otherwise("Non-ETF"))
        .drop("min_over_value_eur")
    )


def ordered_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog position: ETF first, value descending, ticker ascending, missing last."""
    order = [
        F.col("is_etf").desc_nulls_last(), F.col("value_eur").desc_nulls_last(), F.col("ticker").asc_nulls_last(), F.col("instrument_id"),
    ]
    return numbered(catalog, [ACCOUNT], order, "position")


def filter_catalog(
    catalog: DataFrame,
    holding_types: list[str] | None = None,
    target_statuses: list[str] | None = None,
    threshold_statuses: list[str] | None = None,
    text: str = "",
) -> DataFrame:
    out = catalog
    for column, wanted in (
        ("holding_type", holding_types),
        ("target_status", target_statuses),
        ("threshold_status", threshold_statuses),
    ):
        if wanted is not None:
            out = out.where(F.col(column).isin(*wanted))
    needle = text.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", F.coalesce("ticker", F.lit("")), F.coalesce("product", F.lit(""))))
        out = out.where(hay.contains(needle))
    return out


def over_target(targeted: DataFrame, strategy: DataFrame) -> DataFrame:
    rows = with_strategy(targeted, strategy, ["min_over_value_eur"])
    return rows.where(F.col("over_target_eur") > F.col("min_over_value_eur")).drop("min_over_value_eur")


def sleeve_values(holdings: DataFrame) -> DataFrame:
    """ETF and non-ETF value and distinct holding counts per portfolio."""
    etf, known = F.coalesce("is_etf", F.lit(False)), F.col("instrument_id").isNotNull()
    # one row per holding first: distinct counts of three kinds would multiply the rows by four
    per = holdings.groupBy(ACCOUNT, "instrument_id").agg(
        F.sum(F.when(etf, money("value_eur"))).alias("etf_value"),
        F.sum(F.when(~etf, money("value_eur"))).alias("non_etf_value"),
        F.max(etf).alias("etf"),
        F.max(~etf).alias("non_etf"),
    )
    zero = F.lit(0).cast(MONEY)
    return per.groupBy(ACCOUNT).agg(
        F.coalesce(F.sum("etf_value"), zero).cast("double").alias("etf_value"),
        F.coalesce(F.sum("non_etf_value"), zero).cast("double").alias("non_etf_value"),
        F.count_if(known & F.col("etf")).alias("etf_count"),
        F.count_if(known & F.col("non_etf")).alias("non_etf_count"),
        F.count_if(known).alias("total_holdings"),
    )


def cash_split(totals: DataFrame, sleeves: DataFrame, strategy: DataFrame) -> DataFrame:
    """Deploy cash above target to the sleeves by gap; refill a shortfall from the sleeves by excess.

    Without any gap the target shares decide, without any excess the current values.
    """
    pick = ["target_etf_pct", "target_non_etf_pct", "target_cash_pct"]
    rows = with_strategy(
        totals.select(ACCOUNT, "total_value_eur", "cash_value_eur").join(
            sleeves.select(ACCOUNT, "etf_value", "non_etf_value"), ACCOUNT, "left"
        ),
        strategy,
        pick,
    ).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("etf_value", "non_etf_value")})
    zero, total, cash = F.lit(0.0), F.col("total_value_eur"), F.col("cash_value_eur")

    def part(x):
        return F.greatest(x, zero)

    def share(amount, of, total_of, fallback, total_fallback):
        return F.when(amount > 0, F.when(total_of > 0, amount * of / total_of).when(
            total_fallback > 0, amount * fallback / total_fallback
        ).otherwise(zero)).otherwise(zero)

    rows = rows.withColumns(
        {
            "target_etf_value": F.col("target_etf_pct") / 100.0 * total,
            "target_non_etf_value": F.col("target_non_etf_pct") / 100.0 * total,
            "target_cash_eur": F.col("target_cash_pct") / 100.0 * total,
        }
    ).withColumns(
        {
            "deployable_cash_eur": part(cash - F.col("target_cash_eur")),
            "cash_shortfall_eur": part(F.col("target_cash_eur") - cash),
            "gap_e": part(F.col("target_etf_value") - F.col("etf_value")),
            "gap_n": part(F.col("target_non_etf_value") - F.col("non_etf_value")),
            "exc_e": part(F.col("etf_value") - F.col("target_etf_value")),
            "exc_n": part(F.col("non_etf_value") - F.col("target_non_etf_value")),
        }
    )
    free, short = F.col("deployable_cash_eur"), F.col("cash_shortfall_eur")
    gaps, excess = F.col("gap_e") + F.col("gap_n"), F.col("exc_e") + F.col("exc_n")
    wanted, current = F.col("target_etf_pct") + F.col("target_non_etf_pct"), F.col("etf_value") + F.col("non_etf_value")
    return rows.select(
        ACCOUNT,
        total,
        cash.alias("cash_eur"),
        "etf_value",
        "non_etf_value",
        "target_etf_value",
        "target_non_etf_value",
        "target_cash_eur",
        "deployable_cash_eur",
        share(free, F.col("gap_e"), gaps, F.col("target_etf_pct"), wanted).alias("to_etf_eur"),
        share(free, F.col("gap_n"), gaps, F.col("target_non_etf_pct"), wanted).alias("to_non_etf_eur"),
        "cash_shortfall_eur",
        share(short, F.col("exc_e"), excess, F.col("etf_value"), current).alias("from_etf_to_cash_eur"),
        share(short, F.col("exc_n"), excess, F.col("non_etf_value"), current).alias("from_non_etf_to_cash_eur"),
        (F.try_divide("etf_value", total) * 100.0).alias("etf_w_pct"),
        (F.try_divide("non_etf_value", total) * 100.0).alias("non_etf_w_pct"),
    )


# --- fixed values: the 13 rows of the summary table, in order ----------------
SUMMARY_ROWS = [
    ("combined value", "total_value_eur"),
    ("non-ETF value", "non_etf_value"),
    ("ETF value", "etf_value"),
    ("cash position", "cash_eur"),
    ("target non-ETF value", "target_non_etf_value"),
    ("target ETF value", "target_etf_value"),
    ("target cash position", "target_cash_eur"),
    ("suggested EUR to ETF for next purchases", "to_etf_eur"),
    ("suggested EUR to non-ETF for next purchases", "to_non_etf_eur"),
    ("suggested EUR from ETF to cash", "from_etf_to_cash_eur"),
    ("suggested EUR from non-ETF to cash", "from_non_etf_to_cash_eur"),
    ("check ETF + non-ETF + cash", "identity_total"),
    ("identity delta (should be 0)", "identity_delta"),
]


def summary_table(split: DataFrame) -> DataFrame:
    rows = split.withColumn(
        "identity_total", F.col("etf_value") + F.col("non_etf_value") + F.col("cash_eur")
    ).withColumn("identity_delta", F.col("identity_total") - F.col("total_value_eur"))
    metrics = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value_eur"))
            for i, (m, c) in enumerate(SUMMARY_ROWS, 1)
        ]
    )
    return rows.select(ACCOUNT, F.explode(metrics).alias("m")).select(ACCOUNT, "m.*")


def value_from_summary(summary: DataFrame, metric: str) -> DataFrame:
    return summary.where(F.col("metric") == metric).select(ACCOUNT, "value_eur")


def four_tables(holdings: DataFrame, totals: DataFrame, strategy: DataFrame) -> dict[str, DataFrame]:
    targeted = with_targets(holdings, totals, strategy)
    return {
        "etf": targeted.where(F.col("is_etf")),
        "non_etf": targeted.where(~F.col("is_etf")),
        "summary": summary_table(cash_split(totals, sleeve_values(holdings), strategy)),
        "over_target": over_target(targeted, strategy),
    }


def flag_over_target(segment: DataFrame, over: DataFrame) -> DataFrame:
    """Mark segment rows whose composite key is in the over-target table.

    Both meet as rows of one key instead of in a join, so tables that are dealt by portfolio stay where they are.
    """
    key = holding_key("isin", "product", "ticker")
    of = F.col(ACCOUNT).alias("of")  # a column of its own in both: Spark sees that they are dealt alike
    marks = over.select(of, key.alias("k"), F.col("over_target_eur").alias("over_value"), F.lit(True).alias("is_mark"))
    rows = segment.select(
        of, *[c for c in segment.columns if c not in (ACCOUNT, "over_target_eur")],
        key.alias("k"), F.lit(None).cast("double").alias("over_value"), F.lit(False).alias("is_mark"),
    )
    # a missing portfolio is none that the over-target table can name
    found = F.when(F.col("of").isNotNull(), F.max("over_value").over(Window.partitionBy("of", "k")))
    return (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn("found", found)
        .withColumnRenamed("of", ACCOUNT)
        .where(~F.col("is_mark"))
        .withColumn("over_target_eur", F.coalesce("found", F.lit(0.0)))
        .withColumn("is_over_target_threshold", F.col("found").isNotNull())
        .drop("k", "over_value", "is_mark", "found")
    )


def over_target_counts(segments: DataFrame) -> DataFrame:
    key = holding_key("isin", "product", "ticker")
    over = F.when(F.col("is_over_target_threshold"), key)
    per = segments.groupBy(ACCOUNT, over.alias("k")).agg(
        F.max(F.coalesce("is_etf", F.lit(False))).alias("etf"), F.max(F.coalesce(~F.col("is_etf"), F.lit(False))).alias("non_etf")
    )
    marked = F.col("k").isNotNull()
    return per.groupBy(ACCOUNT).agg(
        F.count_if(marked & F.col("etf")).alias("etf_over_count"), F.count_if(marked & F.col("non_etf")).alias("non_etf_over_count")
    )


def holdings_report(
    snapshot: DataFrame, totals: DataFrame, latest_price: DataFrame, cost_basis: DataFrame, dealt: bool = False
) -> DataFrame:
    """Quantity, latest price, value, cost basis, profit and weight per open holding.

    `dealt`: the snapshot lies in buckets of instrument_id, which no row lacks.
    """
    clean = snapshot.where(~F.coalesce("is_cash_like", F.lit(False))).select(
        ACCOUNT,
        F.col("instrument_id") if dealt else F.coalesce("instrument_id", F.lit("")).alias("instrument_id"),
        F.trim(F.coalesce("ticker", F.lit(""))).alias("ticker"),
        F.trim(F.coalesce("product", F.lit(""))).alias("product"),
        F.coalesce("is_etf", F.lit(False)).alias("is_etf"),
        "quantity",
        F.abs(F.coalesce("value_eur", F.lit(0.0))).alias("value_eur"),
    )
    # dealt by instrument once: the grouping and both joins on it follow from that (an instrument has a row per portfolio)
    grouped = (
        (clean if dealt else clean.repartition("instrument_id"))
        .groupBy(ACCOUNT, "instrument_id", "ticker", "product", "is_etf")
        .agg(money_sum0("quantity").alias("qty"), money_sum0("value_eur").alias("snap_value"))
        .where(open_filter("qty", "snap_value"))
    )
    qty = F.abs("qty")
    price = F.coalesce("latest_price_eur", F.when(qty > 1e-12, F.abs("snap_value") / qty))
    keys = [c for c in (ACCOUNT, "instrument_id") if c in cost_basis.columns]
    return (
        # one row per instrument: hashed, so that the holdings need no sort
        grouped.join(latest_price.hint("shuffle_hash"), "instrument_id", "left")
        .join(cost_basis.select(*keys, "cost_basis_eur").hint("shuffle_hash"), keys, "left")
        .join(totals.select(ACCOUNT, "total_value_eur"), ACCOUNT, "left")
        .withColumn("last_px_eur", price)
        .withColumn("value_eur", F.coalesce(qty * F.col("last_px_eur"), F.abs("snap_value")))
        .select(
            ACCOUNT,
            "instrument_id",
            "ticker",
            "product",
            "is_etf",
            F.rint(qty).cast("bigint").alias("qty"),
            "last_px_eur",
            F.coalesce(F.date_format("latest_price_date", "yyyy-MM-dd"), F.lit("")).alias("px_date"),
            "value_eur",
            "cost_basis_eur",
            (F.col("value_eur") - F.col("cost_basis_eur")).alias("pnl_eur"),
            F.when(F.col("total_value_eur") > 0, F.col("value_eur") / F.col("total_value_eur") * 100.0).alias(
                "value_pct"
            ),
        )
    )


def trim_actions(report: DataFrame, totals: DataFrame, strategy: DataFrame) -> DataFrame:
    """Over-target holdings with the quantity to sell."""
    # ranking reads its rows more than once
    report = materialize(report.select(ACCOUNT, "instrument_id", "ticker", "product", "is_etf", "qty", "last_px_eur", "value_eur"), "trim-report")
    rows = over_target(with_targets(report, totals.where(F.col("total_value_eur") > 0), strategy), strategy)
    return rows.select(
        ACCOUNT,
        "instrument_id",
        "ticker",
        "product",
        F.when(F.col("is_etf"), "ETF").otherwise("Non-ETF").alias("segment"),
        "qty",
        F.col("value_pct").alias("w_pct"),
        F.col("target_per_holding_pct").alias("target_pct"),
        F.col("over_target_eur").alias("over_eur"),
        F.when(F.col("last_px_eur") > 1e-12, F.col("over_target_eur") / F.col("last_px_eur")).alias("sell_qty"),
    )


def action_required(split: DataFrame, trims: DataFrame) -> DataFrame:
    """One flag per portfolio: deployable cash, a shortfall or anything to trim."""
    counts = trims.groupBy(ACCOUNT).agg(F.count(F.lit(1)).alias("trim_count"))
    return split.join(counts, ACCOUNT, "left").select(
        ACCOUNT,
        "deployable_cash_eur",
        "cash_shortfall_eur",
        F.coalesce("trim_count", F.lit(0)).alias("trim_count"),
        (
            (F.col("deployable_cash_eur") > 1e-6)
            | (F.col("cash_shortfall_eur") > 1e-6)
            | F.col("trim_count").isNotNull()
        ).alias("action_required"),
    )


def recent_trades(tx: DataFrame, instruments: DataFrame, latest_price: DataFrame, n: int = 5) -> DataFrame:
    """The n latest buys and sells per portfolio with price incl. costs and latest known price.

    The rank filter lets Spark keep only n rows per portfolio and side in each map task.
    """
    rows = tx.where(F.col("datetime").isNotNull() & (F.col("quantity") != 0))
    if "is_cash_like" in tx.columns:
        rows = rows.where(~F.coalesce("is_cash_like", F.lit(False)))
    side = F.when(F.col("quantity") > 0, "Buy").otherwise("Sell")
    newest = Window.partitionBy(ACCOUNT, "side").orderBy(
        F.col("datetime").desc(), F.col("row_seq").desc(), F.col("quantity").desc(), F.col("total_eur").desc()
    )
    top = rows.withColumn("side", side).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)
    qty, gross, fees = F.abs("quantity"), F.abs("total_eur"), F.abs(F.coalesce("fees_eur", F.lit(0.0)))
    paid = F.when(F.col("side") == "Buy", gross + fees).otherwise(F.greatest(gross - fees, F.lit(0.0)))
    return (
        top.join(instruments.select("instrument_id", "product", "ticker"), "instrument_id", "left")
        .join(latest_price, "instrument_id", "left")
        .select(
            ACCOUNT,
            "side",
            "rn",
            F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
            "product",
            "ticker",
            F.rint(qty).cast("bigint").alias("quantity"),
            F.round(F.when(qty > 1e-12, paid / qty).cast("decimal(28,10)"), 2).cast("double").alias("trade_price_eur_incl_costs"),
            F.col("latest_price_eur").alias("latest_known_price_eur"),
            F.coalesce(F.date_format("latest_price_date", "yyyy-MM-dd"), F.lit("")).alias("latest_known_price_date"),
            "total_eur",
        )
    )


def positive_slices(allocation: DataFrame, category: str, value: str) -> DataFrame:
    """Chart slices: positive values only, blank category as Unclassified."""
    name = F.coalesce(blank_to_null(category), F.lit("Unclassified"))
    return allocation.withColumn(category, name).where(F.coalesce(value, F.lit(0.0)) > 0)


def sleeve_slices(holdings: DataFrame, totals: DataFrame) -> DataFrame:
    """Holding slices with shares of the portfolio and of their sleeve."""
    rows = holdings.where(F.col("value_eur") > 0)
    label = F.coalesce(blank_to_null("ticker"), blank_to_null("product"), blank_to_null("isin"), F.lit("Unlabeled holding"))
    sleeves = rows.groupBy(ACCOUNT, "is_etf").agg(money_sum0("value_eur").alias("sleeve_total"))
    total = F.when(F.col("total_value_eur") > 0, F.col("total_value_eur")).otherwise(F.col("sleeve_total"))
    return (
        rows.join(sleeves, [ACCOUNT, "is_etf"])
        .join(totals.select(ACCOUNT, "total_value_eur"), ACCOUNT, "left")
        .select(
            ACCOUNT,
            "instrument_id",
            "is_etf",
            label.alias("label"),
            "value_eur",
            (F.col("value_eur") / total * 100.0).alias("portfolio_pct"),
            (F.col("value_eur") / F.col("sleeve_total") * 100.0).alias("sleeve_pct"),
        )
    )


def peak_values(position_values: DataFrame) -> DataFrame:
    """Instruments by their highest daily value."""
    return position_values.groupBy("instrument_id").agg(F.max("value_eur").alias("peak_value_eur"))


def delta_flag(column: str):
    """Cent-rounded delta that is present and not zero."""
    return F.coalesce(F.round(F.col(column), 2) != 0.0, F.lit(False))
