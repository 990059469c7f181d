"""Strategy parameters: JSON in, one validated row out, JSON back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfolio.functions.numbers import finite, to_float, to_int

# --- fixed values: defaults of every strategy field --------------------------
DEFAULT_SPLIT = {"target_etf_pct": 45.0, "target_non_etf_pct": 45.0, "target_cash_pct": 10.0}
DEFAULT_ETF_FRACTION = 0.5
DEFAULT_NUMBERS = {
    "max_single_holding_pct": 12.0,
    "max_top5_holdings_pct": 55.0,
    "max_single_currency_pct": 65.0,
    "max_single_industry_pct": 35.0,
    "max_pair_correlation": 0.90,
    "min_over_value_eur": 400.0,
}
DEFAULT_COUNTS = {"desired_etf_holdings": 4, "desired_non_etf_holdings": 12, "min_total_holdings": 12}
DEFAULT_MAPS = {
    "target_currency_pct": {"EUR": 50.0, "USD": 50.0},
    "target_industry_pct": {},
    "target_style_pct": {"Growth": 34.0, "Value": 33.0, "Dividend": 33.0},
}
# ------------------------------------------------------------------------------
_TEXT_FIELDS = [*DEFAULT_SPLIT, "target_etf_fraction", *DEFAULT_NUMBERS, *DEFAULT_COUNTS]
RAW_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT_FIELDS]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in DEFAULT_MAPS]
)


def normalized_split(etf: Column, non_etf: Column, cash: Column) -> Column:
    """Non-negative shares scaled to a sum of 100; all zero means the defaults."""
    parts = [F.greatest(c, F.lit(0.0)) for c in (etf, non_etf, cash)]
    total = parts[0] + parts[1] + parts[2]
    scale = F.try_divide(F.lit(100.0), total)
    return F.struct(
        *[
            F.when(total > 0, p * scale).otherwise(F.lit(default)).alias(name)
            for p, (name, default) in zip(parts, DEFAULT_SPLIT.items())
        ]
    )


def clean_target_map(raw: Column) -> Column:
    """Trim keys, drop blank keys and non-numbers, negatives become 0; of keys that become equal the last stays."""
    pairs = F.transform(
        F.map_entries(raw),
        lambda e: F.struct(
            F.trim(e["key"]).alias("key"), finite(e["value"].cast("string").try_cast("double")).alias("value")
        ),
    )
    kept = F.filter(pairs, lambda e: (e["key"] != "") & e["value"].isNotNull())
    n = F.size(kept)
    later = lambda i: F.exists(F.slice(kept, i + 2, n), lambda o: o["key"] == kept[i]["key"])
    kept = F.filter(F.transform(kept, lambda e, i: F.when(~later(i), e)), lambda e: e.isNotNull())
    keys = F.transform(kept, lambda e: e["key"])
    values = F.transform(kept, lambda e: F.greatest(e["value"], F.lit(0.0)))
    return F.when(raw.isNotNull(), F.map_from_arrays(keys, values))


def resolve_strategy(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fill defaults, migrate the legacy ETF fraction, normalize the split, clean the maps."""
    present = raw.columns
    for name in _TEXT_FIELDS:
        if name not in present:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    for name in DEFAULT_MAPS:
        if name not in present:
            raw = raw.withColumn(name, F.lit(None).cast("map<string,string>"))
    has_split = F.col("target_etf_pct").isNotNull() | F.col("target_non_etf_pct").isNotNull()
    cash = to_float("target_cash_pct", DEFAULT_SPLIT["target_cash_pct"])
    invested = F.greatest(100.0 - F.greatest(cash, F.lit(0.0)), F.lit(0.0))
    fraction = F.least(F.greatest(to_float("target_etf_fraction", DEFAULT_ETF_FRACTION), F.lit(0.0)), F.lit(1.0))
    split = F.when(
        has_split,
        normalized_split(
            to_float("target_etf_pct", DEFAULT_SPLIT["target_etf_pct"]),
            to_float("target_non_etf_pct", DEFAULT_SPLIT["target_non_etf_pct"]),
            cash,
        ),
    ).otherwise(normalized_split(invested * fraction, invested * (1.0 - fraction), cash))

    def default_map(values):
        if not values:
            return F.create_map().cast("map<string,double>")
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

    return raw.withColumn("split", split).select(
        *keep,
        "split.*",
        *[to_int(n, d).alias(n) for n, d in DEFAULT_COUNTS.items()],
        *[to_float(n, d).alias(n) for n, d in DEFAULT_NUMBERS.items()],
        *[F.coalesce(clean_target_map(F.col(n)), default_map(d)).alias(n) for n, d in DEFAULT_MAPS.items()],
    )


_DOCUMENT = T.StructType([*RAW_SCHEMA.fields, T.StructField("strategy", RAW_SCHEMA), T.StructField("broken", T.StringType())])


def parse_documents(documents: DataFrame, keep: tuple[str, ...], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Strategies of JSON documents (one row each, `keep` columns passed on), and the documents that can't be read.

    The fields may sit at the top or under "strategy".  A document that isn't a JSON object is listed with the start of
    its text and gives no strategy; fields of a wrong kind count as missing.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    parsed = documents.select(*keep, F.col(text).alias("_text"), F.from_json(F.trim(F.coalesce(F.col(text), F.lit(""))), _DOCUMENT, options).alias("d"))
    object_like = F.col("_text").rlike(r"^\s*\{")
    bad = ~F.coalesce(object_like, F.lit(False)) | F.col("d").isNull() | F.col("d.broken").isNotNull()
    fields = [f.name for f in RAW_SCHEMA.fields]
    inner = F.col("d.strategy").isNotNull()
    merged = parsed.where(~bad).select(*keep, *[F.when(inner, F.col(f"d.strategy.{f}")).otherwise(F.col(f"d.{f}")).alias(f) for f in fields])
    broken = parsed.where(bad).select(*keep, F.lit("unreadable strategy").alias("label"), F.substring("_text", 1, 60).alias("example"))
    return resolve_strategy(merged, keep), broken


def read_strategies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Strategies of a folder of JSON files, a document each, with their path; and the files that can't be read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_documents(files, ("path",))


def strategy_documents(strategy: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON document per strategy, as `parse_documents` reads it."""
    fields = [c for c in strategy.columns if c not in keep]
    return strategy.select(*keep, F.to_json(F.struct(F.lit(1).alias("version"), F.struct(*fields).alias("strategy"))).alias("text"))


def write_strategy(strategy: DataFrame, path: str) -> None:
    strategy_documents(strategy).write.mode("overwrite").text(path)


def target_rows(strategy: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Target map as (bucket, target_pct) rows; currency keys are upper case."""
    out = strategy.select(*keys, F.explode(column).alias("bucket", "target_pct"))
    return out.withColumn("bucket", F.upper("bucket")) if column == "target_currency_pct" else out
