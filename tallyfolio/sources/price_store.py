"""Price and FX history as a partitioned table: pruned scans, upserts that rewrite only what they touch.

Rows (ticker, date, close, load_seq) are partitioned by a hash bucket of the ticker, so neither the number of folders
nor the size of one grows with the number of tickers alone; `buckets` is the table's parameter and part of its layout.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.session import tasks_for

BUCKETS = 64
_COLUMNS = ["ticker", "date", "close", "load_seq"]


def bucket_of(ticker: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(buckets)).cast("int")


def latest_loads(rows: DataFrame) -> DataFrame:
    """One row per ticker and day: the last load wins."""
    keys = [c for c in ("bucket", "ticker", "date") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.max_by("close", "load_seq").alias("close"), F.max("load_seq").alias("load_seq"))


def _written(rows: DataFrame, path: str, dynamic: bool) -> None:
    # rebalance keeps one bucket's rows together and splits a bucket that is too large for one file
    out = rows.select(*_COLUMNS, "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
    (out.option("partitionOverwriteMode", "dynamic") if dynamic else out).parquet(path)


def write_prices(prices: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new table, whatever was there before."""
    _written(latest_loads(prices.withColumn("bucket", bucket_of(F.col("ticker"), buckets))), path, dynamic=False)


def upsert_prices(fetched: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Merge fetched rows into the table, last load first per ticker and day.

    Only partitions with a fetched ticker are read and rewritten.  Their new files are staged and take the old ones' place
    when all tasks have ended, so a job that fails leaves the table as it was; running it again changes nothing.
    """
    new = fetched.select(*_COLUMNS).where(F.length("ticker") > 0).withColumn("bucket", bucket_of(F.col("ticker"), buckets))
    touched = dict(new.groupBy("bucket").count().collect())  # at most `buckets` rows
    if touched:
        old = fetched.sparkSession.read.parquet(path).where(F.col("bucket").isin(list(touched)))
        # nearly all keys differ within a file, so adding up before the shuffle would fill memory for nothing
        tasks = tasks_for(fetched.sparkSession, old.count() + sum(touched.values()))
        rows = old.select(*_COLUMNS, "bucket").unionByName(new).repartition(tasks, "bucket", "ticker", "date")
        _written(latest_loads(rows), path, dynamic=True)


def scan_prices(spark: SparkSession, path: str, wanted: DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the wanted tickers (a table with `ticker`; none: all) between two days.

    The bucket is part of the join, so partitions without a wanted ticker are not read (dynamic partition pruning); the
    days reach the files' statistics."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    if wanted is not None:
        names = wanted.select("ticker").where(F.length("ticker") > 0).distinct()
        rows = rows.join(names.withColumn("bucket", bucket_of(F.col("ticker"), buckets)), ["bucket", "ticker"], "left_semi")
    return rows.select(*_COLUMNS)


def scan_fx(spark: SparkSession, path: str, currencies: DataFrame, start: dt.date, end: dt.date, buckets: int = BUCKETS) -> DataFrame:
    """(currency, date, eur_per_unit) of the wanted currencies, read as tickers like USDEUR=X; EUR is 1 on every day."""
    names = currencies.select(F.upper(F.trim("currency")).alias("currency")).distinct()
    quoted = names.where("currency <> 'EUR'").select(F.concat("currency", F.lit("EUR=X")).alias("ticker"))
    rows = scan_prices(spark, path, quoted, start, end, buckets).select(F.substring("ticker", 1, 3).alias("currency"), "date", F.col("close").alias("eur_per_unit"))
    eur = names.where("currency = 'EUR'").select("currency", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"), F.lit(1.0).alias("eur_per_unit"))
    return rows.unionByName(eur)
