"""Registered queries: export repair, column inference, FX repair, dimensions and sources."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.functions.text import holding_label, truncate_text
from tallyfolio.operators import fx_repair, instruments, normalize, timeseries
from tallyfolio.plans.registry import ORACLES, query
from tallyfolio.plans.sample_sql import money_sum0
from tallyfolio.plans.sample_views import SampleViews
from tallyfolio.plans.series_queries import eur_events, span
from tallyfolio.session import materialize, shared_folder, tasks_for
from tallyfolio.sources import exports, price_store, tables
from tallyfolio.sources.strategy import parse_documents, resolve_strategy, strategy_documents, target_rows

SUM0 = money_sum0


def _folder(key):
    return F.concat(F.lit("/exports/P"), F.floor(key / 10).cast("string"), F.lit("/Account.csv"))


def _with_header(rows: DataFrame, names: list[str]) -> DataFrame:
    header = rows.select("path").distinct().select("path", F.lit(0).cast("bigint").alias("row_seq"), F.array(*[F.lit(n) for n in names]).alias("cells"))
    return header.unionByName(rows.select("path", "row_seq", "cells"))


def broken_export(v: SampleViews) -> DataFrame:
    """Each order becomes a ledger row torn into five lines."""
    orders = v.table("orders")
    o = orders.withColumn("path", _folder(F.col("o_custkey"))).repartition(tasks_for(v.spark, orders.count()), "path")
    rank = F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey"))
    key = F.col("o_orderkey").cast("string")

    def line(date="", time="", product="", description="", amount="", order=""):
        return F.array(*[x if not isinstance(x, str) else F.lit(x) for x in (date, time, product, description, amount, order)])

    head = line(F.date_format("o_orderdate", "dd-MM-yyyy"), "10:00", F.col("o_orderpriority"), F.concat(F.lit("Koop "), key), F.col("o_totalprice").cast("string"), F.concat(F.lit("ord-"), key))
    tails = [line(product=F.col("o_orderstatus")), line(description="stuks"), line(description="9,94 USD"), line(order="-x")]
    torn = F.posexplode(F.array(head, *tails)).alias("i", "cells")
    rows = o.withColumn("rank", rank).select("path", "rank", torn).select("path", ((F.col("rank") - 1) * 5 + 1 + F.col("i")).cast("bigint").alias("row_seq"), "cells")
    return _with_header(rows, ["Date", "Time", "Product", "Description", "Amount", "Order Id"])


@query(
    "continuation_repair",
    "",
    """SELECT 'ord-' || o_orderkey || '-x' AS order_id, 'P' || CAST(o_custkey // 10 AS VARCHAR) AS account_label, strftime(o_orderdate, '%d-%m-%Y') AS date_text, o_orderpriority || ' ' || o_orderstatus AS product, 'Koop ' || o_orderkey || ' stuks' AS description FROM orders""",
    "order_id account_label date_text product description",
)
def continuation_repair(v):
    """Torn export lines merged back into whole rows."""
    fixed = exports.repair_rows(broken_export(v)).where(F.col("row_seq") > 0)
    at = {"date_text": 0, "product": 2, "description": 3, "order_id": 5}
    return fixed.select(exports.account_label(F.col("path")).alias("account_label"), *[F.get("cells", F.lit(i)).alias(n) for n, i in at.items()])


def raw_exports(v: SampleViews) -> DataFrame:
    """The ledger as export cells; odd portfolios put the currency before the amount."""
    n = F.regexp_extract("account_label", r"(\d+)", 1).cast("bigint")
    text = F.translate(F.format_string("%.2f", F.col("raw_change")), ".", ",")
    balance = F.translate(F.format_string("%.2f", F.col("raw_balance")), ".", ",")
    rate = F.coalesce(F.translate(F.format_string("%.3f", F.col("fx_rate")), ".", ","), F.lit(""))
    swap = n % 2 == 1

    def pair(amount):
        return [F.when(swap, F.col("currency")).otherwise(amount), F.when(swap, amount).otherwise(F.col("currency"))]

    rows = v.ledger_raw().select(
        F.concat(F.lit("/exports/"), F.col("account_label"), F.lit("/Account.csv")).alias("path"),
        (F.col("row_seq") + 1).alias("row_seq"),
        F.array(
            F.date_format("datetime", "dd-MM-yyyy"), F.date_format("datetime", "HH:mm:ss"), F.col("description"),
            F.when(F.col("fx_rate").isNotNull(), rate).otherwise(""), *pair(text), *pair(balance),
        ).alias("cells"),
    )
    return _with_header(rows, ["Datum", "Tijd", "Omschrijving", "FX", "Mutatie", "", "Saldo", ""])


@query(
    "column_inference",
    "ledger_raw",
    "SELECT account_label, 8 AS width, 4 + CAST(substr(account_label, 2) AS BIGINT) % 2 AS at_change_amount, 5 - CAST(substr(account_label, 2) AS BIGINT) % 2 AS at_change_currency, 6 + CAST(substr(account_label, 2) AS BIGINT) % 2 AS at_balance_amount, 7 - CAST(substr(account_label, 2) AS BIGINT) % 2 AS at_balance_currency FROM (SELECT DISTINCT account_label FROM ledger_raw)",
    "account_label width:i at_change_amount:i at_change_currency:i at_balance_amount:i at_balance_currency:i",
)
def column_inference(v):
    """Amount and currency columns found by content."""
    found = exports.resolve_columns(raw_exports(v))
    cols = ["width", "at_change_amount", "at_change_currency", "at_balance_amount", "at_balance_currency"]
    return found.select(exports.account_label(F.col("path")).alias("account_label"), *cols)


@query(
    "normalized_ledger",
    "ledger",
    f"SELECT account_label, currency, type, min(date_trunc('second', datetime)) AS first_time, count(*) AS n, {SUM0('raw_change')} AS raw_change, {SUM0('change_eur')} AS change_eur, {SUM0('raw_balance')} AS raw_balance FROM ledger GROUP BY 1, 2, 3",
    "account_label currency type first_time:s n:i raw_change:d change_eur:d raw_balance:d",
)
def normalized_ledger(v):
    """Export cells to the normalized ledger."""
    raw = normalize.raw_account(exports.located_rows(raw_exports(v)))
    rows = normalize.classify_account(raw)
    return rows.groupBy("account_label", "currency", "type").agg(
        F.min("datetime").alias("first_time"),
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.col(c).cast("decimal(28,6)")).cast("double"), F.lit(0.0)).alias(c) for c in ("raw_change", "change_eur", "raw_balance")],
    )


def exchanges(v: SampleViews, orders: bool) -> DataFrame:
    """Currency exchanges from the orders; odd portfolios export rates ten times too large."""
    o = v.table("orders").withColumn("acct", F.floor(F.col("o_custkey") / 10))
    rate = F.when(F.col("acct") % 2 == 1, 12.5).otherwise(1.25)
    order_id = F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")) if orders else F.lit(None).cast("string")
    legs = F.explode(
        F.array(
            F.struct(F.lit(0).alias("i"), F.lit("Valuta Debitering").alias("description"), F.lit("USD").alias("currency"), (-F.col("o_totalprice") * 1.25).alias("raw_change"), rate.alias("fx_rate")),
            F.struct(F.lit(1).alias("i"), F.lit("Valuta Creditering").alias("description"), F.lit("EUR").alias("currency"), F.col("o_totalprice").alias("raw_change"), F.lit(None).cast("double").alias("fx_rate")),
            F.struct(F.lit(2).alias("i"), F.lit("Dividend").alias("description"), F.lit("USD").alias("currency"), (F.col("o_totalprice") * 1.25).alias("raw_change"), F.lit(None).cast("double").alias("fx_rate")),
        )
    ).alias("l")
    return o.select("acct", "o_orderkey", "o_orderdate", order_id.alias("order_id"), legs).select(
        F.concat(F.lit("P"), F.col("acct").cast("string")).alias("account_label"),
        (F.col("o_orderkey") * 3 + F.col("l.i")).alias("row_seq"),
        # Spread order-less exchanges over the seconds of the day so that legs pair up one to one.
        F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("datetime"),
        F.to_date("o_orderdate").alias("value_date"),
        "order_id",
        "l.description",
        "l.currency",
        "l.raw_change",
        "l.fx_rate",
    )


@query("fx_scale_flags", "", "SELECT DISTINCT 'P' || CAST(o_custkey // 10 AS VARCHAR) AS account_label, (o_custkey // 10) % 2 = 1 AS tenfold FROM orders", "account_label tenfold")
def fx_scale_flags(v):
    """Portfolios whose rates are ten times too large."""
    return fx_repair.scale_flags(exchanges(v, orders=False))


@query(
    "order_rates",
    "",
    f"SELECT 'P' || CAST(o_custkey // 10 AS VARCHAR) AS account_label, count(*) * 3 AS rows, count(*) * 2 AS rated, {SUM0('1.25')} * 2 AS rate_sum FROM orders GROUP BY 1",
    "account_label rows:i rated:i rate_sum:d",
)
def order_rates(v):
    """Rates rescaled and spread to all foreign rows of their order."""
    rows = fx_repair.fill_order_rates(fx_repair.rescale_rates(exchanges(v, orders=True)))
    return rows.groupBy("account_label").agg(
        F.count(F.lit(1)).alias("rows"), F.count("fx_rate").alias("rated"), F.sum(F.col("fx_rate").cast("decimal(28,6)")).cast("double").alias("rate_sum")
    )


@query(
    "exchange_matches",
    "",
    "SELECT 'P' || CAST(o_custkey // 10 AS VARCHAR) AS account_label, o_orderkey * 3 + 2 AS row_seq, 1.25 AS matched_rate FROM orders",
    "account_label row_seq:i matched_rate:d",
)
def exchange_matches(v):
    """Rates given to rows paid by exchanges without an order id (sequential matching)."""
    return fx_repair.exchange_matches(fx_repair.rescale_rates(exchanges(v, orders=False)))


def classification(v: SampleViews) -> DataFrame:
    """Every third instrument is listed by id (lower case), every third by ticker, the rest not."""
    key = F.regexp_extract("instrument_id", r"(\d+)", 1).cast("bigint")
    rows = v.instruments().withColumn("row_seq", key)
    return rows.withColumn("instrument_id", F.when(key % 3 == 0, F.lower("instrument_id")).otherwise(F.concat(F.lit("Z"), key))).withColumn(
        "ticker", F.when(key % 3 == 2, "").otherwise(F.col("ticker"))
    )


_KEY = "CAST(substr(instrument_id, 2) AS BIGINT)"


@query(
    "resolved_instruments",
    "instruments",
    f"""SELECT instrument_id, currency, CASE WHEN m OR {_KEY} % 2 = 0 THEN ticker END AS ticker, CASE WHEN m THEN asset_class ELSE '' END AS asset_class, CASE WHEN m THEN primary_style ELSE '' END AS primary_style, CASE WHEN m THEN gics_sector ELSE '' END AS gics_sector,
 m AND is_etf AS is_etf, m AND NOT is_etf AS is_not_etf, CASE WHEN NOT m THEN 'classification missing' END AS issue FROM (SELECT *, {_KEY} % 3 = 0 OR ({_KEY} % 3 = 1 AND {_KEY} % 2 = 0) AS m FROM instruments)""",
    "instrument_id currency ticker asset_class primary_style gics_sector is_etf is_not_etf issue",
)
def resolved_instruments(v):
    """Instruments classified by id, else ISIN, else ticker."""
    key = F.regexp_extract("instrument_id", r"(\d+)", 1).cast("bigint")
    rows = v.instruments().select("instrument_id", "product", "isin", F.when(key % 2 == 0, F.col("ticker")).alias("symbol"), "currency")
    out = instruments.resolve_instruments(instruments.base_instruments(rows, rows), classification(v))
    return out.select("instrument_id", "currency", "ticker", "asset_class", "primary_style", "gics_sector", "is_etf", "is_not_etf", "issue")


@query(
    "resolved_characteristics",
    "instruments",
    f"""SELECT instrument_id, matched_by, asset_class, CASE WHEN given <> '' THEN given ELSE style END AS primary_style, CASE WHEN factor <> '' THEN factor ELSE (['Cyclical', 'Cyclical', 'Quality', 'Momentum'])[w + 1] END AS secondary_factor, CASE WHEN industry <> '' THEN industry ELSE kw END AS gics_industry FROM (
 SELECT *, CASE WHEN matched THEN CASE WHEN {_KEY} % 3 = 0 THEN 'instrument_id' ELSE 'ticker' END ELSE 'none' END AS matched_by, CASE WHEN matched THEN primary_style ELSE '' END AS given, CASE WHEN matched THEN secondary_factor ELSE '' END AS factor, CASE WHEN matched THEN gics_industry ELSE '' END AS industry,
 (['Value', 'Growth', 'Dividend', 'Growth'])[w + 1] AS style, (['Pharmaceuticals', 'IT Services', 'Beverages', 'Semiconductors'])[w + 1] AS kw FROM (SELECT *, {_KEY} % 4 AS w, {_KEY} % 3 < 2 AS matched FROM instruments))""",
    "instrument_id matched_by asset_class primary_style secondary_factor gics_industry",
)
def resolved_characteristics(v):
    """Characteristics by id or ticker, keyword rules for the rest."""
    words = F.element_at(F.array(*[F.lit(w) for w in ("Pfizer value", "Ibm growth", "Pepsico dividend", "Nvidia tech")]), (F.regexp_extract("instrument_id", r"(\d+)", 1).cast("int") % 4 + 1))
    rows = v.instruments().withColumn("product", F.concat(words, F.lit(" fund")))
    out = instruments.resolve_characteristics(rows, classification(v))
    return out.select("instrument_id", "matched_by", "asset_class", "primary_style", "secondary_factor", "gics_industry")


@query("classification_matches", "instruments", f"SELECT matched_by, count(*) AS rows FROM (SELECT CASE {_KEY} % 3 WHEN 0 THEN 'instrument_id' WHEN 1 THEN 'ticker' ELSE 'none' END AS matched_by FROM instruments) GROUP BY 1", "matched_by rows:i")
def classification_matches(v):
    """Match counts by key."""
    return instruments.match_counts(instruments.resolve_characteristics(v.instruments(), classification(v)))


@query("merged_instruments", "instruments", "SELECT instrument_id, product, ticker, currency, is_etf FROM instruments", "instrument_id product ticker currency is_etf")
def merged_instruments(v):
    """Two incomplete copies of the dimension merged into whole rows."""
    full = v.instruments().withColumn("symbol", F.col("ticker"))
    one = full.withColumn("currency", F.lit("")).withColumn("row_seq", F.lit(1))
    two = full.withColumn("ticker", F.lit(None).cast("string")).withColumn("is_etf", F.lit(False)).withColumn("row_seq", F.lit(2))
    return instruments.merge_instruments(one.unionByName(two)).select("instrument_id", "product", "ticker", "currency", "is_etf")


@query(
    "holding_labels",
    "instruments",
    """SELECT instrument_id, CASE WHEN n = 1 THEN product ELSE product || ' #' || n END AS unique_label, product || ' (' || ticker || ')' AS label, CASE WHEN length(product) <= 8 THEN product ELSE rtrim(substr(product, 1, 5)) || '...' END AS short FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY instrument_id) AS n FROM instruments)""",
    "instrument_id unique_label label short",
)
def holding_labels(v):
    """Display labels, unique labels and truncated names."""
    rows = v.instruments().select(
        "instrument_id", F.col("product").alias("unique_label"), holding_label("product", "ticker", "instrument_id").alias("label"), truncate_text("product", 8).alias("short")
    )
    return instruments.unique_labels(rows, label="unique_label")


@query(
    "price_upsert",
    "prices instruments",
    "SELECT p.instrument_id AS ticker, date, CASE WHEN is_etf THEN close * 2 ELSE close END AS close, CASE WHEN is_etf THEN 2 ELSE 1 END AS load_seq FROM prices p JOIN instruments USING (instrument_id)",
    "ticker date:t close:d load_seq:i",
)
def price_upsert(v):
    """A second load overwrites the closes of ETFs."""
    old = v.prices().withColumnRenamed("instrument_id", "ticker").withColumn("load_seq", F.lit(1))
    etf = v.instruments().where("is_etf").select(F.col("instrument_id").alias("ticker"))
    new = old.join(etf, "ticker", "left_semi").withColumn("close", F.col("close") * 2).withColumn("load_seq", F.lit(2))
    return tables.upsert_prices(old, new)


def written_exports(v: SampleViews) -> str:
    """One export file per portfolio, with quotes, separators and line breaks in quoted cells, blank rows and short rows."""
    path = f"{shared_folder(v.spark)}/exports-{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    note = F.concat(F.lit('"note '), key.cast("string"), F.lit(' ""q""'), F.when(key % 3 == 0, F.lit('\nline, two; "" ""\n')).otherwise(""), F.lit('"'))
    note = F.when(key % 5 == 0, F.concat(F.lit("plain "), key.cast("string"), F.lit(' 5" pipe'))).otherwise(note)
    row = F.concat(key.cast("string"), F.lit(","), note, F.when(key % 4 != 0, F.concat(F.lit(", "), F.col("o_orderpriority"))).otherwise(""))
    row = F.when(key % 7 == 0, F.concat(row, F.lit("\n , ,\n"))).otherwise(row)
    orders = v.table("orders").select(F.concat(F.lit("P"), F.floor(F.col("o_custkey") / 10).cast("string")).alias("account"), key.alias("seq"), row.alias("value"))
    header = orders.select("account").distinct().select("account", F.lit(-1).cast("bigint").alias("seq"), F.lit("Order Id,Description,Type").alias("value"))
    rows = header.unionByName(orders.withColumn("seq", F.col("seq").cast("bigint"))).repartition("account").sortWithinPartitions("account", "seq")
    rows.select("account", "value").write.partitionBy("account").text(path)
    return path


@query(
    "export_rows",
    "",
    """SELECT account_label, row_number() OVER (PARTITION BY account_label ORDER BY k) AS row_seq, CAST(k AS VARCHAR) AS order_id,
 CASE WHEN k % 5 = 0 THEN 'plain ' || k || ' 5" pipe' ELSE 'note ' || k || ' "q"' || CASE WHEN k % 3 = 0 THEN chr(10) || 'line, two; " "' ELSE '' END END AS description, CASE WHEN k % 4 <> 0 THEN o_orderpriority ELSE '' END AS type
 FROM (SELECT 'P' || CAST(o_custkey // 10 AS VARCHAR) AS account_label, o_orderkey AS k, o_orderpriority FROM orders)""",
    "account_label row_seq:i order_id description type",
)
def export_rows(v):
    """Export files written and read in blocks far smaller than a file, so that quoted cells lie over their borders."""
    rows = exports.read_rows(v.spark, f"{written_exports(v)}/*/*.txt", block_bytes=2048)
    label = F.regexp_extract("path", r"account=([^/]+)/", 1)
    return rows.where("row_seq > 0").select(label.alias("account_label"), "row_seq", *[F.col("cells")[i].alias(n) for i, n in enumerate(("order_id", "description", "type"))])


def written_prices(v: SampleViews, name: str) -> str:
    """A price table in the shared folder with the sample's closes as its first load."""
    path = f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"
    price_store.write_prices(v.prices().select(F.col("instrument_id").alias("ticker"), "date", "close", F.lit(1).alias("load_seq")), path)
    return path


@query(
    "price_store_upsert",
    "prices instruments",
    "SELECT p.instrument_id AS ticker, date, CASE WHEN is_etf AND p.date >= DATE '1996-01-01' THEN close * 2 ELSE close END AS close, CASE WHEN is_etf AND p.date >= DATE '1996-01-01' THEN 2 ELSE 1 END AS load_seq FROM prices p JOIN instruments USING (instrument_id)",
    "ticker date:t close:d load_seq:i",
)
def price_store_upsert(v):
    """A partitioned table written, upserted twice with a later load of ETFs and once with an old one, and read back."""
    path = written_prices(v, "prices-upserted")
    etf = v.instruments().where("is_etf").select(F.col("instrument_id").alias("ticker"))
    new = price_store.scan_prices(v.spark, path, etf, start=dt.date(1996, 1, 1)).withColumn("close", F.col("close") * 2).withColumn("load_seq", F.lit(2))
    new = materialize(new, "prices-fetched")
    for fetched in (new, new, new.withColumn("load_seq", F.lit(0)).withColumn("close", F.lit(-1.0))):
        price_store.upsert_prices(fetched, path)
    return price_store.scan_prices(v.spark, path)


@query(
    "price_scan",
    "prices instruments",
    "SELECT p.instrument_id AS ticker, date, close FROM prices p JOIN instruments USING (instrument_id) WHERE is_etf AND currency = 'USD' AND date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'",
    "ticker date:t close:d",
)
def price_scan(v):
    """History of the wanted tickers between two days, from the partitioned table."""
    wanted = v.instruments().where("is_etf AND currency = 'USD'").select(F.col("instrument_id").alias("ticker"))
    return price_store.scan_prices(v.spark, written_prices(v, "prices-scanned"), wanted, dt.date(1995, 3, 1), dt.date(1996, 2, 29)).select("ticker", "date", "close")


@query(
    "fx_scan",
    "fx",
    "SELECT currency, date, eur_per_unit FROM fx WHERE currency = 'USD' AND date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29' UNION ALL SELECT 'EUR', unnest(generate_series(DATE '1995-03-01', DATE '1996-02-29', INTERVAL 1 DAY))::DATE, 1.0",
    "currency date:t eur_per_unit:d",
)
def fx_scan(v):
    """FX history of the currencies of ETFs out of the price table, with EUR as 1."""
    path = f"{shared_folder(v.spark)}/fx-scanned-{uuid.uuid4().hex}"
    rows = v.fx().select(F.concat("currency", F.lit("EUR=X")).alias("ticker"), "date", F.col("eur_per_unit").alias("close"), F.lit(1).alias("load_seq"))
    price_store.write_prices(rows, path, buckets=8)
    wanted = v.instruments().where("currency <> 'GBP'").select("currency")
    return price_store.scan_fx(v.spark, path, wanted, dt.date(1995, 3, 1), dt.date(1996, 2, 29), buckets=8)


@query(
    "price_coverage_gaps",
    "prices instruments span",
    "SELECT ticker, f AS first, l AS last FROM (SELECT i.instrument_id AS ticker, min(date) AS f, max(date) AS l FROM instruments i LEFT JOIN prices p USING (instrument_id) GROUP BY 1), span WHERE f IS NULL OR s < f OR e > l",
    "ticker first:t last:t",
)
def price_coverage_gaps(v):
    """Instruments whose price history does not span the calendar."""
    start, end = span(v)
    wanted = v.instruments().select(F.col("instrument_id").alias("ticker"), F.lit(start).alias("start"), F.lit(end).alias("end"))
    return tables.coverage_gaps(v.prices().withColumnRenamed("instrument_id", "ticker"), wanted).select("ticker", "first", "last")


@query("price_freshness", "prices instruments", "SELECT max(date) AS updated_at FROM prices JOIN instruments USING (instrument_id) WHERE is_etf", "updated_at:t")
def price_freshness(v):
    """Latest update over the requested tickers."""
    updates = v.prices().select(F.col("instrument_id").alias("ticker"), F.col("date").alias("updated_at"))
    return tables.last_update(updates, v.instruments().where("is_etf").select(F.col("instrument_id").alias("ticker")))


def strategies(v: SampleViews) -> DataFrame:
    """Raw strategy parameters per customer: new split, legacy fraction, all zero, negative."""
    kind, b = F.col("c_custkey") % 4, F.col("c_acctbal")
    raw = v.table("customer").select(
        "c_custkey",
        F.when(kind == 0, F.abs(b).cast("string")).when(kind == 2, "0").when(kind == 3, "-5").alias("target_etf_pct"),
        F.when(kind == 0, "1000").when(kind == 2, "0").when(kind == 3, "30").alias("target_non_etf_pct"),
        F.when(kind == 1, "20").when(kind == 2, "0").when(kind == 3, "bad").otherwise("500").alias("target_cash_pct"),
        F.when(kind == 1, (F.col("c_nationkey") / 20).cast("string")).alias("target_etf_fraction"),
        F.when(kind == 0, "7").when(kind == 1, "x").alias("desired_etf_holdings"),
        F.when(kind == 0, F.create_map(F.lit(" eur "), b.cast("string"), F.lit("USD"), F.lit("x"), F.lit(" "), F.lit("5"))).alias("target_currency_pct"),
    )
    return resolve_strategy(raw, keep=("c_custkey",))


@query(
    "resolved_strategies",
    "",
    """SELECT c_custkey, CASE k WHEN 0 THEN abs(c_acctbal) * 100 / (abs(c_acctbal) + 1500) WHEN 1 THEN 80 * f WHEN 2 THEN 45 ELSE 0 END AS target_etf_pct, CASE k WHEN 0 THEN 1000 * 100 / (abs(c_acctbal) + 1500) WHEN 1 THEN 80 * (1 - f) WHEN 2 THEN 45 ELSE 75 END AS target_non_etf_pct,
 CASE k WHEN 0 THEN 500 * 100 / (abs(c_acctbal) + 1500) WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 25 END AS target_cash_pct, CASE k WHEN 0 THEN 7 ELSE 4 END AS desired_etf_holdings, 12 AS desired_non_etf_holdings, 400.0 AS min_over_value_eur FROM (SELECT *, c_custkey % 4 AS k, least(c_nationkey / 20.0, 1) AS f FROM customer)""",
    "c_custkey:i target_etf_pct:d target_non_etf_pct:d target_cash_pct:d desired_etf_holdings:i desired_non_etf_holdings:i min_over_value_eur:d",
)
def resolved_strategies(v):
    """Strategy defaults, split normalization and legacy migration."""
    return strategies(v).select("c_custkey", "target_etf_pct", "target_non_etf_pct", "target_cash_pct", "desired_etf_holdings", "desired_non_etf_holdings", "min_over_value_eur")


_BROKEN = ["{", "[1, 2]", "", '{"target_etf_pct": }']


def strategy_texts(v: SampleViews) -> DataFrame:
    """Strategies as JSON documents, those of every fifth customer broken in one of four ways."""
    whole = strategy_documents(strategies(v), ("c_custkey",))
    broken = F.element_at(F.array(*[F.lit(x) for x in _BROKEN]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return whole.withColumn("text", F.when(F.col("c_custkey") % 5 == 0, broken).otherwise(F.col("text")))


_STRATEGY_SQL, _STRATEGY_COLUMNS = ORACLES["resolved_strategies"], ["c_custkey", "target_etf_pct", "target_non_etf_pct", "target_cash_pct", "desired_etf_holdings", "desired_non_etf_holdings", "min_over_value_eur"]


@query(
    "strategy_documents",
    "",
    f"SELECT * FROM ({_STRATEGY_SQL}) WHERE c_custkey % 5 <> 0",
    "c_custkey:i target_etf_pct:d target_non_etf_pct:d target_cash_pct:d desired_etf_holdings:i desired_non_etf_holdings:i min_over_value_eur:d",
)
def strategy_documents_read(v):
    """Strategies written as JSON documents and read again; broken documents give none."""
    return parse_documents(strategy_texts(v), ("c_custkey",))[0].select(*_STRATEGY_COLUMNS)


@query(
    "strategy_document_issues",
    "",
    "SELECT c_custkey, 'unreadable strategy' AS label, [" + ", ".join(f"'{x}'" for x in _BROKEN) + "][c_custkey % 4 + 1] AS example FROM customer WHERE c_custkey % 5 = 0",
    "c_custkey:i label example",
)
def strategy_document_issues(v):
    """Strategy documents that can't be read, with the start of their text."""
    return parse_documents(strategy_texts(v), ("c_custkey",))[1]


@query(
    "strategy_targets",
    "",
    "SELECT c_custkey, 'EUR' AS bucket, CASE WHEN c_custkey % 4 = 0 THEN greatest(c_acctbal, 0) ELSE 50 END AS target_pct FROM customer UNION ALL SELECT c_custkey, 'USD', 50 FROM customer WHERE c_custkey % 4 <> 0",
    "c_custkey:i bucket target_pct:d",
)
def strategy_targets(v):
    """Cleaned currency targets as rows."""
    return target_rows(strategies(v), "target_currency_pct", ("c_custkey",))


# --- fixed values: the asset types of the sample, for the SQL ----------------------
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# ------------------------------------------------------------------------------


@query(
    "daily_close_by_type",
    "tx instruments dense_price span cal",
    "WITH net AS (SELECT gics_sector AS g, instrument_id, date, sum(quantity) AS q FROM tx JOIN instruments USING (instrument_id) GROUP BY 1, 2, 3), iv AS (SELECT g, instrument_id, sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS qty, date AS a, coalesce(lead(date) OVER w, (SELECT e FROM span) + 1) AS b FROM net WINDOW w AS (PARTITION BY instrument_id ORDER BY date)),"
    " val AS (SELECT g, date, CAST(sum(qty * units) AS DOUBLE) / 1000000 AS v, sum(qty) AS c FROM iv JOIN dense_price USING (instrument_id) WHERE date >= a AND date < b GROUP BY 1, 2) SELECT cal.date AS day, "
    + ", ".join(f"coalesce(max(CASE WHEN g = '{t}' THEN c END), 0) AS {t}_count, coalesce(max(CASE WHEN g = '{t}' THEN v END), 0) AS {t}_value_eur" for t in TYPES)
    + " FROM cal LEFT JOIN val ON val.date = cal.date GROUP BY 1",
    "day:t " + " ".join(f"{t}_count:d {t}_value_eur:d" for t in TYPES),
)
def daily_close_by_type(v):
    """Daily quantity and value per asset type, wide."""
    start, end = span(v)
    kinds = v.instruments().select("instrument_id", F.col("gics_sector").alias("kind"))
    trades = timeseries.daily_trades(v.tx(), ("instrument_id",)).join(kinds, "instrument_id").select("kind", "instrument_id", "date", "net_quantity")
    moves = timeseries.price_moves(eur_events(v), start, end)
    # a column pair for every type there is, so none can drop out
    found = sorted(r[0] for r in kinds.select("kind").where("kind IS NOT NULL").distinct().collect())
    return timeseries.daily_close_wide(trades, moves, end, "kind", found, start).withColumnRenamed("date", "day")
