"""Moving-average cost basis of open positions.

The rule is sequential: a buy adds its spend, a sell removes average cost, quantity
and cost never go below zero and reset once the quantity is gone.  Two facts make it
a pair of scans:

* the quantity is a walk reflected at zero, q_i = S_i + max(0, max(-S_j, j <= i)), with
  S the running sum of (decimal) quantities;
* once quantities are known, each trade maps the cost to a * cost + b: (1, spend) for a
  buy, (share left, 0) for a sell, (0, 0) when the quantity is gone.

Keys are counted first.  Those of bounded size are dealt to tasks whole, and both scans run there after one shuffle.
Trades of larger keys are dealt into buckets by ranges of (key, time), whatever the number of trades of a day.  Each scan runs within the buckets first, then over one row per bucket, and
joins what lies before a bucket back to its trades: no task holds an instrument's life and no arrays are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.functions.text import day
from tallyfolio.operators.ranks import large_keys, of_keys
from tallyfolio.session import materialize, tasks_for

_GONE = 1e-9
_NONE = 1e-12
#: Quantities and their sums are exact to twelve places; the wider type leaves room for one more addition.
_EXACT, _SUM = "decimal(28,12)", "decimal(36,12)"
_ORDER = ["datetime", "row_seq", "quantity", "spend"]
#: Place of a trade in its scan: trades that are equal in all of the order keep theirs through all steps.
_AT = "_at"
#: Natural logarithm of how far products of shares may fall within one section of a scan.  What is more
#: than a section back weighs less than exp(-400) and counts as nothing.
_FALL = 400.0
#: Trades of a key that one task may scan.
LARGE = 1 << 18


def _running(*by):
    return Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, 0)


def _number(scan):
    return F.row_number().over(scan)


def _trades(tx: DataFrame, keys, include_fees: bool) -> DataFrame:
    """Trades of known keys, written once."""
    fees = F.abs(F.coalesce("fees_eur", F.lit(0.0))) if include_fees else F.lit(0.0)
    spend = F.greatest(F.coalesce(-F.col("total_eur"), F.lit(0.0)) + fees, F.lit(0.0))
    rows = tx.where(F.col("datetime").isNotNull() & (F.abs("quantity") >= _NONE))
    if "is_cash_like" in tx.columns:
        rows = rows.where(~F.coalesce("is_cash_like", F.lit(False)))
    rows = rows.dropna(subset=keys).select(*keys, "datetime", "row_seq", "quantity", spend.alias("spend"))
    return materialize(rows, "cost-trades")


def _exact(trades: DataFrame) -> DataFrame:
    return trades.withColumn("quantity", F.col("quantity").cast(_EXACT))


def _dealt(trades: DataFrame, keys, tasks: int) -> DataFrame:
    """Trades with the bucket they are dealt to, written once."""
    dealt = trades.repartitionByRange(tasks, *keys, *_ORDER).withColumn("bucket", F.spark_partition_id())
    return _exact(materialize(dealt, "cost-dealt"))


def _before_bucket(rows: DataFrame, keys, carried: dict, kind: str) -> DataFrame:
    """`carried` columns: aggregates over all earlier buckets of the key."""
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*keys, "bucket", *[F.coalesce(c.over(earlier), F.lit(0)).cast(kind).alias(name) for name, c in carried.items()])


def _quantities(trades: DataFrame, keys) -> DataFrame:
    """Quantity before and after every trade."""
    on = _running([*keys, "bucket"], _ORDER)
    rows = trades.withColumn(_AT, _number(on)).withColumn("run", F.sum("quantity").over(on).cast(_SUM)).withColumn("low", F.min("run").over(on))
    ends = rows.groupBy(*keys, "bucket").agg(F.sum("quantity").cast(_SUM).alias("total"), F.min("low").alias("low"))
    ends = ends.join(_before_bucket(ends, keys, {"sum_before": F.sum("total")}, _SUM), [*keys, "bucket"])
    ends = ends.withColumn("low", (F.col("low") + F.col("sum_before")).cast(_SUM))
    ends = ends.join(_before_bucket(ends, keys, {"low_before": F.min("low")}, _SUM), [*keys, "bucket"]).select(*keys, "bucket", "sum_before", "low_before")
    earlier_low = F.coalesce(F.min("run").over(on.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("earlier", earlier_low).join(ends, [*keys, "bucket"])

    def reflected(run, low):
        s = F.col("sum_before") + run
        q = (s - F.least(F.lit(0), F.col("low_before"), F.col("sum_before") + low)).cast("double")
        return F.when(q <= _GONE, F.lit(0.0)).otherwise(q)

    before = reflected(F.col("run") - F.col("quantity"), F.col("earlier"))
    return rows.select(*keys, "bucket", *_ORDER, _AT, before.alias("before"), reflected(F.col("run"), F.col("low")).alias("open_quantity"))


def composed(rows: DataFrame, part, order) -> DataFrame:
    """Prefix composition of maps x -> a x + b with 0 <= a <= 1, b >= 0, in `order` within `part`.

    Adds pre_a, pre_b: the maps up to and with this row as one.  A map with a = 0 opens a new section, in which
    products are taken of the other maps only, and so does a product that has fallen by exp(-_FALL).
    """
    opens = F.col("a") == 0
    factor = F.when(opens, F.lit(1.0)).otherwise(F.col("a"))
    rows = rows.withColumn("_reset", F.sum(opens.cast("long")).over(_running(part, order))).withColumn("_f", factor)
    fallen = -F.sum(F.log("_f")).over(_running([*part, "_reset"], order))
    rows = rows.withColumn("_section", F.floor(F.greatest(fallen, F.lit(0.0)) / _FALL))
    within = _running([*part, "_reset", "_section"], order)
    rows = rows.withColumn("_p", F.product("_f").over(within)).withColumn("_s", F.col("_p") * F.sum(F.col("b") / F.col("_p")).over(within))
    # the section before hands its last value on to all rows of this one
    back = F.lag("_s").over(Window.partitionBy(*part, "_reset").orderBy(*order))
    rows = rows.withColumn("_back", back)
    carry = F.coalesce(F.first("_back").over(within), F.lit(0.0))
    untouched = (F.col("_reset") == 0) & (F.col("_section") == 0)
    rows = rows.withColumn("pre_a", F.when(untouched, F.col("_p")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("pre_b", F.col("_s") + F.col("_p") * carry)
    return rows.drop("_reset", "_f", "_section", "_p", "_s", "_back")


def _with_maps(rows: DataFrame) -> DataFrame:
    """What each trade does to the cost: a * cost + b."""
    bought, q, left = F.col("quantity") > 0, F.col("before"), F.col("open_quantity")
    keep = F.when((q <= _NONE) | (left <= _GONE), F.lit(0.0)).otherwise(F.least(left / q, F.lit(1.0)))
    return rows.withColumn("a", F.when(bought, F.lit(1.0)).otherwise(keep)).withColumn("b", F.when(bought, F.col("spend")).otherwise(F.lit(0.0)))


def _whole(trades: DataFrame, keys, tasks: int) -> DataFrame:
    """Open quantity and cost after every trade of keys that a task may hold: nothing is held before the first."""
    on, none = _running(keys, _ORDER), F.lit(0).cast(_SUM)
    rows = _exact(trades.repartition(tasks, *keys)).withColumn(_AT, _number(on)).withColumn("run", F.sum("quantity").over(on).cast(_SUM))
    rows = rows.withColumn("low", F.min("run").over(on)).withColumn("earlier", F.coalesce(F.min("run").over(on.rowsBetween(Window.unboundedPreceding, -1)), none))

    def reflected(run, low):
        q = (run - F.least(none, low)).cast("double")
        return F.when(q <= _GONE, F.lit(0.0)).otherwise(q)

    before = reflected(F.col("run") - F.col("quantity"), F.col("earlier"))
    rows = rows.select(*keys, *_ORDER, _AT, before.alias("before"), reflected(F.col("run"), F.col("low")).alias("open_quantity"))
    rows = composed(_with_maps(rows), keys, [_AT])
    cost = F.when(F.col("open_quantity") <= _GONE, F.lit(0.0)).otherwise(F.col("pre_b"))
    return rows.select(*keys, *_ORDER, _AT, "open_quantity", cost.alias("cost_basis_eur"))


def trade_cost_basis(tx: DataFrame, keys=("instrument_id",), include_fees: bool = False) -> DataFrame:
    """Open quantity and cost after every trade."""
    return _costs(tx, keys, include_fees).drop(_AT)


def _costs(tx: DataFrame, keys, include_fees: bool) -> DataFrame:
    """The same with the place of each trade, which tells equal trades apart."""
    keys = list(keys)
    trades = _trades(tx, keys, include_fees)
    large, total = large_keys(trades, keys, LARGE)
    tasks = tasks_for(tx.sparkSession, total)
    if large is None:
        return _whole(trades, keys, tasks)
    some = _in_buckets(of_keys(trades, keys, large, inside=True), keys, tasks)
    return _whole(of_keys(trades, keys, large, inside=False), keys, tasks).unionByName(some)


def _in_buckets(trades: DataFrame, keys, tasks: int) -> DataFrame:
    """The same for keys of any size."""
    rows = _with_maps(_quantities(_dealt(trades, keys, tasks), keys))
    rows = materialize(composed(rows, [*keys, "bucket"], [*_ORDER, _AT]).drop("a", "b", "before"), "cost-maps")
    last = F.struct(*_ORDER, _AT)
    whole = rows.groupBy(*keys, "bucket").agg(F.max_by("pre_a", last).alias("a"), F.max_by("pre_b", last).alias("b"))
    chain = composed(whole, keys, ["bucket"])
    start = F.coalesce(F.lag("pre_b").over(Window.partitionBy(*keys).orderBy("bucket")), F.lit(0.0))  # nothing is held before the first
    rows = rows.join(chain.select(*keys, "bucket", start.alias("start")), [*keys, "bucket"])
    cost = F.when(F.col("open_quantity") <= _GONE, F.lit(0.0)).otherwise(F.col("pre_a") * F.col("start") + F.col("pre_b"))
    return rows.select(*keys, *_ORDER, _AT, "open_quantity", cost.alias("cost_basis_eur"))


def _last(rows: DataFrame, by) -> DataFrame:
    last = F.max_by(F.struct("open_quantity", "cost_basis_eur"), F.struct(*_ORDER, _AT)).alias("r")
    return rows.groupBy(*by).agg(last).select(*by, "r.open_quantity", "r.cost_basis_eur")


def daily_cost_basis(tx: DataFrame, keys=("instrument_id",), include_fees: bool = False) -> DataFrame:
    """Open quantity and cost after every trading day; constant until the next one."""
    rows = _costs(tx, keys, include_fees).withColumn("date", day("datetime"))
    return _last(rows, [*keys, "date"])


def open_cost_basis(tx: DataFrame, keys=("instrument_id",), include_fees: bool = True) -> DataFrame:
    """Final state only."""
    return _last(_costs(tx, keys, include_fees), list(keys))
