"""Registered queries over the sample tables, each with the SQL that checks it.

Doubles are returned with seven significant digits and dates as text, so results compare by value across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfolio.plans.sample_sql import with_views
from tallyfolio.plans.sample_views import SampleViews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Scale per magnitude: seven significant digits, at most six decimals.
_SCALES = [(1e6, 1.0), (1e5, 1e1), (1e4, 1e2), (1e3, 1e3), (1e2, 1e4), (1e1, 1e5), (0.0, 1e6)]


def _rounded(x):
    """Half-up rounding by plain double arithmetic (the same on every engine)."""
    out = None
    for bound, scale in _SCALES:
        value = F.floor(x * scale + 0.5) / scale
        hit = F.abs(x) >= bound
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _rounded_sql(x: str) -> str:
    arms = " ".join(f"WHEN abs({x}) >= {b:.0f} THEN floor({x} * {s:.0f} + 0.5) / {s:.0f}" for b, s in _SCALES)
    return f"(CASE {arms} END)"


def _comparable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = _rounded(c.cast("double"))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _sql(views: str, select: str, columns: str) -> str:
    """Wrap a select: `a` passes through, `a:d` is a double, `a:i` an integer, `a:t` a day, `a:s` a second."""
    out = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        out.append(
            {
                "d": _rounded_sql(f"CAST({name} AS DOUBLE)"),
                "i": f"CAST({name} AS BIGINT)",
                "t": f"strftime({name}, '%Y-%m-%d')",
                "s": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
                "": name,
            }[kind]
            + f" AS {name}"
        )
    return with_views(views.split(), f"SELECT {', '.join(out)} FROM ({select}) q")


def query(name: str, views: str = "", sql: str | None = None, columns: str = ""):
    """Register a view-based query and its SQL under `name`."""

    def wrap(build: Callable[[SampleViews], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _comparable(build(SampleViews(spark, sf_dir)))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _sql(views, sql, columns)
        return build

    return wrap
