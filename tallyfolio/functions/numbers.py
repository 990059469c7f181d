"""Number handling: exact money sums, safe ratios, localized parsing.

Money is DOUBLE in every table, but it is *summed* as DECIMAL(28,6): the sum is
then independent of row order and partitioning, and a delta-encoded running sum
returns to exactly zero when a position is closed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"

_NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def money(x) -> Column:
    return _c(x).cast(MONEY)


def money_sum(x) -> Column:
    """Exact, order-independent sum as DOUBLE; NULL when every input is NULL."""
    return F.sum(money(x)).cast("double")


def money_sum0(x) -> Column:
    """Like money_sum, but 0.0 for an all-missing group."""
    return F.coalesce(F.sum(money(x)), F.lit(0).cast(MONEY)).cast("double")


def pct(value, total) -> Column:
    """value / total * 100, NULL when either side is missing or total is 0."""
    return F.try_divide(_c(value), _c(total)) * 100.0


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    v = _c(x).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def to_float(x, default: float | None) -> Column:
    """Text or number to DOUBLE with a default for anything unusable."""
    v = finite(_c(x).cast("string").try_cast("double"))
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def to_int(x, default: int) -> Column:
    v = _c(x).cast("string").try_cast("double").try_cast("int")
    return F.coalesce(v, F.lit(int(default)))


def positive_part(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def _point_decimal(t: Column, drop_dots_with_comma: bool) -> Column:
    """Rewrite a number text so that the decimal mark is a point.

    With both marks present the last one is the decimal mark; a lone comma is
    always the decimal mark.
    """
    has_comma, has_dot = t.contains(","), t.contains(".")
    comma_is_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    dots_out = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    commas_out = F.replace(t, F.lit(","), F.lit(""))
    lone = dots_out if drop_dots_with_comma else F.replace(t, F.lit(","), F.lit("."))
    return (
        F.when(has_comma & has_dot, F.when(comma_is_last, dots_out).otherwise(commas_out))
        .when(has_comma, lone)
        .otherwise(t)
    )


def _guarded_double(t: Column) -> Column:
    # try_cast alone would also take "1.0d", "inf" and "nan".
    return F.when(t.rlike(_NUMERIC), F.trim(t).try_cast("double"))


def parse_decimal(x) -> Column:
    """Localized amount: "1.234,56", "(1,234.56)", "9,94"; anything else is NULL."""
    t = F.regexp_replace(F.replace(_c(x), F.lit("\u00a0"), F.lit("")), r"^\s+|\s+$", "")
    t = F.when(t.isin("", "-", "nan", "None"), None).otherwise(F.replace(t, F.lit('"'), F.lit("")))
    negative = t.startswith("(") & t.endswith(")")
    body = F.regexp_replace(t, r"^[()]+|[()]+$", "")
    value = _guarded_double(_point_decimal(body, drop_dots_with_comma=True))
    return F.when(negative, -value).otherwise(value)


def parse_user_float(x) -> Column:
    """Hand-typed amount in either decimal style, spaces ignored."""
    t = F.replace(F.trim(_c(x)), F.lit(" "), F.lit(""))
    return _guarded_double(_point_decimal(t, drop_dots_with_comma=False))
