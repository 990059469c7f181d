"""Text, date and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clean_text(x) -> Column:
    """Trimmed text; missing, "nan" and "none" (any case) become ""."""
    t = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)


def upper_key(x) -> Column:
    return F.upper(clean_text(x))


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


def first_text(x, order) -> Column:
    """First non-blank text of a group by `order` (aggregate, order-stable)."""
    t = F.nullif(clean_text(x), F.lit(""))
    return F.coalesce(F.min_by(t, F.when(t.isNotNull(), order)), F.lit(""))


def join_distinct(x) -> Column:
    """Sorted distinct non-blank values joined by ", " (aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(blank_to_null(x))), ", ")


def header_key(x) -> Column:
    """Header text as a match key: lower case, one space, letters and digits only."""
    t = F.regexp_replace(F.lower(F.trim(_c(x))), r"[_\s]+", " ")
    return F.regexp_replace(t, r"[^a-z0-9 ]", "")


def truncate_text(x, max_len: int) -> Column:
    t = F.trim(_c(x))
    return F.when(F.length(t) <= max_len, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, max_len - 3)), F.lit("..."))
    )


def holding_label(product, ticker, instrument_id) -> Column:
    p, t, i = (F.trim(F.coalesce(_c(v), F.lit(""))) for v in (product, ticker, instrument_id))
    return (
        F.when((p != "") & (t != ""), F.concat(p, F.lit(" ("), t, F.lit(")")))
        .when(p != "", p)
        .when(t != "", t)
        .otherwise(i)
    )


def holding_key(isin, product, ticker) -> Column:
    """Composite key: the ISIN when there is one, else product and ticker."""
    i = upper_key(isin)
    p = F.lower(F.trim(F.coalesce(_c(product), F.lit(""))))
    t = F.lower(F.trim(F.coalesce(_c(ticker), F.lit(""))))
    return F.when(i != "", F.concat(F.lit("isin::"), i)).otherwise(
        F.concat(F.lit("product::"), p, F.lit("|ticker::"), t)
    )


_DAY_FIRST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[ T]+(\d{1,2}:\d{2}(?::\d{2})?))?$"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]+\d{1,2}:\d{2}(?::\d{2})?)?$"


def parse_day_first(date_text, time_text=None) -> Column:
    """Day-first date text plus optional time text to TIMESTAMP_NTZ; bad text is NULL.

    One regex and one cast, so no per-row parse exceptions.
    """
    t = F.trim(F.coalesce(_c(date_text), F.lit("")))
    if time_text is not None:
        t = F.trim(F.concat(t, F.lit(" "), F.trim(F.coalesce(_c(time_text), F.lit("")))))
    iso = F.trim(F.regexp_replace(t, _DAY_FIRST, "$3-$2-$1 $4"))
    return F.when(iso.rlike(_ISO), iso.try_cast("timestamp_ntz"))


def day(x) -> Column:
    return F.to_date(_c(x))


def year_label(d) -> Column:
    return F.year(_c(d)).cast("string")


def quarter_label(d) -> Column:
    return F.concat(F.year(_c(d)), F.lit("Q"), F.quarter(_c(d)))


def month_label(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def month_start(d) -> Column:
    return F.trunc(_c(d), "month")


def iso_day(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def iso_second(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


ISIN = r"^[A-Z]{2}[A-Z0-9]{10}$"
CURRENCY_CODE = r"^[A-Z]{3}$"
AMOUNT_WITH_CURRENCY = r"^[+-]?\d+(?:[.,]\d+)?\s+[A-Z]{3}$"


def is_isin(x) -> Column:
    return F.coalesce(_c(x).rlike(ISIN), F.lit(False))


def is_currency_code(x) -> Column:
    return F.coalesce(F.upper(F.trim(_c(x))).rlike(CURRENCY_CODE), F.lit(False))


def is_amount_fragment(x) -> Column:
    return F.coalesce(F.upper(F.trim(_c(x))).rlike(AMOUNT_WITH_CURRENCY), F.lit(False))
