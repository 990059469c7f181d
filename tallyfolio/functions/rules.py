"""Rule tables of the domain and the expressions built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- fixed values: description patterns of ledger rows ------------------------
# (pattern, sign, type): tested on lower-case text, a later match wins.
# sign: "+" / "-" also asks for a positive / negative amount; "!" forbids a
# reservation text; "" asks nothing.
RESERVATION = r"reservation ideal|reservation sofort|reservation i?deal / sofort deposit"
ACCOUNT_TYPE_RULES = [
    (r"cash sweep|overboeking (?:van|naar) uw geldrekening bij", "", "internal_cash_sweep"),
    (r"valuta debitering|valuta creditering", "", "fx_conversion"),
    (r"transactiekosten|kosten van derden", "", "transaction_fee"),
    (r"aansluitingskosten|minimale activiteitskosten pensioenrekening", "", "account_fee"),
    (r"dividendbelasting", "", "dividend_tax"),
    (r"^(?!.*dividendbelasting).*dividend", "", "dividend"),
    (r"interest income", "", "interest"),
    (r"verrekening promotie", "", "promo"),
    (RESERVATION, "+", "external_deposit"),
    (RESERVATION, "-", "reservation_hold"),
    (r"flatex storting", "!", "external_deposit"),
    (r"ideal deposit|sofort deposit", "!", "reservation_settlement"),
    (r"flatex terugstorting|withdraw|opname|uitbetaling", "", "external_withdrawal"),
    (r"\b(?:koop|verkoop|buy|sell)\b", "", "trade_settlement"),
]
# --- fixed values: which types count as what ------------------------------
INTERNAL_TYPES = ("internal_cash_sweep", "fx_conversion", "reservation_hold", "reservation_settlement")
EXTERNAL_TYPES = ("external_deposit", "external_withdrawal")
COST_TYPES = ("transaction_fee", "account_fee", "dividend_tax")
INCOME_TYPES = ("dividend", "interest", "promo")
# --- fixed values: cash-like and ETF recognition ----------------------------
CASH_PRODUCT = r"CASH|CASH SWEEP|CASH FUND|MONEY MARKET|GELDREKENING|BANKACCOUNT|FLATEX"
CASH_WITHOUT_ISIN = r"CASH|GELD|MONEY MARKET"
CASH_CURRENCY_ONLY = r"^(?:EUR|USD|GBP|CHF|JPY|AUD|CAD)(?:\s+CASH)?$"
CASH_ISINS = ("NLFLATEXACNT",)
ETF_PRODUCT = r"ETF|UCITS|ISHARES|VANGUARD|SPDR|VANECK"
ETF_ISINS = (
    "IE00B0M63284",
    "IE00B1XNHC34",
    "IE00B4L5Y983",
    "IE00B5M1WJ87",
    "NL0010408704",
    "IE00BKY58G26",
    "IE00B3XXRP09",
    "FR0000021842",
)
# --- fixed values: trade direction words ------------------------------------
SELL_WORDS = r"\b(?:sell|verkoop|sold)\b"
BUY_WORDS = r"\b(?:buy|koop|gekocht)\b"
# --- fixed values: bucket keywords (substring tests, first match wins) --------
INDUSTRY_KEYWORDS = [
    ("Interactive Media & Services", ["ALPHABET", "GOOGL", "GOOG", "INTERNET"]),
    ("Broadline Retail", ["AMAZON", "AMZN"]),
    ("Semiconductor Equipment", ["ASML"]),
    ("Semiconductors", ["NVIDIA", "NVDA", "MICRON", "MU"]),
    ("Communications Equipment", ["CISCO", "CSCO"]),
    ("Air Freight & Logistics", ["POST", "DHL", "LOGISTICS"]),
    ("Capital Markets", ["FLOW TRADERS", "TRADING"]),
    ("Food Products", ["GENERAL MILLS"]),
    ("Biotechnology", ["GILEAD"]),
    ("IT Services", ["IBM"]),
    ("Beverages", ["PEPSICO", "JDE"]),
    ("Pharmaceuticals", ["PFIZER", "PFE"]),
    ("Household Products", ["PROCTER", "GAMBLE", "PG"]),
    ("Restaurants", ["TAKEAWAY", "RESTAURANT"]),
    ("Electrical Equipment", ["NORDEX"]),
]
STYLE_KEYWORDS = [
    ("Dividend", ["DIVIDEND", "ARISTOCRAT", "INCOME", "YIELD"]),
    ("Value", ["VALUE", "QUALITY VALUE", "DEEP VALUE"]),
    ("Growth", ["GROWTH", "NASDAQ", "TECH", "INNOVATION", "MOMENTUM"]),
]
FACTOR_KEYWORDS = [
    ("Momentum", ["MOMENTUM", "NASDAQ", "NVDA", "NVIDIA"]),
    ("Defensive", ["DEFENSIVE", "CONSUMER STAPLES", "PHARMA", "HEALTH", "INSURANCE"]),
    ("Quality", ["DIVIDEND", "QUALITY", "ARISTOCRAT"]),
]
PRIMARY_STYLES = ("Growth", "Value", "Blend", "Dividend")
SECONDARY_FACTORS = ("Quality", "Momentum", "Cyclical", "Defensive")
# ------------------------------------------------------------------------------


def account_type(description, raw_change) -> Column:
    """Ledger row type from its text; the last matching rule decides."""
    text = F.lower(F.coalesce(_c(description), F.lit("")))
    amount = _c(raw_change)
    out = F.lit("other")
    for pattern, sign, label in ACCOUNT_TYPE_RULES:
        hit = text.rlike(pattern)
        if sign == "+":
            hit = hit & F.coalesce(amount > 0, F.lit(False))
        elif sign == "-":
            hit = hit & F.coalesce(amount < 0, F.lit(False))
        elif sign == "!":
            hit = hit & ~text.rlike(RESERVATION)
        out = F.when(hit, label).otherwise(out)
    return out


def given_or_inferred_type(given, inferred) -> Column:
    t = F.trim(F.coalesce(_c(given), F.lit("")))
    return F.when(F.lower(t).isin("", "other"), _c(inferred)).otherwise(t)


def type_flags(type_col="type") -> dict[str, Column]:
    t = _c(type_col)
    return {
        "is_external_flow": t.isin(*EXTERNAL_TYPES),
        "is_internal_transfer": t.isin(*INTERNAL_TYPES),
        "is_cost": t.isin(*COST_TYPES),
        "is_income": t.isin(*INCOME_TYPES),
    }


def is_cash_like(product, isin) -> Column:
    p = F.upper(F.coalesce(_c(product), F.lit("")))
    i = F.upper(F.coalesce(_c(isin), F.lit("")))
    bare = (i == "") & (p.rlike(CASH_WITHOUT_ISIN) | p.rlike(CASH_CURRENCY_ONLY))
    return p.rlike(CASH_PRODUCT) | i.isin(*CASH_ISINS) | bare


def looks_like_etf(product, isin) -> Column:
    p = F.upper(F.coalesce(_c(product), F.lit("")))
    return p.rlike(ETF_PRODUCT) | F.coalesce(_c(isin), F.lit("")).isin(*ETF_ISINS)


def signed_quantity(quantity, total_eur, type_text, description) -> Column:
    """Sign a non-negative quantity: a sell hint makes it negative, a buy hint wins over it."""
    q, total = _c(quantity), _c(total_eur)
    text = F.lower(
        F.concat_ws(" ", F.coalesce(_c(type_text), F.lit("")), F.coalesce(_c(description), F.lit("")))
    )
    sell = text.rlike(SELL_WORDS) | F.coalesce(total > 0, F.lit(False))
    buy = text.rlike(BUY_WORDS) | F.coalesce(total < 0, F.lit(False))
    return F.when(q < 0, q).when(buy, F.abs(q)).when(sell, -F.abs(q)).otherwise(q)


def asset_class(x) -> Column:
    t = F.upper(F.trim(F.coalesce(_c(x), F.lit(""))))
    return F.when(t == "ETF", "ETF").when(t.isin("EQUITY", "STOCK"), "Equity").otherwise("")


def allowed_or_blank(x, allowed) -> Column:
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    return F.when(t.isin(*allowed), t).otherwise("")


def _keyword_bucket(text: Column, table, default: Column) -> Column:
    out = default
    for bucket, words in reversed(table):
        out = F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), bucket).otherwise(out)
    return out


def _label_text(product, ticker) -> Column:
    return F.upper(F.concat(F.coalesce(_c(product), F.lit("")), F.lit(" "), F.coalesce(_c(ticker), F.lit(""))))


def industry_bucket(product, ticker, is_etf) -> Column:
    default = F.when(_c(is_etf), "Multi-Sector").otherwise("Unclassified")
    return _keyword_bucket(_label_text(product, ticker), INDUSTRY_KEYWORDS, default)


def style_bucket(product, ticker, is_etf) -> Column:
    default = F.when(_c(is_etf), "Blend").otherwise("Unclassified")
    return _keyword_bucket(_label_text(product, ticker), STYLE_KEYWORDS, default)


def factor_bucket(product, ticker, primary_style) -> Column:
    default = F.when(_c(primary_style).isin(*PRIMARY_STYLES), "Cyclical").otherwise("")
    return _keyword_bucket(_label_text(product, ticker), FACTOR_KEYWORDS, default)


# --- limit checks --------------------------------------------------------------


def status_max(actual, limit) -> Column:
    return F.when(_c(actual).isNull(), "N/A").when(_c(actual) <= _c(limit), "OK").otherwise("Above limit")


def status_min(actual, minimum) -> Column:
    return F.when(_c(actual).isNull(), "N/A").when(_c(actual) >= _c(minimum), "OK").otherwise("Below minimum")


def status_target(actual, target, tolerance: float) -> Column:
    a, t = _c(actual), _c(target)
    return (
        F.when(a.isNull(), "N/A")
        .when(F.abs(a - t) <= tolerance, "On target")
        .when(a > t, "Above target")
        .otherwise("Below target")
    )
