"""Registered queries: parsing, ledger, daily series and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.functions import numbers, rules, text
from tallyfolio.operators import costbasis, ledger, performance, quality, series, timeseries
from tallyfolio.plans.registry import query
from tallyfolio.plans.sample_sql import TYPE_CASE, money_sum, money_sum0
from tallyfolio.plans.sample_views import SampleViews
from tallyfolio.sources import tables

SUM0 = money_sum0


def span(v: SampleViews):
    """Calendar of the data set, read once per query."""
    if not hasattr(v, "_span"):
        # a trade's day is its line's ship date: no join is needed to find the first and the last
        lines = v.table("lineitem").select(F.col("l_shipdate").alias("datetime"))
        v._span = timeseries.activity_span(lines, v.ledger())
    return v._span


def metrics(v: SampleViews, combined: bool = False, written: bool = False) -> DataFrame:
    """Daily metrics; `written`: the query reads them several times."""
    return timeseries.portfolio_metrics(
        v.tx(), v.ledger(), v.instruments(), v.prices(), v.fx(), combined=combined, span=span(v), written=written
    )


def eur_ledger(v: SampleViews) -> DataFrame:
    return ledger.with_eur_amounts(v.ledger(), ledger.daily_fx(v.fx(), *span(v)))


def eur_events(v: SampleViews) -> DataFrame:
    return timeseries.eur_prices(v.prices(), v.instruments(), v.fx())


_M = "SELECT account_label, date, positions_value, cash, cash_from_changes, cash_from_statement, profit, total_deposits, portfolio_value, CASE WHEN total_deposits <> 0 THEN portfolio_value / total_deposits - 1 END AS simple_return FROM metrics"


@query(
    "daily_portfolio_value",
    "metrics",
    _M
    + """ UNION ALL SELECT 'Combined', date, p, c, c, st, pr, d, pv, CASE WHEN d <> 0 THEN pv / d - 1 END FROM (
 SELECT date, CAST(sum(micro) AS DOUBLE) / 1000000 AS p, CAST(sum(micro + CAST(cash * 1000000 AS DECIMAL(38,0))) AS DOUBLE) / 1000000 AS pv, CAST(sum(micro + CAST((cash - dep) * 1000000 AS DECIMAL(38,0))) AS DOUBLE) / 1000000 AS pr, CAST(sum(cash) AS DOUBLE) AS c, CAST(sum(stmt) AS DOUBLE) AS st,
 CAST(sum(dep) AS DOUBLE) AS d FROM m_acct GROUP BY 1)""",
    "account_label date:t positions_value:d cash:d cash_from_changes:d cash_from_statement:d profit:d total_deposits:d portfolio_value:d simple_return:d",
)
def daily_portfolio_value(v):
    """Daily positions, cash, deposits and value of every portfolio and of all together."""
    return metrics(v, combined=True)


@query("daily_fx_rates", "fxd", "SELECT currency, date, rate AS eur_per_unit FROM fxd", "currency date:t eur_per_unit:d")
def daily_fx_rates(v):
    """FX on every calendar day, filled forward and backward."""
    return ledger.daily_fx(v.fx(), *span(v))


@query(
    "ledger_types",
    "ledger_raw",
    f"SELECT description, raw_change > 0 AS positive, {TYPE_CASE} AS type, count(*) AS n FROM ledger_raw GROUP BY 1, 2, 3",
    "description positive type n:i",
)
def ledger_types(v):
    """Ledger row classification by text rules."""
    rows = v.ledger_raw().withColumn("type", rules.account_type("description", "raw_change"))
    return rows.groupBy("description", (F.col("raw_change") > 0).alias("positive"), "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_eur_changes",
    "eur_ledger",
    f"SELECT account_label, currency, {SUM0('change_filled')} AS change_eur, {SUM0('balance_filled')} AS balance_eur, {SUM0('coalesce(change_eur, CASE WHEN currency = ' + chr(39) + 'EUR' + chr(39) + ' THEN raw_change END)')} AS effective_eur, count(*) - count(change_eur) AS filled FROM eur_ledger GROUP BY 1, 2",
    "account_label currency change_eur:d balance_eur:d effective_eur:d filled:i",
)
def ledger_eur_changes(v):
    """Dated FX join: EUR amounts per portfolio and currency."""
    rows = eur_ledger(v).withColumn("effective", ledger.effective_eur_change())
    return rows.groupBy("account_label", "currency").agg(
        numbers.money_sum0("change_eur_filled").alias("change_eur"),
        numbers.money_sum0("balance_eur_filled").alias("balance_eur"),
        numbers.money_sum0("effective").alias("effective_eur"),
        (F.count(F.lit(1)) - F.count("change_eur")).alias("filled"),
    )


_NUMBER_TEXT = """(SELECT o_orderkey AS id, o_totalprice AS t, CAST(floor(o_totalprice) AS BIGINT) AS whole,
 lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS c FROM orders)"""


@query(
    "parse_amounts",
    "",
    f"""SELECT id, CASE id % 6 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN -t WHEN 3 THEN t WHEN 4 THEN NULL ELSE NULL END AS parsed,
 CASE id % 6 WHEN 0 THEN t WHEN 1 THEN t WHEN 3 THEN t END AS user_parsed FROM {_NUMBER_TEXT}""",
    "id parsed:d user_parsed:d",
)
def parse_amounts(v):
    """Amount texts in six styles, built from the order totals, parsed back."""
    o = v.table("orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, rest = F.expr("o_cents div 100"), F.lpad((F.col("o_cents") % 100).cast("string"), 2, "0")
    grouped = F.when(whole >= 1000, F.concat(F.expr("cast((o_cents div 100) div 1000 as string)"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    english = F.translate(grouped, ".", ",")
    style = F.col("o_orderkey") % 6
    shown = (
        F.when(style == 0, F.concat(grouped, F.lit(","), rest))
        .when(style == 1, F.concat(english, F.lit("."), rest))
        .when(style == 2, F.concat(F.lit("("), english, F.lit("."), rest, F.lit(")")))
        .when(style == 3, F.concat(F.lit(" "), whole.cast("string"), F.lit(","), rest, F.lit(" ")))
        .when(style == 4, F.concat(grouped, F.lit(".000."), rest, F.lit("x")))
        .otherwise("-")
    )
    rows = o.withColumn("o_cents", cents).select(F.col("o_orderkey").alias("id"), shown.alias("txt"))
    return rows.select("id", numbers.parse_decimal("txt").alias("parsed"), numbers.parse_user_float("txt").alias("user_parsed"))


@query(
    "parse_dates",
    "",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN CAST(o_orderdate AS TIMESTAMP)
 ELSE o_orderdate + to_minutes(o_custkey % 1440) END AS ts FROM orders""",
    "id ts:s",
)
def parse_dates(v):
    """Day-first date and time texts, built from the order dates, parsed back."""
    mins = F.col("o_custkey") % 1440
    clock = F.concat(F.lpad(F.expr("cast((o_custkey % 1440) div 60 as string)"), 2, "0"), F.lit(":"), F.lpad((mins % 60).cast("string"), 2, "0"))
    kind = F.col("o_orderkey") % 4
    day = (
        F.when(kind == 0, F.date_format("o_orderdate", "dd-MM-yyyy"))
        .when(kind == 1, F.date_format("o_orderdate", "d/M/yyyy"))
        .when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "yyyy 'week' dd"))
    )
    time = F.when(kind != 2, clock).otherwise("")
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), day.alias("d"), time.alias("t"))
    return rows.select("id", text.parse_day_first("d", "t").alias("ts"))


@query(
    "trade_signs",
    "tx",
    """SELECT side, hint, count(*) AS n, sum(q) AS q FROM (SELECT CASE WHEN row_seq % 3 = 0 THEN 'Verkoop' WHEN row_seq % 3 = 1 THEN 'Koop' ELSE 'Fund' END AS side,
 sign(total_eur) AS hint, CASE WHEN row_seq % 3 = 1 OR total_eur < 0 THEN abs(quantity) WHEN row_seq % 3 = 0 OR total_eur > 0 THEN -abs(quantity) ELSE abs(quantity) END AS q FROM tx) GROUP BY 1, 2""",
    "side hint:d n:i q:d",
)
def trade_signs(v):
    """Quantity sign from direction words and the sign of the total; buy hints win."""
    side = F.when(F.col("row_seq") % 3 == 0, "Verkoop").when(F.col("row_seq") % 3 == 1, "Koop").otherwise("Fund")
    rows = v.tx().withColumn("side", side).withColumn("quantity", F.abs("quantity"))
    signed = rules.signed_quantity("quantity", "total_eur", "side", F.lit(""))
    return rows.groupBy("side", F.signum("total_eur").alias("hint")).agg(F.count(F.lit(1)).alias("n"), F.sum(signed).alias("q"))


_CATS = f"""SELECT account_label, type AS category, count(*) AS row_count, {SUM0('change_filled')} AS net_eur,
 {SUM0('greatest(change_filled, 0)')} AS inflow_eur, {SUM0('greatest(-change_filled, 0)')} AS outflow_eur,
 bool_or(is_internal_transfer) AS is_internal_transfer, bool_or(is_external_flow) AS is_external_flow FROM eur_ledger"""


@query(
    "account_categories",
    "eur_ledger",
    f"{_CATS} GROUP BY 1, 2 UNION ALL {_CATS.replace('SELECT account_label,', 'SELECT ' + chr(39) + 'Combined' + chr(39) + ' AS account_label,')} GROUP BY 1, 2",
    "account_label category row_count:i net_eur:d inflow_eur:d outflow_eur:d is_internal_transfer is_external_flow",
)
def account_categories(v):
    """Count, net, inflow and outflow per ledger category, per portfolio and combined."""
    return ledger.category_summary(eur_ledger(v), combined=True)


@query(
    "costs_summary",
    "eur_ledger",
    f"""SELECT *, transaction_fee_eur + account_fee_eur + dividend_tax_eur AS total_costs_eur, promo_income_eur AS total_income_eur,
 transaction_fee_eur + account_fee_eur + dividend_tax_eur - promo_income_eur AS net_cost_minus_income_eur FROM (SELECT account_label,
 {SUM0("CASE WHEN type = 'transaction_fee' THEN greatest(-change_filled, 0) END")} AS transaction_fee_eur,
 {SUM0("CASE WHEN type = 'account_fee' THEN greatest(-change_filled, 0) END")} AS account_fee_eur,
 {SUM0("CASE WHEN type = 'dividend_tax' THEN greatest(-change_filled, 0) END")} AS dividend_tax_eur,
 {SUM0("CASE WHEN type = 'promo' THEN greatest(change_filled, 0) END")} AS promo_income_eur FROM eur_ledger GROUP BY 1)""",
    "account_label transaction_fee_eur:d account_fee_eur:d dividend_tax_eur:d total_costs_eur:d promo_income_eur:d total_income_eur:d net_cost_minus_income_eur:d",
)
def costs_summary(v):
    """Cost and income summary per portfolio."""
    return ledger.costs_summary(ledger.category_summary(eur_ledger(v)))


_Q = "CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR)"
_QCOST = f"""(SELECT {_Q} AS quarter, account_label, {SUM0("CASE WHEN type = 'transaction_fee' THEN greatest(-coalesce(change_eur, 0), 0) END")} AS transaction_fee_eur,
 {SUM0("CASE WHEN type = 'account_fee' THEN greatest(-coalesce(change_eur, 0), 0) END")} AS account_fee_eur,
 {SUM0("CASE WHEN type = 'dividend_tax' THEN greatest(-coalesce(change_eur, 0), 0) END")} AS dividend_tax_eur,
 {SUM0('greatest(-coalesce(change_eur, 0), 0)')} AS total_costs_eur FROM ledger WHERE is_cost GROUP BY 1, 2)
 FULL JOIN (SELECT {_Q} AS quarter, account_label, count(*) AS tc, count(DISTINCT upper(type)) AS mc FROM tx WHERE quantity <> 0 GROUP BY 1, 2)
 USING (quarter, account_label)"""


@query(
    "quarterly_costs",
    "ledger tx",
    f"""SELECT quarter, account_label, coalesce(transaction_fee_eur, 0) AS transaction_fee_eur, coalesce(account_fee_eur, 0) AS account_fee_eur,
 coalesce(dividend_tax_eur, 0) AS dividend_tax_eur, coalesce(total_costs_eur, 0) AS total_costs_eur, coalesce(tc, 0) AS trade_count, coalesce(mc, 0) AS market_count FROM {_QCOST}""",
    "quarter account_label transaction_fee_eur:d account_fee_eur:d dividend_tax_eur:d total_costs_eur:d trade_count:i market_count:i",
)
def quarterly_costs(v):
    """Quarterly costs by type with trade and market counts."""
    return ledger.quarterly_costs(v.ledger(), v.tx())


@query(
    "quarterly_costs_rollup",
    "ledger tx",
    f"SELECT quarter, {SUM0('transaction_fee_eur')} AS transaction_fee_eur, {SUM0('account_fee_eur')} AS account_fee_eur, {SUM0('dividend_tax_eur')} AS dividend_tax_eur, {SUM0('total_costs_eur')} AS total_costs_eur, coalesce(sum(tc), 0) AS trade_count, coalesce(max(mc), 0) AS max_market_count FROM {_QCOST} GROUP BY 1",
    "quarter transaction_fee_eur:d account_fee_eur:d dividend_tax_eur:d total_costs_eur:d trade_count:i max_market_count:i",
)
def quarterly_costs_rollup(v):
    """Quarterly costs over all portfolios."""
    return ledger.quarterly_cost_rollup(ledger.quarterly_costs(v.ledger(), v.tx()))


@query(
    "ledger_listing",
    "ledger",
    "SELECT row_number() OVER (PARTITION BY account_label ORDER BY datetime, row_seq) AS row_number, * FROM ledger",
    "row_number:i account_label datetime:s type description currency raw_change:d change_eur:d raw_balance:d balance_eur:d fx_rate:d is_external_flow is_internal_transfer is_cost",
)
def ledger_listing(v):
    """Ledger rows per portfolio with their position in the listing."""
    return ledger.ledger_listing(v.ledger()).drop("is_income")


@query(
    "cash_gap_issues",
    "metrics",
    """SELECT account_label, 'Cash statement vs change-cumsum mismatch' AS label, count(*) AS count, max(gap) AS max_gap_eur,
 array_to_string(list_slice(list(strftime(date, '%Y-%m-%d') ORDER BY date), 1, 3), ', ') AS example_dates FROM
 (SELECT *, abs(cash_from_statement - cash_from_changes) AS gap FROM metrics) WHERE gap > 5 GROUP BY 1""",
    "account_label label count:i max_gap_eur:d example_dates",
)
def cash_gap_issues(v):
    """Days where statement cash and rebuilt cash disagree."""
    return timeseries.cash_gap_issues(metrics(v))


@query(
    "price_fill_stats",
    "eurp span",
    """SELECT instrument_id, currency, days - count(*) AS missing_before_fill, CASE WHEN count(price_eur) > 0 THEN days - count(price_eur) ELSE 0 END AS fills_applied,
 CASE WHEN count(price_eur) > 0 THEN 0 ELSE days END AS remaining_missing, max(date) AS latest_price_date FROM eurp, (SELECT e - s + 1 AS days FROM span) GROUP BY 1, 2, days""",
    "instrument_id currency missing_before_fill:i fills_applied:i remaining_missing:i latest_price_date:t",
)
def price_fill_stats(v):
    """Missing and filled price days per instrument."""
    return timeseries.price_fill_stats(v.prices(), v.instruments(), v.fx(), *span(v))


@query(
    "cash_timeline",
    "metrics",
    """SELECT account_label, row_number() OVER w AS row_number, date, cash - coalesce(lag(cash) OVER w, cash) AS cash_day_change_eur,
 total_deposits - coalesce(lag(total_deposits) OVER w, 0) AS external_flow_day_eur, cash AS cash_eur, cash AS cash_from_changes_eur,
 cash_from_statement AS cash_from_statement_eur, total_deposits AS total_deposits_eur, positions_value AS positions_value_eur,
 portfolio_value AS portfolio_value_eur, cash_from_statement - cash AS cash_statement_vs_changes_delta_eur
 FROM metrics WINDOW w AS (PARTITION BY account_label ORDER BY date)""",
    "account_label row_number:i date:t cash_day_change_eur:d external_flow_day_eur:d cash_eur:d cash_from_changes_eur:d cash_from_statement_eur:d total_deposits_eur:d positions_value_eur:d portfolio_value_eur:d cash_statement_vs_changes_delta_eur:d",
)
def cash_timeline(v):
    """Cash and flows per day with day-on-day changes."""
    return timeseries.cash_timeline(metrics(v))


@query(
    "cash_share",
    "metrics",
    "SELECT account_label, date, CASE WHEN portfolio_value > 0 THEN cash / portfolio_value * 100.0 END AS cash_pct, 10.0 AS target_cash_pct FROM metrics",
    "account_label date:t cash_pct:d target_cash_pct:d",
)
def cash_share(v):
    """Cash share of portfolio value next to its target."""
    return timeseries.cash_share(metrics(v))


@query(
    "daily_returns",
    "factors",
    "SELECT account_label, date, factor - 1 AS ret FROM factors WHERE factor IS NOT NULL",
    "account_label date:t ret:d",
)
def daily_returns(v):
    """Flow-adjusted daily returns."""
    return performance.daily_returns(metrics(v))


@query(
    "trailing_performance",
    "factors",
    """SELECT account_label, period, min(date) AS start_date, max(date) AS end_date, arg_min(portfolio_value, date) AS start_value_eur,
 arg_max(portfolio_value, date) AS end_value_eur, arg_max(portfolio_value, date) - arg_min(portfolio_value, date) AS total_change_eur,
 arg_max(total_deposits, date) - arg_min(total_deposits, date) AS net_flow_eur,
 arg_max(portfolio_value, date) - arg_min(portfolio_value, date) - (arg_max(total_deposits, date) - arg_min(total_deposits, date)) AS investment_pnl_eur,
 (product(CASE WHEN date > ss AND factor > 0 THEN factor END) - 1) * 100 AS twr_ex_flows_pct,
 CASE WHEN max(date) - min(date) >= 30 AND product(CASE WHEN date > ss AND factor > 0 THEN factor END) - 1 > -0.999
 THEN (pow(product(CASE WHEN date > ss AND factor > 0 THEN factor END), 365.0 / (max(date) - min(date))) - 1) * 100 END AS annualized_twr_pct
 FROM (SELECT *, greatest(first_date, CASE WHEN n IS NULL THEN first_date ELSE last_date - n END) AS ss FROM factors CROSS JOIN
 (VALUES ('30D', 30), ('90D', 90), ('180D', 180), ('365D', 365), ('Since start', NULL)) AS p(period, n))
 WHERE date >= ss GROUP BY 1, 2 HAVING count(*) >= 2""",
    "account_label period start_date:t end_date:t start_value_eur:d end_value_eur:d total_change_eur:d net_flow_eur:d investment_pnl_eur:d twr_ex_flows_pct:d annualized_twr_pct:d",
)
def trailing_performance(v):
    """Trailing-window performance per portfolio."""
    return performance.trailing_performance(metrics(v))


@query(
    "monthly_performance",
    "metrics",
    """SELECT account_label, month, s AS start_value_eur, v AS end_value_eur, v - s AS total_change_eur, dep - ds AS net_flow_eur,
 v - s - (dep - ds) AS investment_pnl_eur, CASE WHEN s > 0 THEN (v - s - (dep - ds)) / s * 100 END AS return_ex_flows_pct FROM (
 SELECT *, lag(v) OVER w AS s, lag(dep) OVER w AS ds, row_number() OVER w AS n FROM (SELECT account_label, strftime(date, '%Y-%m') AS month,
 arg_max(portfolio_value, date) AS v, arg_max(total_deposits, date) AS dep FROM metrics GROUP BY 1, 2) WINDOW w AS (PARTITION BY account_label ORDER BY month)) WHERE n > 1""",
    "account_label month start_value_eur:d end_value_eur:d total_change_eur:d net_flow_eur:d investment_pnl_eur:d return_ex_flows_pct:d",
)
def monthly_performance(v):
    """Month-by-month performance per portfolio."""
    return performance.monthly_performance(metrics(v))


_TAGGED = """(SELECT *, greatest(first_date, CASE mode WHEN 'yearly' THEN CAST(date_trunc('year', date) AS DATE) WHEN 'quarterly' THEN CAST(date_trunc('quarter', date) AS DATE) ELSE first_date END) AS ss,
 CASE mode WHEN 'yearly' THEN CAST(year(date) AS VARCHAR) WHEN 'quarterly' THEN CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) ELSE 'All time' END AS period
 FROM factors CROSS JOIN (VALUES ('all_time'), ('yearly'), ('quarterly')) AS p(mode))"""
_PERIODS = f"""(SELECT account_label, mode, period, min(date) AS a, max(date) AS b, arg_min(portfolio_value, date) AS start_value_eur,
 arg_max(portfolio_value, date) AS end_value_eur, arg_max(total_deposits, date) - arg_min(total_deposits, date) AS net_deposited_eur,
 (product(CASE WHEN date > ss AND factor > 0 THEN factor END) - 1) * 100 AS twr_ex_flows_pct FROM {_TAGGED} GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
_EFF = "coalesce(change_eur, CASE WHEN currency = 'EUR' THEN raw_change END)"


@query(
    "performance_dashboard",
    "factors ledger tx instruments",
    f"""SELECT p.account_label, p.mode, p.period, a AS start_date, b AS end_date, start_value_eur, net_deposited_eur, end_value_eur,
 end_value_eur - start_value_eur AS total_change_eur, end_value_eur - start_value_eur - net_deposited_eur AS investment_pnl_eur, twr_ex_flows_pct,
 coalesce(tf, 0) AS transaction_fee_eur, coalesce(af, 0) AS account_fee_eur, coalesce(dt, 0) AS dividend_tax_eur, coalesce(tf, 0) + coalesce(af, 0) AS platform_costs_eur,
 coalesce(n, 0) AS number_of_trades, coalesce(buys, 0) AS buy_trades, coalesce(sells, 0) AS sell_trades, coalesce(top_n, 0) AS most_traded_count, coalesce(top, '') AS most_traded_holding
 FROM {_PERIODS} p LEFT JOIN (SELECT p.account_label, p.mode, p.period, {SUM0("CASE WHEN type = 'transaction_fee' THEN o END")} AS tf,
 {SUM0("CASE WHEN type = 'account_fee' THEN o END")} AS af, {SUM0("CASE WHEN type = 'dividend_tax' THEN o END")} AS dt
 FROM {_PERIODS} p JOIN (SELECT account_label, datetime, type, greatest(-{_EFF}, 0) AS o FROM ledger WHERE is_cost) l
 ON l.account_label = p.account_label AND l.datetime >= p.a AND l.datetime <= p.b GROUP BY 1, 2, 3) c USING (account_label, mode, period)
 LEFT JOIN (SELECT account_label, mode, period, sum(n) AS n, sum(buys) AS buys, sum(sells) AS sells, max(n) AS top_n, arg_min(label, (-n, label)) AS top FROM (
 SELECT p.account_label, p.mode, p.period, i.product || ' (' || i.ticker || ')' AS label, count(*) AS n, count(*) FILTER (WHERE quantity > 0) AS buys, count(*) FILTER (WHERE quantity < 0) AS sells
 FROM {_PERIODS} p JOIN tx t ON t.account_label = p.account_label AND t.datetime >= p.a AND t.datetime <= p.b JOIN instruments i USING (instrument_id) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) t USING (account_label, mode, period)""",
    "account_label mode period start_date:t end_date:t start_value_eur:d net_deposited_eur:d end_value_eur:d total_change_eur:d investment_pnl_eur:d twr_ex_flows_pct:d transaction_fee_eur:d account_fee_eur:d dividend_tax_eur:d platform_costs_eur:d number_of_trades:i buy_trades:i sell_trades:i most_traded_count:i most_traded_holding",
)
def performance_dashboard(v):
    """All-time, yearly and quarterly rows: values, flows, TWR, costs and trades."""
    out = performance.performance_dashboard(metrics(v), v.tx(), v.ledger(), v.instruments())
    return out.drop("irr_annualized_pct", "xirr_pct")


_FLOWS = f"""SELECT account_label, 'All time' AS period, CAST(0 AS DOUBLE) AS d, -arg_min(portfolio_value, date) AS v FROM factors GROUP BY 1
 UNION ALL SELECT account_label, 'All time', CAST(max(date) - min(date) AS DOUBLE), arg_max(portfolio_value, date) FROM factors GROUP BY 1
 UNION ALL SELECT l.account_label, 'All time', CAST(CAST(l.datetime AS DATE) - f.a AS DOUBLE), -sum({_EFF}) FROM ledger l JOIN
 (SELECT account_label, min(date) AS a, max(date) AS b FROM factors GROUP BY 1) f ON f.account_label = l.account_label AND l.datetime >= f.a AND l.datetime <= f.b
 WHERE is_external_flow AND abs({_EFF}) > 1e-9 GROUP BY 1, 2, 3"""


@query(
    "money_weighted_returns",
    "factors ledger",
    f"""SELECT account_label, CASE WHEN vmax > 0 AND vmin < 0 AND flo * fhi <= 0 THEN (lo + hi) / 2 * 100 END AS xirr_pct FROM (
 WITH RECURSIVE g AS (SELECT account_label, list(v ORDER BY d, v) AS vs, list(d / 365.0 ORDER BY d, v) AS ds, max(v) AS vmax, min(v) AS vmin FROM ({_FLOWS}) GROUP BY 1),
 b AS (SELECT g.account_label, h.hi, list_sum(list_transform(range(1, len(vs) + 1), lambda i: vs[i] / pow(1 + h.hi, ds[i]))) AS fh,
  list_sum(list_transform(range(1, len(vs) + 1), lambda i: vs[i] / pow(0.001, ds[i]))) AS fl FROM g CROSS JOIN (SELECT pow(2.0, unnest(range(0, 26))) AS hi) h),
 s AS (SELECT account_label, coalesce(min(hi) FILTER (WHERE fl * fh <= 0), max(hi)) AS hi FROM b GROUP BY 1),
 r AS (SELECT g.*, CAST(-0.999 AS DOUBLE) AS lo, s.hi, b.fl AS flo, b.fh AS fhi, 0 AS it FROM g JOIN s USING (account_label) JOIN b ON b.account_label = s.account_label AND b.hi = s.hi
  UNION ALL SELECT account_label, vs, ds, vmax, vmin, CASE WHEN flo * fm <= 0 THEN lo ELSE mid END, CASE WHEN flo * fm <= 0 THEN mid ELSE hi END,
   CASE WHEN flo * fm <= 0 THEN flo ELSE fm END, CASE WHEN flo * fm <= 0 THEN fm ELSE fhi END, it + 1 FROM (SELECT *, (lo + hi) / 2 AS mid,
   list_sum(list_transform(range(1, len(vs) + 1), lambda i: vs[i] / pow(1 + (lo + hi) / 2, ds[i]))) AS fm FROM r WHERE it < 80))
 SELECT * FROM r WHERE it = 80)""",
    "account_label xirr_pct:d",
)
def money_weighted_returns(v):
    """All-time XIRR per portfolio by bisection."""
    return performance.period_rates(metrics(v), v.ledger()).where(F.col("mode") == "all_time").select("account_label", "xirr_pct")


_F = "list_sum(list_transform(range(1, len(vs) + 1), lambda i: vs[i] * pow(1 + ({r}), -ds[i])))"
_RATE_SQL = f"""WITH RECURSIVE p AS (SELECT * FROM {_PERIODS}),
 dayf AS (SELECT account_label, mode, period, list(CAST(date - ss AS DOUBLE) ORDER BY date) AS ds, list(-day_flow ORDER BY date) AS vs FROM {_TAGGED} WHERE date > ss AND abs(day_flow) > 1e-9 GROUP BY 1, 2, 3),
 ext AS (SELECT account_label, mode, period, list(d ORDER BY d) AS ds, list(v ORDER BY d) AS vs FROM (SELECT p.account_label, p.mode, p.period, CAST(CAST(l.datetime AS DATE) - p.a AS DOUBLE) AS d, -sum({_EFF}) AS v
  FROM p JOIN ledger l ON l.account_label = p.account_label AND l.datetime >= p.a AND l.datetime <= p.b WHERE is_external_flow AND abs({_EFF}) > 1e-9 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 raw AS (SELECT p.*, CAST(b - a AS DOUBLE) AS n, coalesce(dayf.ds, []) AS dd, coalesce(dayf.vs, []) AS dv, coalesce(ext.ds, dayf.ds, []) AS xd, coalesce(ext.vs, dayf.vs, []) AS xv
  FROM p LEFT JOIN dayf USING (account_label, mode, period) LEFT JOIN ext USING (account_label, mode, period)),
 g AS (SELECT * FROM (SELECT account_label, mode, period, kind, list_concat([-start_value_eur], CASE WHEN kind = 'irr' THEN dv ELSE xv END, [end_value_eur]) AS vs,
   list_transform(list_concat([0.0], CASE WHEN kind = 'irr' THEN dd ELSE xd END, [n]), lambda d: d / CASE WHEN kind = 'irr' THEN 1.0 ELSE 365.0 END) AS ds FROM raw, (VALUES ('irr'), ('xirr')) k(kind)) WHERE list_max(vs) > 0 AND list_min(vs) < 0),
 h AS (SELECT g.*, h.hi, {_F.format(r="h.hi")} AS fhi, {_F.format(r="-0.999")} AS flo FROM g, (SELECT pow(2.0, unnest(range(0, 26))) AS hi) h),
 s AS (SELECT account_label, mode, period, kind, min(hi) AS hi FROM h WHERE isfinite(flo) AND isfinite(fhi) AND flo * fhi <= 0 GROUP BY 1, 2, 3, 4),
 r AS (SELECT account_label, mode, period, kind, vs, ds, CAST(-0.999 AS DOUBLE) AS lo, hi, flo, 0 AS it FROM h JOIN s USING (account_label, mode, period, kind, hi)
  UNION ALL SELECT account_label, mode, period, kind, vs, ds, CASE WHEN flo * fm <= 0 THEN lo ELSE mid END, CASE WHEN flo * fm <= 0 THEN mid ELSE hi END, CASE WHEN flo * fm <= 0 THEN flo ELSE fm END, it + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, {_F.format(r="(lo + hi) / 2")} AS fm FROM r WHERE it < 80)),
 e AS (SELECT account_label, mode, period, kind, (lo + hi) / 2 AS rate FROM r WHERE it = 80)
 SELECT account_label, mode, period, CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END AS irr_scaled, xirr_pct FROM (
 SELECT p.account_label, p.mode, p.period, 365 * ln(1 + max(rate) FILTER (WHERE kind = 'irr' AND rate > -0.999)) AS x, max(rate) FILTER (WHERE kind = 'xirr') * 100 AS xirr_pct
 FROM p LEFT JOIN e USING (account_label, mode, period) GROUP BY 1, 2, 3)"""


@query("period_rates", "factors ledger", _RATE_SQL, "account_label mode period irr_scaled:d xirr_pct:d")
def period_rates(v):
    """XIRR and annualized IRR of every portfolio and period.

    A gain over 90 days, made annual, can have thirty digits: gains are the logarithm of the growth factor here.
    """
    irr = F.col("irr_annualized_pct") / 100
    out = performance.period_rates(metrics(v), v.ledger())
    return out.select("account_label", "mode", "period", F.when(irr > 0, F.log(1 + irr)).otherwise(irr).alias("irr_scaled"), "xirr_pct")


@query(
    "drawdown_summary",
    "metrics",
    """SELECT account_label, cur * 100 AS current_drawdown_pct, worst * 100 AS max_drawdown_pct, wd AS max_drawdown_date,
 CASE WHEN cur < 0 THEN ld - pd ELSE 0 END AS days_since_peak, CASE WHEN cur < 0 AND cur > -0.999 THEN (1 / (1 + cur) - 1) * 100 END AS recovery_needed_pct FROM (
 SELECT account_label, arg_max_null(dd, date) AS cur, min(dd) AS worst, arg_min(date, (dd, date)) FILTER (WHERE dd IS NOT NULL) AS wd, max(date) AS ld,
 max(date) FILTER (WHERE portfolio_value = peak) AS pd FROM (SELECT *, CASE WHEN peak <> 0 THEN portfolio_value / peak - 1 END AS dd FROM (SELECT account_label, date, portfolio_value,
 max(portfolio_value) OVER (PARTITION BY account_label ORDER BY date) AS peak FROM metrics)) GROUP BY 1)""",
    "account_label current_drawdown_pct:d max_drawdown_pct:d max_drawdown_date:t days_since_peak:i recovery_needed_pct:d",
)
def drawdown_summary(v):
    """Current and worst drawdown per portfolio."""
    return performance.drawdown_summary(metrics(v))


@query(
    "growth_table",
    "metrics",
    """SELECT m.account_label, period, at_ AS start_date, e AS end_date, s AS start_eur, ev AS end_eur, ed - sd AS deposited_cash_eur, ev - s AS chg_eur,
 ev - s - (ed - sd) AS growth_eur, CASE WHEN abs(s) > 1e-12 THEN (ev - s) / s * 100 END AS chg_pct FROM (
 SELECT l.account_label, l.period, l.at_, l.e, l.ev, l.ed, arg_max(portfolio_value, date) AS s, arg_max(total_deposits, date) AS sd FROM metrics m JOIN (
 SELECT account_label, unnest(['1D', '7D', 'MTD']) AS period, unnest([e - 1, e - 7, CAST(date_trunc('month', e) AS DATE) - 1]) AS at_, e, ev, ed FROM (
 SELECT account_label, max(date) AS e, arg_max(portfolio_value, date) AS ev, arg_max(total_deposits, date) AS ed FROM metrics GROUP BY 1)) l
 ON l.account_label = m.account_label AND m.date <= l.at_ GROUP BY 1, 2, 3, 4, 5, 6) m""",
    "account_label period start_date:t end_date:t start_eur:d end_eur:d deposited_cash_eur:d chg_eur:d growth_eur:d chg_pct:d",
)
def growth_table(v):
    """1D, 7D and month-to-date growth with deposits removed."""
    return performance.growth_table(metrics(v)).drop("ticker_last_update")


@query(
    "monthly_start_values",
    "metrics",
    f"""SELECT month_start, coalesce(vd, month_start - 1) AS valuation_date, total AS total_portfolio_value_eur, n AS portfolio_count, md AS manual_source_date,
 mt AS manual_tracked_total_eur, total - mt AS delta_total_vs_manual_eur FROM (SELECT CAST(date + 1 AS DATE) AS month_start, max(date) AS vd, {money_sum('portfolio_value')} AS total, count(*) AS n
 FROM metrics WHERE day(date + 1) = 1 AND date < (SELECT max(date) FROM metrics) GROUP BY 1) FULL JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
 CAST(max(o_orderdate) AS DATE) AS md, {money_sum0('o_totalprice')} AS mt0, arg_max(t, d) AS mt FROM (SELECT o_orderdate, o_totalprice, CAST(o_orderdate AS DATE) AS d,
 sum(CAST(o_totalprice AS DECIMAL(28,2))) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS t FROM orders) GROUP BY 1) USING (month_start)""",
    "month_start:t valuation_date:t total_portfolio_value_eur:d portfolio_count:i manual_source_date:t manual_tracked_total_eur:d delta_total_vs_manual_eur:d",
)
def monthly_start_values(v):
    """Month-start totals next to a hand-kept reference (daily order totals as M/d/yyyy texts)."""
    daily = v.table("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("t"))
    raw = daily.select(F.date_format("d", "M/d/yyyy").alias("date_text"), F.translate(F.col("t").cast("string"), ".", ",").alias("value_text"))
    return performance.monthly_start_values(metrics(v), tables.manual_reference(raw))


@query(
    "contribution_pace",
    "metrics",
    f"""SELECT account_label, count(*) AS months, avg(flow) AS avg_net_flow_eur FROM (SELECT *, row_number() OVER (PARTITION BY account_label ORDER BY month DESC) AS rn FROM (
 SELECT account_label, strftime(date, '%Y-%m') AS month, {SUM0('f')} AS flow FROM (SELECT *, coalesce(total_deposits - lag(total_deposits) OVER (PARTITION BY account_label ORDER BY date), total_deposits) AS f
 FROM metrics) GROUP BY 1, 2)) WHERE rn <= 6 GROUP BY 1""",
    "account_label months:i avg_net_flow_eur:d",
)
def contribution_pace(v):
    """Mean monthly net flow over the last six months."""
    return performance.contribution_pace(metrics(v))


def benchmark_levels_of(v: SampleViews) -> DataFrame:
    """One benchmark per asset type: the instrument with the smallest id text of that type."""
    specs = (
        v.instruments()
        .groupBy(F.col("gics_sector").alias("series"))
        .agg(F.min(F.struct("instrument_id", "currency")).alias("m"))
        .select("series", F.col("m.instrument_id").alias("ticker"), "m.currency")
    )
    prices = v.prices().withColumnRenamed("instrument_id", "ticker")
    return performance.benchmark_levels(prices, v.fx(), specs, *span(v))


_BENCH = """(SELECT series, date, level, level / first_value(level) OVER w * 100 AS rebased, level / lag(level) OVER w - 1 AS ret FROM (
 SELECT series, date, c * CASE WHEN currency = 'EUR' THEN 1.0::DOUBLE ELSE rate END AS level FROM (SELECT *, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY date),
 first_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c FROM (
 SELECT b.series, b.currency, cal.date, p.close FROM (SELECT gics_sector AS series, min(instrument_id) AS instrument_id, arg_min(currency, instrument_id) AS currency FROM instruments GROUP BY 1) b
 CROSS JOIN cal LEFT JOIN prices p ON p.instrument_id = b.instrument_id AND p.date = cal.date)) LEFT JOIN fxd USING (currency, date)) WINDOW w AS (PARTITION BY series ORDER BY date))"""


@query("benchmark_levels", "instruments prices fxd cal", f"SELECT * FROM {_BENCH}", "series date:t level:d rebased:d ret:d")
def benchmark_levels(v):
    """Benchmark levels in EUR, rebased to 100, with percent changes."""
    return benchmark_levels_of(v)


@query(
    "benchmark_statistics",
    "factors instruments prices fxd cal",
    f"""SELECT account_label, benchmark, beta, (mp - beta * mb) * 25200 AS alpha_annualized_pct, correlation, te AS tracking_error_annualized_pct, bc AS benchmark_return_aligned_pct, n AS sample_days FROM (
 SELECT account_label, series AS benchmark, CASE WHEN var_pop(b) > 1e-12 THEN covar_samp(r, b) / var_pop(b) END AS beta, avg(r) AS mp, avg(b) AS mb, corr(r, b) AS correlation,
 stddev_pop(r - b) * sqrt(252) * 100 AS te, (product(1 + b) - 1) * 100 AS bc, count(*) AS n FROM (SELECT f.account_label, f.factor - 1 AS r, x.series, x.ret AS b FROM factors f JOIN {_BENCH} x ON x.date = f.date
 WHERE f.factor IS NOT NULL AND x.ret IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 40)""",
    "account_label benchmark beta:d alpha_annualized_pct:d correlation:d tracking_error_annualized_pct:d benchmark_return_aligned_pct:d sample_days:i",
)
def benchmark_statistics(v):
    """Alpha, beta, correlation and tracking error against each benchmark."""
    return performance.benchmark_statistics(metrics(v), benchmark_levels_of(v)).drop("portfolio_return_aligned_pct")


def settled(x):
    """Ten-thousandths, so that chained and one-pass folds agree to the last digit."""
    return F.floor(F.col(x) * 10000 + 0.5) / 10000


def _settled_sql(x: str) -> str:
    return f"floor({x} * 10000 + 0.5) / 10000"


_FOLD = """(SELECT instrument_id, list({'q': quantity, 's': greatest(-total_eur + FEE, 0)} ORDER BY datetime, row_seq, quantity, greatest(-total_eur + FEE, 0)) AS t FROM tx GROUP BY 1)"""
_STEP = """list_reduce(list_prepend({'q': CAST(0 AS DOUBLE), 's': CAST(0 AS DOUBLE)}, t), lambda a, x: CASE WHEN x.q > 0 THEN {'q': a.q + x.q, 's': a.s + x.s}
 WHEN a.q <= 1e-12 OR a.q + x.q <= 1e-9 THEN {'q': CAST(0 AS DOUBLE), 's': CAST(0 AS DOUBLE)} ELSE {'q': a.q + x.q, 's': greatest(a.s - a.s / a.q * least(-x.q, a.q), 0)} END)"""


@query(
    "open_cost_basis",
    "tx",
    f"SELECT instrument_id, r.q AS open_quantity, {_settled_sql("r.s")} AS cost_basis_eur FROM (SELECT instrument_id, {_STEP} AS r FROM {_FOLD.replace('FEE', 'abs(fees_eur)')})",
    "instrument_id open_quantity:d cost_basis_eur:d",
)
def open_cost_basis(v):
    """Moving-average cost of open positions, buys including fees."""
    out = costbasis.open_cost_basis(v.tx(), ("instrument_id",), include_fees=True)
    return out.withColumn("cost_basis_eur", settled("cost_basis_eur"))


@query(
    "daily_cost_basis",
    "tx",
    f"""SELECT instrument_id, date, r.q AS open_quantity, {_settled_sql("r.s")} AS cost_basis_eur FROM (SELECT instrument_id, date, {_STEP} AS r FROM (SELECT d.instrument_id, d.date,
 list({{'q': quantity, 's': greatest(-total_eur, 0)}} ORDER BY datetime, row_seq, quantity, greatest(-total_eur, 0)) AS t FROM (SELECT DISTINCT instrument_id, date FROM tx) d JOIN tx
 ON tx.instrument_id = d.instrument_id AND tx.date <= d.date GROUP BY 1, 2))""",
    "instrument_id date:t open_quantity:d cost_basis_eur:d",
)
def daily_cost_basis(v):
    """Cost basis after every trading day, fees left out."""
    return costbasis.daily_cost_basis(v.tx(), ("instrument_id",)).withColumn("cost_basis_eur", settled("cost_basis_eur"))


@query(
    "normalized_median",
    "dense_price",
    """SELECT instrument_id, arg_max(p, date) AS latest_price_eur, count(n) AS days, arg_max(n, date) AS latest_normalized, min(n) AS min_normalized, max(n) AS max_normalized FROM (
 SELECT *, CASE WHEN k >= 61 THEN p / med END AS n FROM (SELECT instrument_id, date, units / 1000000.0::DOUBLE AS p, median(units / 1000000.0::DOUBLE) OVER w AS med, count(*) OVER w AS k FROM dense_price
 WINDOW w AS (PARTITION BY instrument_id ORDER BY date ROWS 182 PRECEDING))) GROUP BY 1""",
    "instrument_id latest_price_eur:d days:i latest_normalized:d min_normalized:d max_normalized:d",
)
def normalized_median(v):
    """Price over its rolling six-month median: latest value and range per instrument."""
    events = eur_events(v).withColumn("price_eur", F.floor(F.col("price_eur") * 1e6 + 0.5) / 1e6)
    return series.normalized_latest(events, *span(v), median_months=6)


@query("smoothed_median")
def smoothed_median(v):
    """The same after zero-phase low-pass smoothing."""
    return series.normalized_latest(eur_events(v), *span(v), median_months=6, lowpass=True)


@query(
    "activity_range",
    "tx ledger",
    "SELECT account_label, min(date) AS first_date, max(date) AS last_date FROM (SELECT account_label, date FROM tx UNION ALL SELECT account_label, date FROM ledger) GROUP BY 1",
    "account_label first_date:t last_date:t",
)
def activity_range(v):
    """First and last active day per portfolio."""
    return quality.activity_range(v.tx(), v.ledger())


@query(
    "ledger_coverage",
    "tx ledger",
    """SELECT account_label, first_tx AS first_transaction_date, first_acct AS first_account_date, (SELECT count(*) FROM tx WHERE tx.account_label = a.account_label AND tx.date < first_acct) AS transactions_before_account_start
 FROM (SELECT account_label, min(date) AS first_tx FROM tx GROUP BY 1) a JOIN (SELECT account_label, min(date) AS first_acct FROM ledger GROUP BY 1) USING (account_label) WHERE first_acct > first_tx""",
    "account_label first_transaction_date:t first_account_date:t transactions_before_account_start:i",
)
def ledger_coverage(v):
    """Portfolios whose ledger starts after their trades."""
    return quality.ledger_coverage(v.tx(), v.ledger())


@query(
    "peak_position_values",
    "tx dense_price span",
    """SELECT instrument_id, max(qty * units) / 1000000 AS peak_value_eur FROM (SELECT instrument_id, a, b, qty FROM (SELECT instrument_id, date AS a, sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS qty,
 coalesce(lead(date) OVER w, (SELECT e FROM span) + 1) AS b FROM (SELECT instrument_id, date, sum(quantity) AS q FROM tx GROUP BY 1, 2) WINDOW w AS (PARTITION BY instrument_id ORDER BY date))) JOIN dense_price USING (instrument_id)
 WHERE date >= a AND date < b GROUP BY 1""",
    "instrument_id peak_value_eur:d",
)
def peak_position_values(v):
    """Highest daily value of each instrument over all portfolios."""
    start, end = span(v)
    net = timeseries.known_trades(timeseries.daily_trades(v.tx()), v.instruments())
    return series.position_value_peaks(net, timeseries.price_moves(eur_events(v), start, end), end)
