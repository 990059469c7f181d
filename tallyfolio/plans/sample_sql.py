"""The sample views of `sample_views.py` as ANSI SQL common table expressions."""

from __future__ import annotations


def _cents(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def money_sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,6))) AS DOUBLE)"


def money_sum0(x: str) -> str:
    return f"coalesce({money_sum(x)}, 0.0)"


TYPE_CASE = """CASE
 WHEN regexp_matches(lower(description), '\\b(koop|verkoop|buy|sell)\\b') THEN 'trade_settlement'
 WHEN lower(description) LIKE '%terugstorting%' THEN 'external_withdrawal'
 WHEN lower(description) LIKE '%flatex storting%' THEN 'external_deposit'
 WHEN lower(description) LIKE '%reservation ideal%' AND raw_change < 0 THEN 'reservation_hold'
 WHEN lower(description) LIKE '%reservation ideal%' AND raw_change > 0 THEN 'external_deposit'
 WHEN lower(description) LIKE '%verrekening promotie%' THEN 'promo'
 WHEN lower(description) LIKE '%interest income%' THEN 'interest'
 WHEN lower(description) LIKE '%dividendbelasting%' THEN 'dividend_tax'
 WHEN lower(description) LIKE '%dividend%' THEN 'dividend'
 WHEN lower(description) LIKE '%aansluitingskosten%' THEN 'account_fee'
 WHEN lower(description) LIKE '%transactiekosten%' THEN 'transaction_fee'
 WHEN lower(description) LIKE '%valuta debitering%' THEN 'fx_conversion'
 WHEN lower(description) LIKE '%cash sweep%' THEN 'internal_cash_sweep'
 ELSE 'other' END"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "tx": (
        [],
        f"""SELECT 'P' || CAST(o_custkey // 10 AS VARCHAR) AS account_label,
 'I' || CAST(l_partkey AS VARCHAR) AS instrument_id,
 l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS datetime, CAST(l_shipdate AS DATE) AS date,
 l_orderkey * 10 + l_linenumber AS row_seq,
 CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
 {_cents("l_extendedprice / l_quantity")} AS price,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * {_cents("l_extendedprice * (1 - l_discount)")} AS total_eur,
 {_cents("l_extendedprice * l_tax / 100")} AS fees_eur,
 CASE WHEN l_linestatus = 'F' THEN 'XAMS' ELSE 'XETR' END AS type
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "instruments": (
        [],
        """SELECT 'I' || CAST(p_partkey AS VARCHAR) AS instrument_id, p_name AS product,
 'I' || CAST(p_partkey AS VARCHAR) AS isin, 'T' || CAST(p_partkey AS VARCHAR) AS ticker,
 (['EUR', 'USD', 'GBP'])[p_size % 3 + 1] AS currency,
 CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'ETF' ELSE 'Equity' END AS asset_class,
 (['Growth', 'Value', 'Blend', 'Dividend', ''])[p_partkey % 5 + 1] AS primary_style,
 CASE p_partkey % 4 WHEN 0 THEN 'Quality' WHEN 1 THEN 'Momentum' ELSE '' END AS secondary_factor,
 p_type AS gics_sector, p_brand AS gics_industry_group,
 CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS gics_industry, p_brand AS gics_sub_industry,
 p_type IN ('PROMO', 'STANDARD') AS is_etf FROM part""",
    ),
    "prices": (
        [],
        f"""SELECT 'I' || CAST(l_partkey AS VARCHAR) AS instrument_id, CAST(l_shipdate AS DATE) AS date,
 {_cents("CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(18,8))) AS DOUBLE) / count(*)")} AS close
 FROM lineitem GROUP BY 1, 2""",
    ),
    "fx": (
        [],
        """SELECT currency, date, round(base + m / 10000.0, 4) AS eur_per_unit FROM (
 SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice * 100 AS DECIMAL(20,0))) AS BIGINT) % 1000 AS m
 FROM orders GROUP BY 1), (VALUES ('USD', CAST(0.85 AS DOUBLE)), ('GBP', CAST(1.12 AS DOUBLE))) AS c(currency, base)""",
    ),
    "ledger_raw": (
        [],
        f"""SELECT 'P' || CAST(user_id AS VARCHAR) AS account_label,
 TIMESTAMP '1995-01-02 00:00:00' + to_seconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) * 83 // 1000000) AS datetime,
 event_id AS row_seq,
 CASE event_type
  WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'flatex terugstorting' ELSE 'flatex Storting' END
  WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'Koop 10 stuks' ELSE 'Verkoop 5 stuks' END
  WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'Dividendbelasting' ELSE 'Dividend' END
  WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'Transactiekosten en/of kosten van derden' ELSE 'Aansluitingskosten' END
  ELSE CASE k % 5 WHEN 0 THEN 'Valuta Debitering' WHEN 1 THEN 'Cash Sweep Transfer' WHEN 2 THEN 'Verrekening promotie'
   WHEN 3 THEN 'Flatex Interest Income' ELSE 'Reservation iDEAL / Sofort Deposit' END END AS description,
 CASE WHEN k % 10 < 7 THEN 'EUR' WHEN k % 10 < 9 THEN 'USD' ELSE 'GBP' END AS currency,
 CASE WHEN (event_type = 'signup' AND k % 4 = 0) OR (event_type = 'purchase' AND k % 2 = 0)
   OR (event_type = 'click' AND k % 3 = 0) OR event_type = 'view' OR (event_type = 'error' AND k % 2 = 0)
  THEN -1.0 ELSE 1.0 END
  * {_cents("CASE event_type WHEN 'signup' THEN 10000.0 WHEN 'purchase' THEN 100.0 ELSE 1.0 END::DOUBLE * value")} AS raw_change,
 {_cents("value * 50")} AS raw_balance,
 CASE WHEN k % 10 >= 7 AND k % 2 = 1 THEN round(1.1 + k / 1000.0, 3)::DOUBLE END AS fx_rate
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""",
    ),
    "ledger": (
        ["ledger_raw"],
        """SELECT *, type IN ('external_deposit', 'external_withdrawal') AS is_external_flow,
 type IN ('internal_cash_sweep', 'fx_conversion', 'reservation_hold', 'reservation_settlement') AS is_internal_transfer,
 type IN ('transaction_fee', 'account_fee', 'dividend_tax') AS is_cost,
 raw_change / own AS change_eur, raw_balance / own AS balance_eur, CAST(datetime AS DATE) AS date
 FROM (SELECT *, CASE WHEN currency = 'EUR' THEN 1.0::DOUBLE ELSE fx_rate END AS own, """
        + TYPE_CASE
        + " AS type FROM ledger_raw)",
    ),
    "snapshot": (
        ["tx", "instruments"],
        f"""SELECT h.account_label, h.instrument_id, i.product, i.isin, i.ticker, i.currency, i.is_etf, h.quantity,
 {_cents("abs(h.quantity) * h.px")} AS value_eur, false AS is_cash_like
 FROM (SELECT account_label, instrument_id, sum(quantity) + count(*) FILTER (WHERE type = 'XETR') AS quantity, max(price) AS px FROM tx
 GROUP BY 1, 2) h JOIN instruments i USING (instrument_id)
 UNION ALL
 SELECT 'P' || CAST(c_custkey // 10 AS VARCHAR), 'CASH EUR', 'CASH EUR', NULL, '', 'EUR', false, NULL,
 {money_sum("c_acctbal")}, true FROM customer GROUP BY 1""",
    ),
    "span": (
        ["tx", "ledger"],
        """SELECT least((SELECT min(date) FROM tx), (SELECT min(date) FROM ledger)) AS s,
 greatest((SELECT max(date) FROM tx), (SELECT max(date) FROM ledger)) AS e""",
    ),
    "cal": (
        ["span"],
        "SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date FROM span",
    ),
    "fxd": (
        ["fx", "cal", "span"],
        """SELECT currency, date, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date),
 first_value(r IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate
 FROM (SELECT c.currency, cal.date, fx.eur_per_unit AS r FROM cal CROSS JOIN (VALUES ('USD'), ('GBP')) AS c(currency)
 LEFT JOIN fx ON fx.currency = c.currency AND fx.date = cal.date)""",
    ),
    "eur_ledger": (
        ["ledger", "fxd"],
        """SELECT l.*, coalesce(change_eur, raw_change * rate) AS change_filled,
 coalesce(balance_eur, raw_balance * rate) AS balance_filled
 FROM ledger l LEFT JOIN fxd ON fxd.currency = l.currency AND fxd.date = l.date""",
    ),
    "eurp": (
        ["prices", "instruments", "fx"],
        """SELECT p.instrument_id, p.date, p.close, i.currency,
 p.close * CASE WHEN i.currency = 'EUR' THEN 1.0::DOUBLE ELSE fx.eur_per_unit END AS price_eur
 FROM prices p JOIN instruments i USING (instrument_id) LEFT JOIN fx ON fx.currency = i.currency AND fx.date = p.date""",
    ),
    "latest_price": (
        ["eurp"],
        """SELECT instrument_id, arg_max(price_eur, date) AS latest_price_eur, max(date) AS latest_price_date
 FROM eurp WHERE price_eur IS NOT NULL GROUP BY 1""",
    ),
    "latest_qty": (
        ["tx"],
        "SELECT account_label, instrument_id, sum(quantity) AS latest_quantity FROM tx GROUP BY 1, 2",
    ),
    "price_iv": (
        ["eurp", "span"],
        """SELECT instrument_id, CAST(floor(price_eur * 1000000 + 0.5) AS BIGINT) AS units,
 CASE WHEN row_number() OVER w = 1 THEN (SELECT s FROM span) ELSE date END AS a,
 coalesce(lead(date) OVER w, (SELECT e FROM span) + 1) AS b
 FROM eurp WHERE price_eur IS NOT NULL WINDOW w AS (PARTITION BY instrument_id ORDER BY date)""",
    ),
    "dense_price": (
        ["price_iv", "cal"],
        "SELECT instrument_id, cal.date, units FROM price_iv JOIN cal ON cal.date >= a AND cal.date < b",
    ),
    "pos_iv": (
        ["tx", "span"],
        """SELECT account_label, instrument_id, sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS qty, date AS a,
 coalesce(lead(date) OVER w, (SELECT e FROM span) + 1) AS b
 FROM (SELECT account_label, instrument_id, date, sum(quantity) AS q FROM tx GROUP BY 1, 2, 3)
 WINDOW w AS (PARTITION BY account_label, instrument_id ORDER BY date)""",
    ),
    "pos_value": (
        ["pos_iv", "dense_price"],
        """SELECT account_label, date, sum(CAST(qty * units AS BIGINT)) AS micro
 FROM pos_iv JOIN dense_price USING (instrument_id) WHERE date >= a AND date < b AND qty <> 0 GROUP BY 1, 2""",
    ),
    "acct_cal": (
        ["tx", "ledger", "cal"],
        """SELECT account_label, cal.date FROM (SELECT account_label, min(date) AS s FROM
 (SELECT account_label, date FROM tx UNION ALL SELECT account_label, date FROM ledger) GROUP BY 1) JOIN cal ON cal.date >= s""",
    ),
    "ledger_day": (
        ["eur_ledger"],
        """SELECT account_label, date, sum(c) AS c, sum(f) AS f, sum(b) AS b FROM (
 SELECT account_label, date, currency,
 coalesce(sum(CASE WHEN NOT is_internal_transfer THEN CAST(change_filled AS DECIMAL(28,6)) END), 0) AS c,
 coalesce(sum(CASE WHEN is_external_flow THEN CAST(change_filled AS DECIMAL(28,6)) END), 0) AS f,
 CAST(arg_max(balance_filled, (datetime, row_seq)) AS DECIMAL(28,6)) AS b
 FROM eur_ledger GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ),
    "m_acct": (
        ["acct_cal", "pos_value", "ledger_day"],
        """SELECT account_label, date, CAST(coalesce(micro, 0) AS DECIMAL(38,0)) AS micro,
 coalesce(sum(c) OVER w, 0) AS cash, coalesce(sum(f) OVER w, 0) AS dep,
 coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS stmt
 FROM acct_cal LEFT JOIN pos_value USING (account_label, date) LEFT JOIN ledger_day USING (account_label, date)
 WINDOW w AS (PARTITION BY account_label ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    ),
    "metrics": (
        ["m_acct"],
        """SELECT account_label, date, CAST(micro AS DOUBLE) / 1000000 AS positions_value, CAST(cash AS DOUBLE) AS cash,
 CAST(cash AS DOUBLE) AS cash_from_changes, CAST(stmt AS DOUBLE) AS cash_from_statement,
 CAST(dep AS DOUBLE) AS total_deposits, CAST(micro + CAST((cash - dep) * 1000000 AS DECIMAL(38,0)) AS DOUBLE) / 1000000 AS profit,
 CAST(micro + CAST(cash * 1000000 AS DECIMAL(38,0)) AS DOUBLE) / 1000000 AS portfolio_value FROM m_acct""",
    ),
    "factors": (
        ["metrics"],
        """SELECT *, CASE WHEN prev > 0 THEN (portfolio_value - day_flow) / prev END AS factor FROM (
 SELECT *, lag(portfolio_value) OVER w AS prev, min(date) OVER (PARTITION BY account_label) AS first_date,
 max(date) OVER (PARTITION BY account_label) AS last_date,
 coalesce(total_deposits - lag(total_deposits) OVER w, 0) AS day_flow
 FROM metrics WINDOW w AS (PARTITION BY account_label ORDER BY date))""",
    ),
    "latest": (
        ["m_acct", "metrics", "span"],
        "SELECT * FROM metrics WHERE date = (SELECT e FROM span)",
    ),
    "detail": (
        ["ledger", "fx", "span"],
        """SELECT account_label, d.currency, raw_balance, balance_eur, datetime,
 CASE WHEN d.currency = 'EUR' THEN coalesce(raw_balance, balance_eur)
 ELSE coalesce(balance_eur, raw_balance * r.rate) END AS balance_eur_computed
 FROM (SELECT account_label, currency, arg_max(raw_balance, (datetime, row_seq)) AS raw_balance,
  arg_max_null(balance_eur, (datetime, row_seq)) AS balance_eur, max(datetime) AS datetime FROM ledger GROUP BY 1, 2) d
 LEFT JOIN (SELECT currency, arg_max(eur_per_unit, date) AS rate FROM fx, span
  WHERE date BETWEEN e - 14 AND e GROUP BY 1) r ON r.currency = d.currency""",
    ),
    "recon": (
        ["snapshot", "detail"],
        f"""SELECT *, positions_value_eur + cash_value_eur AS total_value_eur FROM (
 SELECT s.*, cash_from_account_eur, cash_from_account_eur - cash_from_portfolio_snapshot_eur AS cash_delta_eur,
 coalesce(missing_fx, 0) AS missing_fx, coalesce(cash_from_account_eur, cash_from_portfolio_snapshot_eur) AS cash_value_eur,
 CASE WHEN cash_from_account_eur IS NOT NULL THEN 'account balance' ELSE 'portfolio cash fallback' END AS cash_source
 FROM (SELECT account_label, {money_sum0("CASE WHEN is_cash_like THEN value_eur END")} AS cash_from_portfolio_snapshot_eur,
  {money_sum0("CASE WHEN NOT is_cash_like THEN value_eur END")} AS positions_value_eur,
  count(*) FILTER (WHERE is_cash_like) AS portfolio_cash_rows FROM snapshot GROUP BY 1) s
 LEFT JOIN (SELECT account_label, {money_sum("balance_eur_computed")} AS cash_from_account_eur,
  count(*) FILTER (WHERE currency <> 'EUR' AND balance_eur_computed IS NULL) AS missing_fx FROM detail GROUP BY 1) a
  USING (account_label))""",
    ),
    "recon_all": (
        ["recon"],
        f"""SELECT account_label, cash_from_account_eur, cash_from_portfolio_snapshot_eur, positions_value_eur, cash_value_eur,
 cash_delta_eur, cash_source, total_value_eur, missing_fx, portfolio_cash_rows FROM recon UNION ALL
 SELECT 'Combined', a, b, p, c, a - b, 'sum(dataset cash)', p + c, NULL, NULL FROM (SELECT
 {money_sum("cash_from_account_eur")} AS a, {money_sum("cash_from_portfolio_snapshot_eur")} AS b,
 {money_sum("positions_value_eur")} AS p, {money_sum("cash_value_eur")} AS c FROM recon)""",
    ),
    "held": (
        ["snapshot"],
        "SELECT * FROM snapshot WHERE NOT is_cash_like",
    ),
    "ranked": (
        ["held", "recon"],
        """SELECT h.*, rk, total_value_eur, cash_value_eur, value_eur / total_value_eur * 100 AS value_pct, target,
 target / 100.0 * total_value_eur AS target_value_eur, value_eur - target / 100.0 * total_value_eur AS over_target_eur FROM (
 SELECT *, CASE WHEN is_etf AND rk <= 4 THEN 45.0::DOUBLE / 4 WHEN NOT is_etf AND rk <= 12 THEN 45.0::DOUBLE / 12 ELSE 0.0 END AS target
 FROM (SELECT *, row_number() OVER (PARTITION BY account_label, is_etf ORDER BY value_eur DESC, instrument_id) AS rk FROM held)) h
 JOIN recon USING (account_label)""",
    ),
    "sleeves": (
        ["held"],
        f"""SELECT account_label, {money_sum0("CASE WHEN is_etf THEN value_eur END")} AS etf_value,
 {money_sum0("CASE WHEN NOT is_etf THEN value_eur END")} AS non_etf_value,
 count(DISTINCT CASE WHEN is_etf THEN instrument_id END) AS etf_count,
 count(DISTINCT CASE WHEN NOT is_etf THEN instrument_id END) AS non_etf_count,
 count(DISTINCT instrument_id) AS total_holdings FROM held GROUP BY 1""",
    ),
    "split": (
        ["sleeves", "recon"],
        """SELECT account_label, total_value_eur, cash_eur, etf_value, non_etf_value, te, tn, tc,
 free, short,
 CASE WHEN free > 0 THEN CASE WHEN ge + gn > 0 THEN free * ge / (ge + gn) ELSE free * 45.0 / 90.0 END ELSE 0.0 END AS to_etf,
 CASE WHEN free > 0 THEN CASE WHEN ge + gn > 0 THEN free * gn / (ge + gn) ELSE free * 45.0 / 90.0 END ELSE 0.0 END AS to_non,
 CASE WHEN short > 0 THEN CASE WHEN xe + xn > 0 THEN short * xe / (xe + xn)
  WHEN etf_value + non_etf_value > 0 THEN short * etf_value / (etf_value + non_etf_value) ELSE 0.0 END ELSE 0.0 END AS from_etf,
 CASE WHEN short > 0 THEN CASE WHEN xe + xn > 0 THEN short * xn / (xe + xn)
  WHEN etf_value + non_etf_value > 0 THEN short * non_etf_value / (etf_value + non_etf_value) ELSE 0.0 END ELSE 0.0 END AS from_non
 FROM (SELECT *, greatest(cash_eur - tc, 0) AS free, greatest(tc - cash_eur, 0) AS short, greatest(te - etf_value, 0) AS ge,
  greatest(tn - non_etf_value, 0) AS gn, greatest(etf_value - te, 0) AS xe, greatest(non_etf_value - tn, 0) AS xn
  FROM (SELECT account_label, total_value_eur, cash_value_eur AS cash_eur, coalesce(etf_value, 0) AS etf_value,
   coalesce(non_etf_value, 0) AS non_etf_value, 45.0::DOUBLE / 100.0 * total_value_eur AS te,
   45.0::DOUBLE / 100.0 * total_value_eur AS tn, 10.0::DOUBLE / 100.0 * total_value_eur AS tc
   FROM recon LEFT JOIN sleeves USING (account_label)))""",
    ),
    "alloc": (
        ["held", "instruments", "recon"],
        """SELECT account_label, dimension, category, value_eur, holding_count, CASE WHEN total_value_eur > 0 THEN
 value_eur / total_value_eur * 100.0 END AS pct_total, total_value_eur FROM (
 SELECT account_label, dimension, category, CAST(sum(CAST(value_eur AS DECIMAL(28,6))) AS DOUBLE) AS value_eur,
 count(DISTINCT instrument_id) AS holding_count FROM (
  SELECT account_label, h.instrument_id, h.value_eur, unnest(['asset_class', 'primary_style', 'secondary_factor', 'gics_sector',
  'gics_industry_group', 'gics_industry', 'gics_sub_industry', 'industry', 'style']) AS dimension,
  unnest([i.asset_class, i.primary_style, i.secondary_factor, i.gics_sector, i.gics_industry_group, i.gics_industry,
  i.gics_sub_industry, i.gics_industry, i.primary_style]) AS raw,
  coalesce(nullif(trim(raw), ''), 'Unclassified') AS category
  FROM held h JOIN instruments i USING (instrument_id)) GROUP BY 1, 2, 3) JOIN recon USING (account_label)""",
    ),
    "cur_alloc": (
        ["held", "detail", "recon"],
        """SELECT account_label, currency, coalesce(inv, 0) AS investments_eur, coalesce(cash, 0) AS cash_eur,
 coalesce(inv, 0) + coalesce(cash, 0) AS total_eur,
 CASE WHEN total_value_eur > 0 THEN (coalesce(inv, 0) + coalesce(cash, 0)) / total_value_eur * 100.0 END AS pct_total, total_value_eur
 FROM (SELECT account_label, currency, CAST(sum(CAST(value_eur AS DECIMAL(28,6))) AS DOUBLE) AS inv FROM held GROUP BY 1, 2) i
 FULL JOIN (SELECT account_label, currency, coalesce(CAST(sum(CAST(balance_eur_computed AS DECIMAL(28,6))) AS DOUBLE), 0) AS cash
  FROM detail GROUP BY 1, 2) c USING (account_label, currency) JOIN recon USING (account_label)""",
    ),
}


def with_views(names: list[str], body: str) -> str:
    """Prefix `body` with the named views and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for need in VIEWS[name][0]:
            add(need)
        order.append(name)

    for n in names:
        add(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body
