"""Two small portfolios from CSV exports to every result table."""

import datetime as dt

import pytest

from tallyfolio import analyze, load_exports
from tallyfolio.sources.strategy import resolve_strategy

TX = "Date,Time,Product,ISIN,Quantity,Price,,Value EUR,Total EUR,Transaction and/or third party fees EUR\n"
PF = "Product,Symbol/ISIN,Amount,Closing,,Value in EUR\n"
AC = "Date,Time,Value date,Product,ISIN,Description,FX,Change,,Balance,,Order Id\n"
FILES = {
    "alpha": {
        "Transactions.csv": TX
        + '02-01-2024,10:00,World ETF,IE00B4L5Y983,10,"10,00",EUR,"-100,00","-101,00","-1,00"\n'
        + '20-02-2024,10:00,World ETF,IE00B4L5Y983,4,"12,00",EUR,"48,00","47,00","-1,00"\n',
        "Portfolio.csv": PF + 'World ETF,IE00B4L5Y983,6,"12,00",EUR,"72,00"\nCASH EUR,,,,EUR,"946,00"\n',
        "Account.csv": AC
        + '02-01-2024,09:00,02-01-2024,,,flatex Storting,,"1000,00",EUR,"1000,00",EUR,\n'
        + '02-01-2024,10:00,02-01-2024,World ETF,IE00B4L5Y983,Koop 10 @ 10,,"-101,00",EUR,"899,00",EUR,a-1\n'
        + '20-02-2024,10:00,20-02-2024,World ETF,IE00B4L5Y983,Verkoop 4 @ 12,,"47,00",EUR,"946,00",EUR,a-2\n',
    },
    "beta": {
        "Transactions.csv": TX + '01-02-2024,11:00,Chip Corp,US0000000001,5,"20,00",USD,"-90,00","-90,00",\n',
        "Portfolio.csv": PF + 'Chip Corp,US0000000001,5,"22,00",USD,"99,00"\n',
        "Account.csv": AC
        + '31-01-2024,09:00,31-01-2024,,,flatex Storting,,"500,00",EUR,"500,00",EUR,\n'
        + '01-02-2024,11:00,01-02-2024,Chip Corp,US0000000001,Koop 5 @ 20,,"-90,00",EUR,"410,00",EUR,b-1\n',
    },
}


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    for folder, files in FILES.items():
        (root / folder).mkdir()
        for name, text in files.items():
            (root / folder / name).write_text(text)
    cls = spark.createDataFrame(
        [(1, "IE00B4L5Y983", "WLD", "EUR", "ETF"), (2, "US0000000001", "CHIP", "USD", "STOCK")],
        "row_seq int, instrument_id string, ticker string, currency string, asset_class string",
    ).selectExpr("*", "'Growth' primary_style", "'' secondary_factor", "'Tech' gics_sector", "'' gics_industry_group", "'Chips' gics_industry", "'' gics_sub_industry")
    inputs = load_exports(spark, str(root), cls)
    day = dt.date
    inputs.prices = spark.createDataFrame(
        [("IE00B4L5Y983", day(2024, 1, 2), 10.0), ("IE00B4L5Y983", day(2024, 3, 1), 12.5), ("US0000000001", day(2024, 2, 1), 20.0), ("US0000000001", day(2024, 3, 1), 22.0)],
        "instrument_id string, date date, close double",
    )
    inputs.fx = spark.createDataFrame(
        [("USD", day(2024, 1, 2), 0.9), ("USD", day(2024, 2, 1), 0.9), ("USD", day(2024, 3, 1), 0.95)],
        "currency string, date date, eur_per_unit double",
    )
    inputs.strategy = resolve_strategy(spark.range(1))
    inputs.as_of = day(2024, 3, 10)
    return analyze(inputs)


def rows(results, name, key="account_label"):
    return {r[key]: r.asDict() for r in results[name].collect()}


def test_metrics_by_hand(results):
    m = {(r["account_label"], str(r["date"])): r for r in results["metrics"].collect()}
    assert m["alpha", "2024-01-02"]["positions_value"] == 100.0 and m["alpha", "2024-01-02"]["cash"] == 899.0
    assert m["alpha", "2024-02-20"]["positions_value"] == 60.0 and m["alpha", "2024-02-20"]["portfolio_value"] == 1006.0
    assert m["alpha", "2024-03-01"]["positions_value"] == 75.0
    assert m["beta", "2024-01-31"]["portfolio_value"] == 500.0
    assert m["beta", "2024-02-01"]["positions_value"] == pytest.approx(90.0)
    last = m["Combined", "2024-03-01"]
    assert last["positions_value"] == pytest.approx(75.0 + 5 * 22.0 * 0.95) and last["total_deposits"] == 1500.0
    assert last["cash"] == 946.0 + 410.0
    # The calendar runs to as_of but is cut at the newest real price.
    assert max(d for _, d in m) == "2024-03-01"


def test_combined_is_the_sum(results):
    per_day = {}
    for r in results["metrics"].collect():
        key = (r["date"], r["account_label"] == "Combined")
        per_day[key] = per_day.get(key, 0.0) + r["portfolio_value"]
    for (d, combined), value in per_day.items():
        if combined:
            assert value == pytest.approx(per_day[d, False])


def test_reconciliation_identities(results):
    rec = rows(results, "totals")
    assert rec["alpha"]["cash_delta_eur"] == 0.0 and rec["alpha"]["diagnosis"] == "match"
    assert rec["beta"]["diagnosis"] == "no_snapshot_cash"
    assert rec["Combined"]["total_value_eur"] == rec["alpha"]["total_value_eur"] + rec["beta"]["total_value_eur"]
    (check,) = results["totals_check"].collect()
    assert check["delta_eur"] == 0.0


def test_summary_identity_and_attribution(results):
    for r in results["table_summary"].where("metric = 'identity delta (should be 0)'").collect():
        assert r["value_eur"] == pytest.approx(0.0, abs=1e-6)
    for r in results["positions_reconciliation"].collect():
        assert r["decomposition_residual_eur"] == pytest.approx(0.0, abs=1e-9)


def test_every_table_runs(results):
    for name, df in results.items():
        assert df.columns, name
        df.limit(3).collect()


def test_fatal_findings_are_refused(spark, tmp_path):
    from tallyfolio.sources.tables import CLASSIFICATION

    (tmp_path / "alpha").mkdir()
    for name, text in FILES["alpha"].items():
        (tmp_path / "alpha" / name).write_text(text)
    schema = "row_seq int, " + ", ".join(f"{c} string" for c in CLASSIFICATION)
    row = {c: "" for c in CLASSIFICATION} | {"instrument_id": "IE00B4L5Y983", "ticker": "WLD", "currency": "EUR"}
    known = lambda **x: spark.createDataFrame([(1, *(row | x).values())], schema)
    load_exports(spark, str(tmp_path), known(asset_class="ETF"))
    with pytest.raises(ValueError, match="classification"):
        load_exports(spark, str(tmp_path), known(asset_class="Boat"))
    with pytest.raises(ValueError, match="no usable row"):
        load_exports(spark, str(tmp_path), known(instrument_id=" "))
    odd = FILES["alpha"]["Account.csv"].replace('"1000,00"', '"ten"').replace('"-101,00"', '"x"').replace('"899,00"', '"y"').replace('"47,00"', '"z"').replace('"946,00"', '"w"')
    (tmp_path / "alpha" / "Account.csv").write_text(odd)
    with pytest.raises(ValueError, match="unparseable_accounts"):
        load_exports(spark, str(tmp_path), known(asset_class="ETF"))
    assert load_exports(spark, str(tmp_path), known(asset_class="ETF"), strict=False).issues["unparseable_accounts"].count() == 1
