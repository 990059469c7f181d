"""Export parsing, repair, column inference and normalization on small CSV folders."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfolio.operators import fx_repair, normalize
from tallyfolio.operators.quality import file_set_check
from tallyfolio.sources import exports
from tallyfolio.sources.strategy import clean_target_map

LEDGER = "Date,Time,Value date,Product,ISIN,Description,FX,Change,,Balance,,Order Id\n"


def rows(spark, tmp_path, name, text, folder="Main", encoding="utf-8"):
    target = tmp_path / folder
    target.mkdir(exist_ok=True)
    (target / name).write_bytes(text.encode(encoding))
    return exports.repair_rows(exports.read_rows(spark, f"{tmp_path}/*/{name}"))


def account(spark, tmp_path, text, **kw):
    located = exports.located_rows(rows(spark, tmp_path, "Account.csv", text, **kw))
    return [r.asDict() for r in normalize.normalize_account(located).orderBy("row_seq").collect()]


def transactions(spark, tmp_path, text, **kw):
    located = exports.located_rows(rows(spark, tmp_path, "Transactions.csv", text, **kw))
    return [r.asDict() for r in normalize.normalize_transactions(located).orderBy("row_seq").collect()]


def test_transactions_english_comma(spark, tmp_path):
    text = (
        "Date,Time,Product,ISIN,Quantity,Price,,Value EUR,Total EUR,Transaction and/or third party fees EUR,AutoFX Fee\n"
        '05-03-2025,09:04,Fund A,IE00B4L5Y983,4,"25,50",USD,"-102,00","-103,10","-1,00","-0,10"\n'
        '06-03-2025,10:00,Fund A,IE00B4L5Y983,3,"25,00",USD,"75,00","74,00","-1,00",\n'
    )
    buy, sell = transactions(spark, tmp_path, text)
    assert buy["datetime"] == dt.datetime(2025, 3, 5, 9, 4)
    assert (buy["quantity"], buy["price"], buy["total_eur"], buy["currency"]) == (4.0, 25.5, -103.1, "USD")
    assert buy["fees_eur"] == pytest.approx(-1.1) and buy["description"] == "Fund A" and buy["type"] == "Fund A"
    assert buy["instrument_id"] == "IE00B4L5Y983" and sell["quantity"] == -3.0


def test_transactions_dutch_semicolon_latin1(spark, tmp_path):
    text = (
        "Datum;Tijd;Product;ISIN;Aantal;Koers;Waarde EUR;Totaal EUR\n"
        "01-02-2024;12:30;Société Générale;;7;1.234,56;-8.641,92;-8.641,92\n"
    )
    (row,) = transactions(spark, tmp_path, text, encoding="latin-1")
    assert row["product"] == "Société Générale" == row["instrument_id"] and row["isin"] is None
    assert row["price"] == 1234.56 and row["quantity"] == 7.0 and row["currency"] == ""


@pytest.mark.parametrize("swap", [False, True])
def test_account_amount_and_currency_either_way(spark, tmp_path, swap):
    a, b = ('"12,50",EUR', '"112,50",EUR') if not swap else ('EUR,"12,50"', 'EUR,"112,50"')
    text = "Date,Time,Description,FX,Change,,Balance,\n" + f"01-02-2024,10:00,Dividend,,{a},{b}\n"
    (row,) = account(spark, tmp_path, text)
    assert (row["raw_change"], row["raw_balance"], row["currency"]) == (12.5, 112.5, "EUR")
    assert row["type"] == "dividend" and row["change_eur"] == 12.5 and row["is_income"]


def test_continuation_rows(spark, tmp_path):
    text = (
        LEDGER
        + '01-02-2024,10:00,01-02-2024,Long,IE00B4L5Y983,Koop 10 @,,"-100,00",EUR,"0,00",EUR,abc-1\n'
        + ",,,name fund,,,,,,,,\n"
        + ",,,,,more words,,,,,,\n"
        + ',,,,,"9,94 USD",,,,,,\n'
        + ",,,,,,,,,,,23-def\n"
        + ",,,,,,,,,,,\n"
        + '02-02-2024,10:00,02-02-2024,,,Dividend,,"5,00",EUR,"5,00",EUR,\n'
    )
    fixed = rows(spark, tmp_path, "Account.csv", text).orderBy("row_seq").collect()
    assert len(fixed) == 3
    first = fixed[1]["cells"]
    assert first[3] == "Long name fund" and first[5] == "Koop 10 @ more words" and first[11] == "abc-123-def"


def test_first_data_row_is_never_a_continuation(spark, tmp_path):
    text = "Date,Time,Product,ISIN\n,,Alone,\n01-02-2024,10:00,Fund,\n,,tail,\n"
    fixed = rows(spark, tmp_path, "Transactions.csv", text).orderBy("row_seq").collect()
    assert [r["cells"][2] for r in fixed] == ["Product", "Alone", "Fund tail"]


def test_lone_cell_elsewhere_stays_a_row(spark, tmp_path):
    text = "Date,Time,Product,ISIN\n01-02-2024,10:00,Fund,\n,,,IE00B4L5Y983\n,,tail,\n"
    fixed = rows(spark, tmp_path, "Transactions.csv", text).orderBy("row_seq").collect()
    assert [r["cells"][2] for r in fixed] == ["Product", "Fund", "tail"]


def test_repair_across_row_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "_BLOCK_ROWS", 3)
    text = "Date,Time,Product,ISIN\n01-02-2024,10:00,Fund,\n" + "".join(f",,p{i},\n" for i in range(10))
    fixed = rows(spark, tmp_path, "Transactions.csv", text).orderBy("row_seq").collect()
    assert len(fixed) == 2 and fixed[1]["cells"][2] == "Fund " + " ".join(f"p{i}" for i in range(10))


def test_overflow_and_short_rows(spark, tmp_path):
    text = "Date,Time,Product,ISIN\n01-02-2024,10:00,Fund,A,B,C\n02-02-2024,11:00\n"
    fixed = rows(spark, tmp_path, "Transactions.csv", text).orderBy("row_seq").collect()
    assert fixed[1]["cells"][3] == "A,B,C" and fixed[2]["cells"] == ["02-02-2024", "11:00", "", ""]


def test_damaged_export_equals_clean_one(spark, tmp_path):
    clean = LEDGER + "".join(
        f'0{d}-02-2024,10:00,0{d}-02-2024,Fund of many words,IE00B4L5Y983,Koop {d} stuks nu,,"-{d},00",EUR,"{d},00",EUR,ord-{d}-x\n'
        for d in range(1, 7)
    )
    damaged = LEDGER + "".join(
        f'0{d}-02-2024,10:00,0{d}-02-2024,Fund of,IE00B4L5Y983,Koop {d},,"-{d},00",EUR,"{d},00",EUR,ord-{d}\n'
        ",,,many words,,,,,,,,\n,,,,,stuks nu,,,,,,\n,,,,,,,,,,,-x\n"
        for d in range(1, 7)
    )
    drop = lambda out: [{k: v for k, v in r.items() if k not in ("account_label", "row_seq")} for r in out]
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    assert drop(account(spark, one, clean)) == drop(account(spark, two, damaged))


def test_fx_ten_times_too_large(spark, tmp_path):
    text = (
        LEDGER
        + '01-02-2024,10:00,01-02-2024,,,Valuta Debitering,"11,000","-110,00",USD,"0,00",USD,\n'
        + '01-02-2024,10:00,01-02-2024,,,Valuta Creditering,,"100,00",EUR,"100,00",EUR,\n'
        + '03-02-2024,10:00,03-02-2024,,,Valuta Debitering,"11,200","-56,00",USD,"0,00",USD,ord-9\n'
        + '03-02-2024,10:00,03-02-2024,,,Valuta Creditering,,"50,00",EUR,"150,00",EUR,ord-9\n'
    )
    out = account(spark, tmp_path, text)
    assert out[0]["fx_rate"] == pytest.approx(1.1) and out[0]["change_eur"] == pytest.approx(-100.0)
    assert out[2]["fx_rate"] == pytest.approx(1.12)


def test_order_rate_spreads_and_is_inferred(spark, tmp_path):
    text = (
        LEDGER
        + '01-02-2024,10:00,01-02-2024,F,X,Koop 2 @ 50,,"-100,00",USD,"0,00",USD,o-1\n'
        + '01-02-2024,10:00,01-02-2024,F,X,Valuta Debitering,"1,2500","100,00",USD,"0,00",USD,o-1\n'
        + '01-02-2024,10:00,01-02-2024,F,X,Valuta Creditering,,"-80,00",EUR,"0,00",EUR,o-1\n'
        + '02-02-2024,10:00,02-02-2024,F,X,Koop 1 @ 60,,"-60,00",USD,"0,00",USD,o-2\n'
        + '02-02-2024,10:00,02-02-2024,F,X,Valuta Creditering,,"-50,00",EUR,"0,00",EUR,o-2\n'
    )
    out = account(spark, tmp_path, text)
    assert out[0]["fx_rate"] == pytest.approx(1.25)
    assert out[3]["fx_rate"] == pytest.approx(1.2)


def test_exchange_without_order_fills_dividend_and_tax(spark, tmp_path):
    text = (
        LEDGER
        + '05-02-2024,08:00,02-02-2024,,,Dividend,,"20,00",USD,"20,00",USD,\n'
        + '05-02-2024,08:01,02-02-2024,,,Dividendbelasting,,"-3,00",USD,"17,00",USD,\n'
        + '06-02-2024,09:00,02-02-2024,,,Valuta Debitering,"1,0625","-17,00",USD,"0,00",USD,\n'
        + '06-02-2024,09:00,02-02-2024,,,Valuta Creditering,,"16,00",EUR,"16,00",EUR,\n'
    )
    out = account(spark, tmp_path, text)
    assert [r["fx_rate"] for r in out[:3]] == [pytest.approx(1.0625)] * 3


def test_ambiguous_exchange_fills_nothing(spark, tmp_path):
    text = (
        LEDGER
        + '05-02-2024,08:00,05-02-2024,,,Dividend,,"17,00",USD,"20,00",USD,\n'
        + '05-02-2024,08:01,05-02-2024,,,Dividend,,"17,00",USD,"17,00",USD,\n'
        + '06-02-2024,09:00,05-02-2024,,,Valuta Debitering,"1,0625","-17,00",USD,"0,00",USD,\n'
        + '06-02-2024,09:00,05-02-2024,,,Valuta Creditering,,"16,00",EUR,"16,00",EUR,\n'
    )
    out = account(spark, tmp_path, text)
    assert out[0]["fx_rate"] is None and out[1]["fx_rate"] is None


def test_unique_subset_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        values = np.round(rng.uniform(-30, 30, n), 2)
        ids = np.arange(n)
        pick = rng.random(n) < 0.5
        target = abs(values[pick].sum()) if pick.any() else 5.0
        hits = []
        for m in range(1, 1 << n):
            chosen = [i for i in range(n) if m >> i & 1]
            if abs(abs(values[chosen].sum()) - target) <= 0.03:
                hits.append(chosen)
        got = fx_repair.unique_subset(values, ids, target)
        if target > 0 and len(hits) == 1:
            assert sorted(got) == hits[0]
        else:
            assert got is None


def test_portfolio_snapshot(spark, tmp_path):
    text = (
        "Product,Symbol/ISIN,Amount,Closing,,Value in EUR\n"
        'CASH & CASH FUND (EUR),,,,EUR,"50,00"\n'
        'Fund A,IE00B4L5Y983,10,"20,00",EUR,"200,00"\n'
        'Fund B,ABC,5,"3,00",USD,\n'
        "Fund C,IE00B0M63284,5,,EUR,\n"
    )
    located = exports.located_rows(rows(spark, tmp_path, "Portfolio.csv", text))
    pf = normalize.normalize_portfolio(located)
    out = {r["product"]: r for r in pf.collect()}
    assert out["CASH & CASH FUND (EUR)"]["is_cash_like"] and not out["Fund A"]["is_cash_like"]
    assert out["Fund B"]["symbol"] == "ABC" and out["Fund B"]["isin"] is None and out["Fund B"]["value_eur"] == 15.0
    assert [r["product"] for r in normalize.snapshot_violations(pf).collect()] == ["Fund C"]


def test_unparseable_amounts_and_missing_columns(spark, tmp_path):
    text = "Date,Time,Description,Change,Balance\n01-02-2024,10:00,x,n.v.t.,n.v.t.\n"
    fixed = rows(spark, tmp_path, "Account.csv", text)
    raw = normalize.raw_account(exports.located_rows(fixed))
    (bad,) = normalize.unparseable_accounts(raw).collect()
    assert bad["change_unparseable"] and bad["balance_unparseable"]
    broken = rows(spark, tmp_path, "Transactions.csv", "Foo,Time\n1,2\n")
    (miss,) = exports.missing_columns(exports.resolve_columns(broken)).collect()
    assert miss["missing_columns"] == "date, product"


def test_file_set(spark, tmp_path):
    for folder, names in {"ok": exports.REQUIRED_FILES, "bad": ["Account.csv", "Extra.csv"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("a,b\n")
    (row,) = file_set_check(exports.list_files(spark, f"{tmp_path}/*/*.csv"), exports.REQUIRED_FILES).collect()
    assert row["folder"].endswith("/bad") and row["missing"] == "Portfolio.csv, Transactions.csv"
    assert row["unexpected"] == "Extra.csv"


def matches(spark, rows):
    """rows: (row_seq, second, description, currency, raw_change, fx_rate)"""
    full = [("A", n, dt.datetime(2024, 3, 5, 12, 0, s), dt.date(2024, 3, 5), None, d, c, a, r) for n, s, d, c, a, r in rows]
    ledger = spark.createDataFrame(full, "account_label string, row_seq long, datetime timestamp_ntz, value_date date, order_id string, description string, currency string, raw_change double, fx_rate double")
    return {r["row_seq"]: r["matched_rate"] for r in fx_repair.exchange_matches(ledger).collect()}


DEBIT = (900, 1, "Valuta Debitering", "USD", -17.0, 1.25)
CREDIT = (901, 1, "Valuta Creditering", "EUR", 13.6, None)


def test_session_with_one_kind_only(spark):
    assert matches(spark, [(1, 0, "Dividend", "USD", 17.0, None)]) == {}
    assert matches(spark, [DEBIT, CREDIT]) == {}
    assert matches(spark, []) == {}


def test_all_candidates_take_part(spark):
    larger = [(i, i % 60, "Dividend", "USD", 1000.0 * 3**i, None) for i in range(25)]
    assert matches(spark, [*larger, (99, 3, "Dividend", "USD", 17.0, None), DEBIT, CREDIT]) == {99: 1.25}
    many = [(i, i % 60, "Dividend", "USD", 40.0 + i, None) for i in range(400)]
    assert matches(spark, [*many, (500, 3, "Dividend", "USD", 20.0, None), (501, 4, "Dividendbelasting", "USD", -3.0, None), DEBIT, CREDIT]) == {500: 1.25, 501: 1.25}
    alone = [(i, i % 60, "Dividend", "USD", 40.0 + i, None) for i in range(400)]
    assert matches(spark, [*alone, (500, 3, "Dividend", "USD", 17.0, None), DEBIT, CREDIT]) == {500: 1.25}


def test_target_keys_that_become_equal(spark):
    raw = spark.sql("SELECT map('EUR', '50', ' EUR ', '60', 'usd', '10', 'USD', '20', '', '5') AS m")
    assert raw.select(clean_target_map(F.col("m")).alias("m")).first()["m"] == {"EUR": 60.0, "usd": 10.0, "USD": 20.0}


def test_unique_subset_of_thousands():
    """Bounded work with 5000 candidates: either a single hit or an early end with two."""
    rng = np.random.default_rng(8)
    large = np.round(rng.uniform(2000, 9000, 5000), 2)
    assert list(fx_repair.unique_subset(np.append(large, [17.0, 3.0]), np.arange(5002), 20.0)) in ([5000, 5001], [5001, 5000])
    assert fx_repair.unique_subset(np.append(large, [17.0, 3.0, 20.0]), np.arange(5003), 20.0) is None
    assert fx_repair.unique_subset(np.round(rng.uniform(-50, 50, 5000), 2), np.arange(5000), 4000.0) is None


def walked(debits, candidates):
    """Exchanges one after the other; debits: (row_seq, time, day, target, rate), candidates: row_seq -> (time, day, amount)."""
    from itertools import combinations

    free, out = dict(candidates), {}

    def only(rows, target):
        hits = [c for n in range(1, len(rows) + 1) for c in combinations(rows, n) if abs(abs(sum(free[i][2] for i in c)) - target) <= 0.03]
        return hits[0] if len(hits) == 1 else None

    for _, time, day, target, rate in sorted(debits, key=lambda d: (d[1], d[0])):
        hit = only([i for i, (_, d, _) in free.items() if d == day], target)
        hit = hit or only([i for i, (t, _, _) in free.items() if abs(t - time) <= dt.timedelta(days=3)], target)
        for i in hit or ():
            out[i] = rate
            del free[i]
    return out


def test_rival_exchanges_against_the_walk(spark):
    """Many exchanges want the same rows; rounds give what walking in time order gives."""
    import random

    rng = random.Random(6)
    for parts in (1, 5):
        ledger, want, seq = [], {}, 0
        for account_label in "ABCDEFGH":
            debits, candidates = [], {}
            for _ in range(10):
                t = dt.datetime(2024, 3, rng.randrange(1, 12), 10, rng.randrange(60))
                seq += 1
                amount = float(rng.choice([10, 10, 20, 25, 30]))
                candidates[seq] = (t, t.date(), amount)
                ledger.append((account_label, seq, t, t.date(), None, "Dividend", "USD", amount, None))
            for k in range(7):
                t = dt.datetime(2024, 3, rng.randrange(1, 14), 11, k)
                day = (t - dt.timedelta(days=rng.randrange(3))).date()
                seq += 2
                target, rate = float(rng.choice([10, 10, 20, 40, 35])), 1.25 + k / 100
                debits.append((seq, t, day, target, rate))
                ledger.append((account_label, seq, t, day, None, "Valuta Debitering", "USD", -target, rate))
                ledger.append((account_label, seq + 1, t, day, None, "Valuta Creditering", "EUR", target / rate, None))
            want.update(walked(debits, candidates))
        frame = spark.createDataFrame(ledger, "account_label string, row_seq long, datetime timestamp_ntz, value_date date, order_id string, description string, currency string, raw_change double, fx_rate double")
        got = {r["row_seq"]: r["matched_rate"] for r in fx_repair.exchange_matches(frame.repartition(parts)).collect()}
        assert got == want and len(want) > 15
