"""Solvers, smoothing, correlation and cost basis against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfolio.functions.numbers import parse_decimal, parse_user_float
from tallyfolio.functions.solvers import bisect_rates
from tallyfolio.operators import costbasis, series


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("(1,234.56)", -1234.56), ("9,94", 9.94), ("1,234", 1.234),
        ("1,234,567", None), ("", None), ("-", None), ("nan", None), ("1.0d", None), ("inf", None), ('"5"', 5.0),
        ("\u00a07,5", 7.5), ("1e3", 1000.0),
    ],
)
def test_parse_decimal(spark, text, value):
    row = spark.createDataFrame([(text,)], "t string").select(parse_decimal("t").alias("v")).first()
    assert row["v"] == value


def test_parse_user_float(spark):
    data = [("1 234,50", 1234.5), ("1.234,50", 1234.5), ("1,234.50", 1234.5), ("x", None), ("", None)]
    got = spark.createDataFrame(data, "t string, e double").select(parse_user_float("t").alias("v"), "e").collect()
    assert all(r["v"] == r["e"] for r in got)


def test_rates():
    values = np.array([[-100.0, 0.0, 110.0], [-100.0, -10.0, 90.0], [100.0, 1.0, 1.0]])
    steps = np.tile(np.array([0.0, 0.5, 1.0]), (3, 1))
    rates = bisect_rates(values, steps, np.ones_like(values, dtype=bool), 1e-12)
    assert rates[0] == pytest.approx(0.10) and np.isnan(rates[2])
    r = rates[1]
    assert -100 - 10 / (1 + r) ** 0.5 + 90 / (1 + r) == pytest.approx(0.0, abs=1e-9)


def test_rates_on_long_daily_horizons():
    """The lower bracket overflows beyond a few months of daily steps: no rate, no warning."""

    def one(n):
        values, steps = np.zeros((1, n)), np.arange(n, dtype=float)[None, :]
        values[0, 0], values[0, 10], values[0, -1] = -1000.0, -50.0, 1200.0
        return bisect_rates(values, steps, values != 0, 1e-10)[0]

    assert 0 < one(90) < 0.01
    assert np.isnan(one(6000))


def test_smoothing_keeps_constants_and_gaps():
    x = np.full(100, 3.0)
    x[50] = np.nan
    (out,) = series.smooth_many([x])
    assert np.isnan(out[50]) and np.allclose(out[~np.isnan(out)], 3.0)
    t = np.arange(400)
    noisy = np.sin(t / 60) + 0.3 * np.where(t % 2, 1, -1)
    smooth = series.zero_phase(noisy[None, :])[0]
    assert np.abs(smooth[20:-20] - np.sin(t / 60)[20:-20]).max() < 0.02


def test_pair_kernel_matches_corrcoef():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4, 90))
    a[1, 5] = np.nan
    r = series._pair_kernel(a, a, 60)
    ok = np.isfinite(a[1])
    assert r[0, 2] == pytest.approx(np.corrcoef(a[0], a[2])[0, 1])
    assert r[0, 1] == pytest.approx(np.corrcoef(a[0][ok], a[1][ok])[0, 1])


def _fold(rows, fees):
    q = c = 0.0
    for qty, total, fee in rows:
        if qty > 0:
            q, c = q + qty, c + max(-total + (abs(fee) if fees else 0.0), 0.0)
        elif q <= 1e-12:
            q, c = max(q + qty, 0.0), 0.0
        else:
            cut = min(-qty, q)
            c, q = max(c - c / q * cut, 0.0), q - cut
            if q <= 1e-9:
                q = c = 0.0
    return q, c


@pytest.mark.parametrize("fees", [True, False])
def test_cost_basis_fold(spark, fees):
    rng = np.random.default_rng(11)
    data = []
    for i in range(400):
        qty = float(rng.integers(-6, 8) or 1)
        data.append((f"I{i % 7}", int(rng.integers(0, 40)), i, qty, -qty * float(rng.uniform(5, 9)), float(rng.uniform(0, 1))))
    tx = spark.createDataFrame(data, "instrument_id string, d int, row_seq int, quantity double, total_eur double, fees_eur double")
    tx = tx.withColumn("datetime", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d, 0, 0, 0)"))
    got = {r["instrument_id"]: (r["open_quantity"], r["cost_basis_eur"]) for r in costbasis.open_cost_basis(tx, include_fees=fees).collect()}
    for key in {d[0] for d in data}:
        rows = sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]))
        assert got[key] == pytest.approx(_fold([(d[3], d[4], d[5]) for d in rows], fees), abs=1e-6)


def folded(rows):
    """Quantity and cost after each trade by the sequential rule; rows: (datetime, row_seq, quantity, spend)."""
    q = c = 0.0
    for _, _, x, spend in sorted(rows):
        if x > 0:
            q, c = q + x, c + spend
        else:
            left = max(q + x, 0.0)
            c *= 0.0 if q <= 1e-12 or left <= 1e-9 else left / q
            q = 0.0 if left <= 1e-9 else left
        yield q, c


def test_cost_basis_of_many_trades_in_one_day(spark):
    """10^5 trades of one instrument and day, dealt to several buckets, against the sequential rule."""
    import datetime as dt
    import random

    rng = random.Random(4)
    kinds = {"busy": 100_000, "oversold": 1500, "shrinking": 1500}
    rows = []
    for name, n in kinds.items():
        for i in range(n):
            q = float(rng.choice([rng.randrange(1, 30), -rng.randrange(1, 29)]))
            if name == "oversold":
                q = -abs(q) if rng.random() < 0.6 else rng.random()
            if name == "shrinking":
                q = 1e9 if i == 0 else -(1e9 * 0.9**i) * 0.1 if i < 400 else -1e-7  # products of shares far below 1e-12
            rows.append((name, dt.datetime(2024, 1, 2, 9, 0, i % 3), i, q, -abs(q) * rng.random() * 50))
    tx = spark.createDataFrame(rows, "instrument_id string, datetime timestamp_ntz, row_seq long, quantity double, total_eur double")
    tx = tx.withColumn("fees_eur", F.lit(None).cast("double")).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {name: sorted((r.datetime, r.row_seq, r.open_quantity, r.cost_basis_eur) for r in part) for name, part in grouped(costbasis.trade_cost_basis(tx).collect()).items()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for name in kinds:
        want = list(folded([(t, i, q, max(-total, 0.0)) for k, t, i, q, total in rows if k == name]))
        assert len(want) == len(got[name])
        for (_, _, q, c), (wq, wc) in zip(got[name], want, strict=True):
            assert abs(q - wq) <= 1e-6 * max(1, wq) and abs(c - wc) <= 1e-6 * max(1, wc)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.instrument_id, []).append(r)
    return out


def test_composition_of_maps_over_sections(spark):
    """Products that fall by far more than a double holds, resets, and empty shares."""
    import random

    rng = random.Random(9)
    rows = [(i, rng.choice([1.0, 1.0, 1e-60, 0.5, 0.0 if rng.random() < 0.1 else 0.9]), rng.choice([0.0, rng.random() * 100])) for i in range(3000)]
    rows = [(i, a, b if a in (0.0, 1.0) else 0.0) for i, a, b in rows]
    frame = spark.createDataFrame([(1, *r) for r in rows], "k int, i int, a double, b double")
    a, b = 1.0, 0.0
    for r, (_, x, y) in zip(costbasis.composed(frame, ["k"], ["i"]).orderBy("i").collect(), rows, strict=True):
        a, b = a * x, b * x + y
        assert r.pre_b == pytest.approx(b, rel=1e-9, abs=1e-150) and r.pre_a == pytest.approx(a, rel=1e-9, abs=1e-150)


def test_held_correlations_against_filled_series(spark):
    """Sparse returns, zero prices, late first prices, several blocks of a portfolio, a limit per portfolio."""
    import datetime as dt
    import random

    rng, start = random.Random(5), dt.date(2023, 1, 1)
    end, days, ids = start + dt.timedelta(days=200), 201, [f"I{i}" for i in range(14)]
    path = [100 + 10 * np.sin(d / 9) for d in range(days)]
    events = []
    for k, i in enumerate(ids):
        for d in sorted(rng.sample(range(days), 120 if k < 10 else 15)) if k else range(days):
            value = path[d] * (1 + rng.gauss(0, 0.002 * k)) if k % 2 == 0 else 50 + rng.random()
            events.append((i, start + dt.timedelta(days=d), 0.0 if k in (4, 9) and rng.random() < 0.03 else value))
    held = [("A", i) for i in ids] + [("B", i) for i in ids[:6]] + [("C", i) for i in ids] + [("A", " I1 "), ("A", "")]
    limits = {"A": 0.2, "B": 0.5, "C": None}
    filled = {}
    for i in ids:
        mine = {d: v for x, d, v in events if x == i}
        v = np.array([mine.get(start + dt.timedelta(days=d), np.nan) for d in range(days)])
        last = np.maximum.accumulate(np.where(np.isnan(v), -1, np.arange(days)))
        v = np.where(last >= 0, v[np.maximum(last, 0)], v[np.flatnonzero(~np.isnan(v))[0]])
        with np.errstate(all="ignore"):
            r = v[1:] / v[:-1] - 1
        filled[i] = np.where(np.isfinite(r), r, np.nan)
    want = {}
    for account in "AB":
        mine = sorted({i.strip() for a, i in held if a == account and i.strip()})
        for n, a in enumerate(mine):
            for b in mine[n + 1 :]:
                ok = np.isfinite(filled[a]) & np.isfinite(filled[b])
                x, y = filled[a][ok], filled[b][ok]
                if ok.sum() >= 60 and x.std() > 0 and y.std() > 0 and (c := np.corrcoef(x, y)[0, 1]) >= limits[account]:
                    want[account, min(a, b), max(a, b)] = c
    e = spark.createDataFrame(events, "instrument_id string, date date, price_eur double")
    h = spark.createDataFrame(held, "account_label string, instrument_id string")
    s = spark.createDataFrame(list(limits.items()), "account_label string, max_pair_correlation double")
    for block in (512, 4):
        got = {(r.account_label, r.instrument_id_a, r.instrument_id_b): r.correlation for r in series.held_correlations(e, h, s, start, end, block=block).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 10
