"""Missing and mis-scaled FX rates of ledger rows.

Order: detect rates exported ten times too large, spread the rate of an order to
its rows, then match currency exchanges without an order id to the rows they paid.
Rows are identified by (account_label, row_seq).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.session import materialize, tasks_for

# --- fixed values: texts and tolerances -----------------------------------------
DEBIT, CREDIT = "valuta debitering", "valuta creditering"
TRADE_WORDS = r"\b(?:koop|verkoop|buy|sell)\b"
EUR_TOLERANCE, FOREIGN_TOLERANCE = 0.05, 0.03
LOOKAROUND_DAYS = 3
# ------------------------------------------------------------------------------
KEY = ["account_label", "row_seq"]
#: Amounts are summed in hundredths of a cent.
UNIT = 10_000


def _prepared(rows: DataFrame) -> DataFrame:
    text = F.trim(F.lower(F.coalesce("description", F.lit(""))))
    return (
        rows.withColumn("_d", text)
        .withColumn("_leg", text.isin(DEBIT, CREDIT))
        .withColumn("_eur", F.coalesce(F.col("currency") == "EUR", F.lit(False)))
        .withColumn("_amt", F.when(F.col("raw_change") != 0, F.abs("raw_change")))
        .withColumn("_oid", F.trim(F.coalesce("order_id", F.lit(""))))
    )


def scale_ratios(rows: DataFrame) -> DataFrame:
    """rate / (foreign amount / EUR amount) of every exchange with both legs.

    Legs of an order pair up by order id, the others by timestamp; each side takes
    the first leg in file order, so no pair product is formed.
    """
    legs = _prepared(rows).where(F.col("_leg") & F.col("_amt").isNotNull())
    foreign = ~F.col("_eur") & (F.col("fx_rate") > 0)
    ordered = (
        legs.where(F.col("_oid") != "")
        .groupBy("account_label", "_oid")
        .agg(
            F.min_by("_amt", F.when(F.col("_eur"), F.col("row_seq"))).alias("eur"),
            F.min_by(F.struct("_amt", "fx_rate"), F.when(foreign, F.col("row_seq"))).alias("f"),
        )
        .select("account_label", "eur", "f._amt", "f.fx_rate")
    )
    loose = legs.where((F.col("_oid") == "") & F.col("datetime").isNotNull())
    eur_at = loose.where("_eur").groupBy("account_label", "datetime").agg(F.min_by("_amt", "row_seq").alias("eur"))
    by_time = loose.where(foreign).join(eur_at, ["account_label", "datetime"]).select("account_label", "eur", "_amt", "fx_rate")
    return ordered.unionByName(by_time).select(
        "account_label", (F.col("fx_rate") / (F.col("_amt") / F.col("eur"))).alias("ratio")
    ).where(F.col("ratio") > 0)


def scale_flags(rows: DataFrame) -> DataFrame:
    """Portfolios whose rates are ten times too large."""
    ten = F.avg(F.col("ratio").between(8.0, 12.0).cast("double"))
    one = F.avg(F.col("ratio").between(0.8, 1.2).cast("double"))
    return (
        scale_ratios(rows)
        .groupBy("account_label")
        .agg(ten.alias("near_ten"), one.alias("near_one"))
        .select("account_label", ((F.col("near_ten") >= 0.6) & (F.col("near_ten") > F.col("near_one"))).alias("tenfold"))
    )


def rescale_rates(rows: DataFrame) -> DataFrame:
    tenfold = F.coalesce("tenfold", F.lit(False)) & (F.col("fx_rate") > 5.0)
    return (
        rows.join(scale_flags(rows), "account_label", "left")
        .withColumn("fx_rate", F.when(tenfold, F.col("fx_rate") / 10.0).otherwise(F.col("fx_rate")))
        .drop("tenfold")
    )


def order_rates(rows: DataFrame) -> DataFrame:
    """Rate per order: its first positive rate, else foreign / EUR leg, else trade / EUR leg."""
    p = _prepared(rows).where((F.col("_oid") != ""))
    exchange = F.col("_d").contains(DEBIT) | F.col("_d").contains(CREDIT)
    amount = F.col("_amt").isNotNull()

    def first(value, condition):
        return F.min_by(value, F.when(condition, F.col("row_seq")))

    return (
        p.groupBy("account_label", "_oid")
        .agg(
            first("fx_rate", F.col("fx_rate") > 0).alias("given"),
            first("_amt", exchange & F.col("_eur") & amount).alias("eur"),
            first("_amt", exchange & ~F.col("_eur") & amount).alias("foreign"),
            first("_amt", F.col("_d").rlike(TRADE_WORDS) & ~F.col("_eur") & amount).alias("trade"),
        )
        .select(
            "account_label",
            F.col("_oid").alias("order_id"),
            F.coalesce("given", F.col("foreign") / F.col("eur"), F.col("trade") / F.col("eur")).alias("order_rate"),
        )
    )


def fill_order_rates(rows: DataFrame) -> DataFrame:
    foreign = ~F.coalesce(F.col("currency") == "EUR", F.lit(False))
    return (
        rows.withColumn("order_id", F.nullif(F.trim("order_id"), F.lit("")))
        .join(order_rates(rows), ["account_label", "order_id"], "left")
        .withColumn("fx_rate", F.coalesce("fx_rate", F.when(foreign, F.col("order_rate"))))
        .drop("order_rate")
    )


def _sums(units: list[int], reach=None, stop=None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all subsets and the number of ways to get each (two or more count as two).

    `reach(i, sums)` says which sums may still matter behind the i-th value; `stop(sums, ways)` ends the search."""
    sums, ways = np.zeros(1, np.int64), np.ones(1, np.int64)
    for i, v in enumerate(units):
        both, at = np.unique(np.concatenate((sums, sums + v)), return_inverse=True)
        count = np.minimum(np.bincount(at, np.concatenate((ways, ways)), len(both)), 2).astype(np.int64)
        if reach is not None:
            alive = reach(i, both)
            both, count = both[alive], count[alive]
        sums, ways = both, count
        if stop is not None and stop(sums, ways):
            break
    return sums, ways


def _within(units, spans):
    """Which sums can still end in one of the spans, by what the values left may add or take."""
    units = np.asarray(units, np.int64)
    up = np.append(np.cumsum(np.maximum(units, 0)[::-1])[::-1], 0)
    down = np.append(np.cumsum(np.minimum(units, 0)[::-1])[::-1], 0)

    def reach(i, sums):
        alive = np.zeros(len(sums), bool)
        for low, high in spans:
            alive |= (sums + up[i + 1] >= low) & (sums + down[i + 1] <= high)
        return alive

    return reach


def _members(units: list[int], first: int, total: int) -> list[int]:
    """Places (counted from `first`) of the only subset with sum `total`, halving the values: no more than one list of sums
    is held at a time."""
    if total == 0:
        return []
    if len(units) == 1:
        return [first]
    half = len(units) // 2
    one, two = units[:half], units[half:]
    bounds = [(sum(min(v, 0) for v in part), sum(max(v, 0) for v in part)) for part in (one, two)]
    left = _sums(one, _within(one, [(total - bounds[1][1], total - bounds[1][0])]))[0]
    right = _sums(two, _within(two, [(total - bounds[0][1], total - bounds[0][0])]))[0]
    wanted = total - left
    at = np.searchsorted(right, wanted)
    met = np.flatnonzero(right[np.minimum(at, len(right) - 1)] == wanted)
    part = int(left[met[0]])
    return _members(one, first, part) + _members(two, first + half, total - part)


def unique_subset(values: np.ndarray, ids: np.ndarray, target: float, tolerance: float = FOREIGN_TOLERANCE):
    """Ids of the only subset whose absolute sum hits the target, else None.

    All candidates take part.  Sums are whole hundredths of a cent; after each candidate equal sums are one row with the
    number of ways to get there, and sums from which no hit can be reached are left out.  Only one list of sums is held, and
    the search ends with the second hit: with many candidates hits are dense, so the list stays short.
    """
    if not np.isfinite(target) or target <= 0:
        return None
    values, ids = values[np.isfinite(values)], ids[np.isfinite(values)]
    order = np.argsort(-np.abs(values), kind="stable")
    units = np.rint(values[order] * UNIT).astype(np.int64)
    near, far = math.ceil((target - tolerance) * UNIT - 1e-6), math.floor((target + tolerance) * UNIT + 1e-6)

    def hits(sums, ways):
        hit = np.abs(np.abs(sums / UNIT) - target) <= tolerance
        return sums[hit], ways[hit].sum() - int((sums[hit] == 0).any())  # one way to zero is the empty subset, which is none

    sums, ways = _sums(units.tolist(), _within(units, [(near, far), (-far, -near)]), lambda s, w: hits(s, w)[1] > 1)
    found, n = hits(sums, ways)
    found = found[found != 0]
    if n != 1 or len(found) != 1:
        return None
    return ids[order[_members(units.tolist(), 0, int(found[0]))]]


_PAIR = ["account_label", "debit_seq", "row_seq"]


def stretch(date) -> Column:
    """Number of the stretch of days that a date lies in."""
    return F.floor(F.unix_date(date) / (2 * LOOKAROUND_DAYS + 2))


def stretches(date) -> Column:
    """The one or two stretches with the days around a date."""
    return F.sequence(stretch(F.date_sub(date, LOOKAROUND_DAYS)), stretch(F.date_add(date, LOOKAROUND_DAYS)))


def exchange_pairs(rows: DataFrame) -> DataFrame:
    """(account_label, debit_seq, at, target, rate, row_seq, amount, same_day, near) for every exchange and each row it may have paid.

    Only foreign rows without a rate and exchanges whose EUR leg exists take part.  Rows meet by account, currency and day, or
    a stretch of days, of which the time around an exchange lies in two at most.
    """
    p = _prepared(rows).where((F.col("_oid") == "") & F.col("_amt").isNotNull())
    debits = p.where((F.col("_d") == DEBIT) & ~F.col("_eur") & (F.col("fx_rate") > 0)).withColumn("_eur_target", F.col("_amt") / F.col("fx_rate"))
    credits = p.where((F.col("_d") == CREDIT) & F.col("_eur"))

    def paid(part, on):
        c = credits.select(F.col("account_label").alias("_a"), F.col(on).alias("_on"), F.col("_amt").alias("_credit"))
        met = (F.col("account_label") == F.col("_a")) & (F.col(on) == F.col("_on")) & (F.abs(F.col("_credit") - F.col("_eur_target")) <= EUR_TOLERANCE)
        return part.join(c, met, "left_semi")

    has_time = F.col("datetime").isNotNull()
    at = F.struct((~has_time).alias("untimed"), F.col("datetime"), F.col("row_seq"))
    good = paid(debits.where(has_time), "datetime").unionByName(paid(debits.where(~has_time & F.col("value_date").isNotNull()), "value_date"))
    good = good.select("account_label", "currency", F.col("row_seq").alias("debit_seq"), at.alias("at"), F.col("_amt").alias("target"), F.col("fx_rate").alias("rate"), F.col("datetime").alias("_when"), F.col("value_date").alias("_day"))
    candidates = p.where(F.col("fx_rate").isNull() & ~F.col("_eur") & ~F.col("_leg"))
    candidates = candidates.select("account_label", "currency", "row_seq", F.col("raw_change").alias("amount"), F.col("datetime").alias("_time"), F.col("value_date").alias("_value"))
    by_day = good.where("_day IS NOT NULL").withColumn("_on", F.col("_day")).join(candidates.withColumn("_on", F.col("_value")), ["account_label", "currency", "_on"])
    reach = F.expr(f"_time BETWEEN _when - INTERVAL {LOOKAROUND_DAYS} DAYS AND _when + INTERVAL {LOOKAROUND_DAYS} DAYS")
    by_time = good.where("_when IS NOT NULL").withColumn("_on", F.explode(stretches(F.to_date("_when")))).join(candidates.withColumn("_on", stretch(F.to_date("_time"))), ["account_label", "currency", "_on"]).where(reach)
    cols = ["account_label", "debit_seq", "at", "target", "rate", "row_seq", "amount"]
    both = by_day.select(*cols, F.lit(True).alias("same_day"), F.lit(False).alias("near")).unionByName(by_time.select(*cols, F.lit(False).alias("same_day"), F.lit(True).alias("near")))
    # hardly any row meets an exchange in both ways, so adding up before the shuffle would fill memory for nothing
    both = both.repartition(tasks_for(rows.sparkSession, rows.count()), "account_label", "debit_seq")
    return both.groupBy(*_PAIR).agg(
        *[F.first(c).alias(c) for c in ("at", "target", "rate", "amount")], F.bool_or("same_day").alias("same_day"), F.bool_or("near").alias("near")
    )


def _searched(pairs: DataFrame) -> DataFrame:
    """Matches of exchanges with several rows in reach, streamed exchange by exchange."""

    def one(part: pd.DataFrame):
        part = part.sort_values("row_seq", ascending=False)  # among equal amounts the later row first
        for kind in ("same_day", "near"):
            rows = part[part[kind].to_numpy(dtype=bool)]
            hit = unique_subset(rows["amount"].to_numpy(dtype=float), np.arange(len(rows)), float(part["target"].iloc[0])) if len(rows) else None
            if hit is not None:
                return rows.iloc[hit]
        return part.iloc[:0]

    def run(batches):
        held = None
        for frame in batches:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            key = frame[["account_label", "debit_seq"]]
            edge = np.flatnonzero(np.append(True, (key.to_numpy()[1:] != key.to_numpy()[:-1]).any(axis=1)))
            found = [one(frame.iloc[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            held = frame.iloc[edge[-1] :] if len(frame) else None
            if found:
                yield pd.concat(found)[cols]
        if held is not None:
            yield one(held)[cols]

    cols = [*_PAIR, "rate"]
    dealt = pairs.select(*_PAIR, "rate", "target", "amount", "same_day", "near").repartition("account_label", "debit_seq").sortWithinPartitions(*_PAIR)
    return dealt.mapInPandas(run, "account_label string, debit_seq bigint, row_seq bigint, rate double")


def _proposed(pairs: DataFrame) -> DataFrame:
    """(account_label, debit_seq, at, row_seq, rate): rows that each exchange matches if all of `pairs` are free.

    An exchange with one row in reach is settled by comparing two numbers; others need the search for a subset.
    """
    units = F.rint(F.col("amount") * UNIT)
    fits = (units != 0) & (F.abs(F.abs(units / UNIT) - F.col("target")) <= FOREIGN_TOLERANCE)
    each = Window.partitionBy("account_label", "debit_seq")
    day, near = F.col("same_day"), F.col("near")
    counted = pairs.withColumn("fits", fits & ~F.isnan("amount")).withColumn("n_day", F.count_if(day).over(each)).withColumn("n_near", F.count_if(near).over(each))
    counted = counted.withColumn("day_hit", F.bool_or(day & F.col("fits")).over(each))
    by_day = (F.col("n_day") == 1) & F.col("day_hit")
    easy = by_day | ((F.col("n_day") <= 1) & (F.col("n_near") <= 1))
    simple = counted.where(easy & F.col("fits") & F.when(by_day, day).otherwise(near)).select(*_PAIR, "rate")
    found = simple.unionByName(_searched(counted.where(~easy)))
    return found.join(pairs.select(*_PAIR, "at"), _PAIR)


def exchange_matches(rows: DataFrame) -> DataFrame:
    """Rates for rows paid by an exchange without an order id: exchanges in time order, a matched row is used once.

    The order is kept without walking through it.  All exchanges match at once; then those that had counted on a row which
    an earlier one takes match again without such rows, until no exchange has other rows taken from it than before.  At that
    point each exchange has matched what the earlier ones leave, which is what the walk would give, and a round settles at
    least the next exchange of every chain of rivals.
    """
    pairs = materialize(exchange_pairs(rows), "exchange-pairs")
    proposed = materialize(_proposed(pairs), "exchange-matches")
    blocked = None
    while True:
        takers = proposed.groupBy("account_label", "row_seq").agg(F.min("at").alias("taken"))
        now = materialize(pairs.join(takers, ["account_label", "row_seq"]).where(F.col("at") > F.col("taken")).select(*_PAIR), "exchange-taken")
        if blocked is None:
            changed = now
        else:
            changed = now.exceptAll(blocked).unionByName(blocked.exceptAll(now))
        changed = materialize(changed.select("account_label", "debit_seq").distinct(), "exchange-again")
        if changed.isEmpty():
            break
        again = _proposed(pairs.join(changed, ["account_label", "debit_seq"], "left_semi").join(now, _PAIR, "left_anti"))
        proposed = materialize(proposed.join(changed, ["account_label", "debit_seq"], "left_anti").unionByName(again), "exchange-matches")
        blocked = now
    return proposed.select("account_label", "row_seq", F.col("rate").alias("matched_rate"))


def fill_exchange_rates(rows: DataFrame) -> DataFrame:
    return (
        rows.join(exchange_matches(rows), KEY, "left")
        .withColumn("fx_rate", F.coalesce("fx_rate", "matched_rate"))
        .drop("matched_rate")
    )


def repair_fx_rates(rows: DataFrame) -> DataFrame:
    """All three repairs; each stage reads its input several times, so it is written once."""
    ordered = fill_order_rates(rescale_rates(materialize(rows, "ledger-raw")))
    return fill_exchange_rates(materialize(ordered, "ledger-ordered"))
