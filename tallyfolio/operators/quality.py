"""Data-quality reports: missing values, coverage gaps and duplicate uploads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCOUNT = "account_label"

# --- fixed values: label, table, failing predicate, example columns -------------
MISSING = {
    "transactions": [
        ("Transactions: invalid datetime rows (ignored in time-series)", "datetime is null",
         ["product", "isin", "quantity", "total_eur", "description"]),
        ("Transactions: NaN in total_eur", "total_eur is null",
         ["datetime", "product", "isin", "quantity", "price", "total_eur"]),
        ("Transactions: NaN in quantity", "quantity is null",
         ["datetime", "product", "isin", "quantity", "total_eur", "type"]),
    ],
    "portfolio": [
        ("Portfolio: NaN in value_eur", "value_eur is null",
         ["product", "isin", "quantity", "price", "currency", "is_cash_like"]),
    ],
    "account": [
        ("Account: invalid datetime rows", "datetime is null",
         ["description", "type", "currency", "raw_change", "raw_balance"]),
        ("Account: NaN in balance_eur (FX missing in CSV; fallback may apply later)",
         "balance_eur is null and raw_balance is not null",
         ["datetime", "description", "currency", "raw_balance", "fx_rate", "balance_eur"]),
        ("Account: NaN in change_eur (FX missing in CSV; fallback may apply later)",
         "change_eur is null and raw_change is not null",
         ["datetime", "description", "currency", "raw_change", "fx_rate", "change_eur"]),
    ],
}
# ------------------------------------------------------------------------------


def _table_issues(rows: DataFrame, table: str, max_examples: int) -> DataFrame:
    """All predicates of one table in one pass; only failing rows travel."""

    def issue(label, predicate, columns):
        present = [c for c in columns if c in rows.columns]
        example = F.to_json(F.struct("row_seq", *present))
        return F.when(F.expr(predicate), F.struct(F.lit(label).alias("label"), example.alias("example")))

    failing = rows.select(
        ACCOUNT, "row_seq", F.explode(F.array_compact(F.array(*[issue(*i) for i in MISSING[table]]))).alias("i")
    ).select(ACCOUNT, "row_seq", "i.*")
    counts = failing.groupBy(ACCOUNT, "label").agg(F.count(F.lit(1)).alias("count"))
    # The rank filter is applied before the shuffle too, so at most a few rows per label move.
    first = Window.partitionBy(ACCOUNT, "label").orderBy("row_seq", "example")
    examples = (
        failing.withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= max_examples)
        .groupBy(ACCOUNT, "label")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "example"))).alias("e"))
        .select(ACCOUNT, "label", F.transform("e", lambda x: x["example"]).alias("examples"))
    )
    return counts.join(examples, [ACCOUNT, "label"])


def missing_value_issues(tx: DataFrame, portfolio: DataFrame, ledger: DataFrame, max_examples: int = 3) -> DataFrame:
    """Count and first examples for every rule that fails."""
    parts = [
        _table_issues(frame, name, max_examples)
        for name, frame in (("transactions", tx), ("portfolio", portfolio), ("account", ledger))
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ledger_coverage(tx: DataFrame, ledger: DataFrame) -> DataFrame:
    """Portfolios whose ledger starts after their trades, with the number of uncovered trades."""
    day = F.to_date("datetime")
    starts = ledger.groupBy(ACCOUNT).agg(F.min(day).alias("first_account"))
    per_day = tx.where(F.col("datetime").isNotNull()).groupBy(ACCOUNT, day.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_day.join(starts.where(F.col("first_account").isNotNull()), ACCOUNT)
        .groupBy(ACCOUNT, "first_account")
        .agg(
            F.min("date").alias("first_tx"),
            F.coalesce(F.sum(F.when(F.col("date") < F.col("first_account"), F.col("n"))), F.lit(0)).alias("n"),
        )
        .where(F.col("first_account") > F.col("first_tx"))
        .select(
            ACCOUNT,
            F.date_format("first_tx", "yyyy-MM-dd").alias("first_transaction_date"),
            F.date_format("first_account", "yyyy-MM-dd").alias("first_account_date"),
            F.col("n").alias("transactions_before_account_start"),
        )
    )


def activity_range(tx: DataFrame, ledger: DataFrame) -> DataFrame:
    """First and last active day per portfolio over both tables."""

    def span(frame):
        day = F.to_date("datetime")
        return frame.groupBy(ACCOUNT).agg(F.min(day).alias("a"), F.max(day).alias("b"))

    return (
        span(tx)
        .unionByName(span(ledger))
        .groupBy(ACCOUNT)
        .agg(
            F.date_format(F.min("a"), "yyyy-MM-dd").alias("first_date"),
            F.date_format(F.max("b"), "yyyy-MM-dd").alias("last_date"),
        )
    )


# --- fixed values: content columns of each fingerprint ---------------------------
FINGERPRINT = {
    "transactions": ["datetime", "instrument_id", "quantity", "total_eur"],
    "account": ["datetime", "description", "currency", "raw_change", "raw_balance"],
    "portfolio": ["instrument_id", "product", "quantity", "value_eur"],
}
# ------------------------------------------------------------------------------


def fingerprints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free content fingerprint per portfolio: row count and two hash sums.

    Sums are partial aggregates, so a portfolio of any size costs one row per task.
    NULLs are marked, so a missing value differs from an empty one.
    """
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]
    wide = "decimal(38,0)"
    return rows.groupBy(ACCOUNT).agg(
        F.concat_ws(
            ":",
            F.count(F.lit(1)).cast("string"),
            F.sum(F.xxhash64(*marked).cast(wide)).cast("string"),
            F.sum(F.xxhash64(F.lit("second"), *reversed(marked)).cast(wide)).cast("string"),
        ).alias("print")
    )


def duplicate_uploads(tx: DataFrame, ledger: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Portfolios sharing their ledger or snapshot content with one that has different trades.

    Each flagged portfolio names one other (the smallest label with other trades)
    and the size of its copy group; pairs inside a group are never spelled out, so a
    huge group of copies stays linear.
    """
    trades = fingerprints(tx, FINGERPRINT["transactions"]).withColumnRenamed("print", "tx_print")
    parts = []
    for kind, frame in (("account", ledger), ("portfolio", portfolio)):
        rows = fingerprints(frame, FINGERPRINT[kind]).join(trades, ACCOUNT, "left").withColumn(
            "tx_print", F.coalesce("tx_print", F.lit(""))
        )
        variants = rows.groupBy("print", "tx_print").agg(F.min(ACCOUNT).alias("label"), F.count(F.lit(1)).alias("n"))
        best = variants.groupBy("print").agg(
            F.min(F.struct("label", "tx_print")).alias("best"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("kinds")
        ).where(F.col("kinds") > 1)
        second = (
            variants.join(best, "print")
            .where(F.col("tx_print") != F.col("best.tx_print"))
            .groupBy("print")
            .agg(F.min("label").alias("second"))
        )
        flagged = rows.join(best.join(second, "print"), "print")
        other = F.when(F.col("tx_print") != F.col("best.tx_print"), F.col("best.label")).otherwise(F.col("second"))
        parts.append(
            flagged.select(ACCOUNT, F.lit(kind).alias("same_content"), other.alias("same_as"), "group_size")
        )
    return parts[0].unionByName(parts[1])


def file_set_check(files: DataFrame, required: list[str]) -> DataFrame:
    """Missing and unexpected file names per folder; only incomplete folders are returned."""
    names = F.array(*[F.lit(n) for n in required])
    return (
        files.groupBy("folder")
        .agg(F.array_sort(F.collect_set("name")).alias("names"))
        .select(
            "folder",
            F.array_join(F.array_sort(F.array_except(names, F.col("names"))), ", ").alias("missing"),
            F.array_join(F.array_sort(F.array_except(F.col("names"), names)), ", ").alias("unexpected"),
        )
        .where((F.col("missing") != "") | (F.col("unexpected") != ""))
    )
