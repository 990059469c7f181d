"""Broker export folders: parse, repair, resolve columns.

A folder holds the three CSV files of one portfolio.  Only the splitting of a row into
cells happens in Python; finding rows (in blocks of lines, so a large file is many tasks),
repair, header matching and column inference are DataFrame operations.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfolio.functions.numbers import parse_decimal
from tallyfolio.functions.text import header_key, is_amount_fragment, is_currency_code
from tallyfolio.session import materialize, tasks_for

# --- fixed values: required files, missing-value texts, header aliases -----------
REQUIRED_FILES = ["Transactions.csv", "Portfolio.csv", "Account.csv"]
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
ALIASES = {
    "date": ["Date", "Datum"],
    "time": ["Time", "Tijd"],
    "value_date": ["Value date", "Waardedatum", "Valutadatum"],
    "product": ["Product", "Instrument"],
    "isin": ["ISIN"],
    "symbol_isin": ["Symbol/ISIN", "Symbool/ISIN", "ISIN"],
    "symbol": ["Symbol", "Ticker"],
    "quantity": ["Quantity", "Aantal"],
    "amount": ["Amount", "Quantity", "Aantal"],
    "price": ["Price", "Koers"],
    "closing": ["Closing", "Close", "Slotkoers", "Price"],
    "tx_value_eur": ["Value EUR", "Waarde EUR", "Value in EUR"],
    "pf_value_eur": ["Value in EUR", "Waarde in EUR", "Value EUR"],
    "total_eur": ["Total EUR", "Totaal EUR", "Total"],
    "fee": ["Transaction and/or third party fees EUR", "Transaction fees EUR", "Kosten EUR"],
    "autofx": ["AutoFX Fee", "AutoFX kosten"],
    "description": ["Description", "Omschrijving"],
    "tx_type": ["Type", "Soort", "Venue"],
    "type": ["Type", "Soort"],
    "change": ["Change", "Mutatie", "Mutatiebedrag"],
    "balance": ["Balance", "Saldo"],
    "fx": ["FX", "Exchange rate", "Wisselkoers"],
    "order_id": ["Order Id", "OrderId"],
    "currency": ["currency", "valuta"],
}
NEARBY = (1, 2, -1, -2, 3, -3)
NEAR_PRICE = (1, 2, -1)
SEPARATORS = (",", ";", "\t")
# ------------------------------------------------------------------------------
_BLOCK_ROWS, _TAIL_ROWS = 1 << 16, 1 << 10
_SPLIT, _TASK_BYTES = "spark.sql.files.maxPartitionBytes", 1 << 25


def _lines(spark: SparkSession, glob: str, block_bytes: int | None = None) -> DataFrame:
    """Every line of every file as raw bytes, with its block and its order in the block: a large file is many tasks.

    `block_bytes` sets the size of a block for this scan alone; the tables written from here on are read as usual.  Many
    small blocks or files share a task, which reads them one after the other, so a block's lines stay in order.
    """
    before = spark.conf.get(_SPLIT)
    if block_bytes is not None:
        spark.conf.set(_SPLIT, str(block_bytes))
    try:
        text = spark.read.option("lineSep", "\n").text(glob)
        blocks = text.rdd.getNumPartitions()
        if block_bytes is not None:
            tasks = max(2 * spark.sparkContext.defaultParallelism, -(-blocks * block_bytes // _TASK_BYTES))
            text = text.coalesce(min(max(blocks, 1), tasks))
        lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
        return materialize(lines.withColumn("value", F.col("value").cast("binary")), "export-lines")
    finally:
        spark.conf.set(_SPLIT, before)


def _file_traits(lines: DataFrame) -> DataFrame:
    """Per file: whether its bytes are UTF-8 (otherwise Latin-1), its first line, and its separator.

    The separator is the one of , ; tab seen most often outside quotes, by the votes of all lines, each weighed equally, so
    that a long free-text line does not decide.
    """
    text = F.col("value").cast("string")
    bare = F.regexp_replace(text, '"[^"]*+(?:"|$)', "")
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS]
    most = F.greatest(*counts)
    vote = F.when(most > 0, F.array_position(F.array(*counts), most))
    rows = lines.select("path", "block", "line", F.is_valid_utf8(text).alias("valid"), vote.alias("vote"))
    found = rows.groupBy("path").agg(
        F.bool_and("valid").alias("utf8"), F.min(F.struct("block", "line")).alias("first"), *[F.count_if(F.col("vote") == i + 1).alias(f"n{i}") for i in range(3)]
    )
    counts = F.array(*[F.col(f"n{i}") for i in range(3)])
    best = F.element_at(F.array(*[F.lit(s) for s in SEPARATORS]), F.array_position(counts, F.array_max(counts)).cast("int"))
    return found.select("path", "utf8", "first", best.alias("sep"))


def _ends_quoted(text: Column, sep: str) -> Column:
    """Whether a line that begins outside of quotes ends inside a quoted cell."""
    whole = r'"[^"]*+(?:""[^"]*+)*+"[^S]*+|[^"S][^S]*+|'.replace("S", sep)
    return text.rlike(rf'^(?:(?:{whole}){sep})*+"[^"]*+(?:""[^"]*+)*+$')


def _quoted_rest(text: Column, sep: str) -> Column:
    """What follows the cell that was open at the line's begin; NULL if it goes on beyond the line."""
    inside = r'[^"]*+(?:""[^"]*+)*+'
    return F.when(text.rlike(f'^{inside}"'), F.regexp_replace(text, f'^{inside}"[^{sep}]*+{sep}?', ""))


def _effects(lines: DataFrame) -> DataFrame:
    """Adds from_out, from_in: whether the line ends inside a quoted cell if it begins outside of one, or inside."""
    text, out, inn = F.col("text"), None, None
    for sep in SEPARATORS:
        here = F.col("sep") == sep
        rest = _quoted_rest(text, sep)
        one, two = _ends_quoted(text, sep), F.when(rest.isNull(), True).otherwise(_ends_quoted(rest, sep))
        out = F.when(here, one) if out is None else out.when(here, one)
        inn = F.when(here, two) if inn is None else inn.when(here, two)
    plain = F.instr(text, '"') == 0  # no quote: the state stays
    return lines.withColumn("from_out", F.when(plain, False).otherwise(out)).withColumn("from_in", F.when(plain, True).otherwise(inn))


def _composed(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """Prefix composition of two-state effects: adds turns (1 if a state is turned over an odd number of times since `known`)
    and known (the state at the last row that leaves only one, corrected by the turns up to it; NULL before such a row)."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turn = (F.col("from_out") & ~F.col("from_in")).cast("int")
    fixed = F.col("from_out") == F.col("from_in")
    rows = rows.withColumn("turns", F.sum(turn).over(w) % 2)
    at = F.when(fixed, F.col("from_out").cast("int").bitwiseXOR(F.col("turns")))
    return rows.withColumn("known", F.last(at, ignorenulls=True).over(w))


def _after(start: Column) -> Column:
    return F.coalesce("known", start).bitwiseXOR(F.col("turns").cast("int"))


def _with_rows(lines: DataFrame) -> DataFrame:
    """Adds row (number of the CSV row in its file) and single (the row is this line alone).

    Blocks are composed on their own; one row per block then gives the state at each block's begin and the rows before it.
    """
    lines = materialize(_composed(_effects(lines), ["path", "block"], "line").select("path", "block", "line", "text", "sep", "turns", "known"), "export-states")
    ends = lines.groupBy("path", "block").agg(F.max_by(F.struct("turns", "known"), "line").alias("e")).select("path", "block", "e.*")
    whole = ends.withColumn("from_out", F.coalesce("known", F.lit(0)).bitwiseXOR(F.col("turns").cast("int")) == 1)
    whole = whole.withColumn("from_in", F.coalesce("known", F.lit(1)).bitwiseXOR(F.col("turns").cast("int")) == 1).drop("turns", "known")
    earlier = Window.partitionBy("path").orderBy("block")
    starts = _composed(whole, ["path"], "block").withColumn("end", _after(F.lit(0)))
    starts = starts.select("path", "block", F.coalesce(F.lag("end").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("path", "block").orderBy("line")
    states = lines.join(starts, ["path", "block"]).withColumn("end", _after(F.col("start")))
    states = states.withColumn("begin", F.coalesce(F.lag("end").over(within), F.col("start")))
    states = states.withColumn("n", F.sum((F.col("begin") == 0).cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    states = materialize(states.select("path", "block", "line", "text", "sep", "begin", "end", "n"), "export-begins")
    before = F.coalesce(F.sum("rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = states.groupBy("path", "block").agg(F.max("n").alias("rows")).select("path", "block", before.alias("before"))
    single = (F.col("begin") == 0) & (F.col("end") == 0)
    return states.join(offsets, ["path", "block"]).select("path", "block", "line", "text", "sep", (F.col("before") + F.col("n") - 1).alias("row"), single.alias("single"))


def fit_row(row: list[str], width: int, sep: str) -> list[str]:
    """Pad a short row; fold the overflow of a long one into its last cell."""
    cells = [c.strip() for c in row]
    if len(cells) > width:
        cells = cells[: width - 1] + [sep.join(cells[width - 1 :])]
    return cells + [""] * (width - len(cells))


def _split_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cells = [next(csv.reader([text], delimiter=sep, quotechar='"'), []) for text, sep in zip(pdf["text"], pdf["sep"], strict=True)]
        yield pd.DataFrame({"path": pdf["path"], "row": pdf["row"], "sep": pdf["sep"], "raw": cells})


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        width = [len(raw) if row == 0 else int(w) for raw, row, w in zip(pdf["raw"], pdf["row"], pdf["width"], strict=True)]
        cells = [fit_row(list(raw), w, sep) for raw, w, sep in zip(pdf["raw"], width, pdf["sep"], strict=True)]
        yield pd.DataFrame({"path": pdf["path"], "row": pdf["row"], "cells": cells})


def read_rows(spark: SparkSession, glob: str, block_bytes: int | None = None) -> DataFrame:
    """Raw rows of every export file; row 0 is the header, blank rows are gone.

    Files are read in blocks of lines.  Whether a line begins inside a quoted cell (one with line breaks) follows from all
    lines before it, by composing what each line does to that state; lines of such a cell are put together, and only then
    are cells split.  Files in UTF-8 may begin with a byte-order mark; other files are Latin-1.  Without `block_bytes` a block
    is what the session reads in one task.
    """
    lines = _lines(spark, glob, block_bytes)
    lines = lines.join(_file_traits(lines), "path")
    text = F.when(F.col("utf8"), F.col("value").cast("string")).otherwise(F.decode("value", "ISO-8859-1"))
    head = (F.col("block") == F.col("first.block")) & (F.col("line") == F.col("first.line"))
    text = F.when(head & F.col("utf8"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    lines = _with_rows(lines.select("path", "block", "line", text.alias("text"), "sep"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"])
    joined = lines.where(~F.col("single")).groupBy("path", "row").agg(F.array_join(parts, "\n").alias("text"), F.first("sep").alias("sep"))
    whole = lines.where("single").select("path", "row", "text", "sep").unionByName(joined.select("path", "row", "text", "sep"))
    cells = materialize(whole.mapInPandas(_split_cells, "path string, row bigint, sep string, raw array<string>"), "export-cells")
    width = cells.where(F.size("raw") > 0).groupBy("path").agg(F.min_by(F.size("raw"), "row").alias("width"))
    fitted = cells.join(width, "path", "left").na.fill(0, ["width"]).mapInPandas(_fitted, "path string, row bigint, cells array<string>")
    kept = materialize(fitted.where((F.col("row") == 0) | F.exists("cells", lambda c: c != "")), "export-fitted")
    # rows are numbered anew without the blank ones: in blocks, then by what lies before a block
    kept = kept.withColumn("block", F.floor(F.col("row") / _BLOCK_ROWS))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("path", "block").agg(F.count("*").alias("rows")).select("path", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("path", "block").orderBy("row")) - 1
    rows = kept.withColumn("number", number).join(counts, ["path", "block"])
    return materialize(rows.select("path", (F.col("before") + F.col("number")).alias("row_seq"), "cells"), "export-rows")


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Folder and file name of every file (no content is read)."""
    path = F.col("path")
    return (
        spark.read.format("binaryFile")
        .load(glob)
        .select(
            F.regexp_replace(path, r"/[^/]*$", "").alias("folder"), F.element_at(F.split(path, "/"), -1).alias("name")
        )
    )


def account_label(path: Column) -> Column:
    """The portfolio label is the folder name."""
    return F.element_at(F.split(path, "/"), -2)


def _rank(key: Column, aliases: list[str]) -> Column:
    import re

    out = F.lit(None).cast("int")
    for i, alias in reversed(list(enumerate(aliases))):
        k = re.sub(r"[^a-z0-9 ]", "", re.sub(r"[_\s]+", " ", alias.strip().lower()))
        out = F.when(key == k, i).otherwise(out)
    return out


def header_positions(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Column position of every logical field per file; the first matching alias wins."""
    cells = rows.where(F.col("row_seq") == 0).select("path", F.posexplode("cells").alias("pos", "name"))
    keyed = cells.withColumn("k", header_key("name"))
    names = fields or list(ALIASES)
    ranked = keyed.select("path", "pos", *[_rank(F.col("k"), ALIASES[n]).alias(n) for n in names])
    return ranked.groupBy("path").agg(
        F.count(F.lit(1)).alias("width"),
        *[
            F.min_by("pos", F.when(F.col(n).isNotNull(), F.struct(F.col(n), F.col("pos")))).alias(f"at_{n}")
            for n in names
        ],
    )


def repair_rows(rows: DataFrame) -> DataFrame:
    """Merge continuation rows into the row above them.

    A continuation has exactly one filled cell and no date or time; product and
    description parts are joined by a space, order-id parts without one, and a
    description part that is only an amount with a currency is dropped.  The row
    above is found inside blocks of rows plus one carried value per block, so a
    huge file is never scanned by one task.
    """
    pos = header_positions(rows, ["date", "time", "product", "description", "order_id"])
    filled = F.filter(
        F.transform("cells", lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull()
    )
    blank_at = lambda p: F.col(p).isNull() | (F.get("cells", F.col(p)) == "")
    block = F.floor(F.col("row_seq") / _BLOCK_ROWS)
    body = rows.where(F.col("row_seq") > 0).withColumn("block", block)
    # whole rows are dealt once, by block; where their file has its columns goes to each block
    placed = body.select("path", "block").distinct().join(pos, "path")
    data = (
        body.repartition(tasks_for(rows.sparkSession, rows.count()), "path", "block")
        .join(placed, ["path", "block"])
        .withColumn("filled", filled)
        .withColumn("only", F.when(F.size("filled") == 1, F.get("filled", F.lit(0))))
    )
    first = F.col("row_seq") == 1  # blank rows are gone, so row 1 is the first data row
    kind = (
        F.when(F.col("only") == F.col("at_product"), "product")
        .when(F.col("only") == F.col("at_description"), "description")
        .when(F.col("only") == F.col("at_order_id"), "order_id")
    )
    lone = ~first & F.col("only").isNotNull() & blank_at("at_date") & blank_at("at_time")
    data = data.withColumn("kind", F.when(lone, kind)).withColumn("is_head", F.col("kind").isNull())
    head_here = F.when(F.col("is_head"), F.col("row_seq"))
    inside = Window.partitionBy("path", "block").orderBy("row_seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        data.groupBy("path", "block")
        .agg(F.max(head_here).alias("last_head"))
        .select("path", "block", F.max("last_head").over(before).alias("carried"))
    )
    islands = (
        data.withColumn("near", F.last(head_here, ignorenulls=True).over(inside))
        .join(carried, ["path", "block"])
        .withColumn("head", F.coalesce("near", "carried"))
    )
    text = F.get("cells", F.col("only"))
    tail = F.when(
        ~F.col("is_head") & ~((F.col("kind") == "description") & is_amount_fragment(text)),
        F.struct("row_seq", "kind", text.alias("text")),
    )
    # tails are joined in blocks of rows first, so what meets for one row is one text per block, not one per tail
    glue = {"product": " ", "description": " ", "order_id": ""}
    places = [F.max(f"at_{n}").alias(f"at_{n}") for n in glue]
    own = F.max(F.when(F.col("is_head"), F.col("cells"))).alias("cells")
    parts = islands.groupBy("path", F.col("head").alias("row_seq"), F.floor(F.col("row_seq") / _TAIL_ROWS).alias("part"))
    parts = parts.agg(own, *places, F.array_sort(F.collect_list(tail)).alias("tails"))

    def filled_texts(texts):
        return F.filter(texts, lambda p: p != "")

    def of_kind(name):
        found = F.transform(F.filter("tails", lambda t: t["kind"] == name), lambda t: t["text"])
        return F.array_join(filled_texts(found), glue[name]).alias(name)

    parts = parts.withColumn("piece", F.struct("part", *[of_kind(n) for n in glue]))
    merged = parts.groupBy("path", "row_seq").agg(F.max("cells").alias("cells"), *places, F.array_sort(F.collect_list("piece")).alias("pieces"))

    def with_tails(cell, name):
        return F.array_join(filled_texts(F.concat(F.array(cell), F.transform("pieces", lambda p: p[name]))), glue[name])

    fixed = F.transform(
        "cells",
        lambda c, i: F.when(i == F.col("at_product"), with_tails(c, "product"))
        .when(i == F.col("at_description"), with_tails(c, "description"))
        .when(i == F.col("at_order_id"), with_tails(c, "order_id"))
        .otherwise(c),
    )
    header = rows.where(F.col("row_seq") == 0).select("path", "row_seq", "cells")
    return header.unionByName(merged.select("path", "row_seq", fixed.alias("cells")))


def _value(cell: Column) -> Column:
    """Cell text, "" for every missing-value text."""
    return F.when(cell.isNull() | cell.isin(*MISSING_TEXT), "").otherwise(F.trim(cell))


def column_scores(rows: DataFrame) -> DataFrame:
    """Share of non-blank cells per column that parse as a number / look like a currency code."""
    cells = rows.where(F.col("row_seq") > 0).select("path", F.posexplode("cells").alias("pos", "cell"))
    filled = cells.withColumn("cell", _value(F.col("cell"))).where(F.col("cell") != "")
    return filled.groupBy("path", "pos").agg(
        F.avg(parse_decimal("cell").isNotNull().cast("double")).alias("numeric_ratio"),
        F.avg(is_currency_code("cell").cast("double")).alias("currency_ratio"),
    )


def _nearby(scores: Column, anchor: Column, width: Column, offsets, threshold: float, strict: bool) -> Column:
    """First neighbour reaching the threshold; unless strict, else the best positive one."""

    def candidate(i, off):
        pos = anchor + off
        score = F.coalesce(F.try_element_at(scores, pos.cast("int")), F.lit(0.0))
        inside = anchor.isNotNull() & (pos >= 0) & (pos < width)
        return F.when(inside, F.struct(score.alias("score"), F.lit(-i).alias("order"), pos.alias("pos")))

    found = F.array_compact(F.array(*[candidate(i, o) for i, o in enumerate(offsets)]))
    if strict:
        return F.get(F.filter(found, lambda c: c["score"] > threshold), F.lit(0))["pos"]
    reach = F.get(F.filter(found, lambda c: c["score"] >= threshold), F.lit(0))["pos"]
    best = F.array_max(F.filter(found, lambda c: c["score"] > 0))["pos"]
    return F.coalesce(reach, best)


def _amount_and_currency(anchor: Column, width: Column, num: Column, cur: Column, named: Column):
    """Which of the anchor and its neighbours hold the amount and the currency code."""
    n = F.coalesce(F.try_element_at(num, anchor.cast("int")), F.lit(0.0))
    c = F.coalesce(F.try_element_at(cur, anchor.cast("int")), F.lit(0.0))
    near_n = _nearby(num, anchor, width, NEARBY, 0.5, False)
    near_c = _nearby(cur, anchor, width, NEARBY, 0.5, False)
    anchor_is_code = (c >= 0.60) & (c > n)
    anchor_is_amount = n >= c
    amount = F.when(anchor_is_code, near_n).when(anchor_is_amount, anchor).otherwise(F.coalesce(near_n, anchor))
    code = (
        F.when(anchor_is_code, anchor)
        .when(anchor_is_amount, F.coalesce(near_c, named))
        .otherwise(F.when(c > 0, anchor).otherwise(F.coalesce(near_c, named)))
    )
    return F.when(anchor.isNotNull(), amount), F.when(anchor.isNotNull(), code).otherwise(named)


def resolve_columns(rows: DataFrame) -> DataFrame:
    """Per file: positions of all fields, including the inferred amount and currency columns."""
    scores = column_scores(rows).groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "numeric_ratio"))).alias("num"),
        F.map_from_entries(F.collect_list(F.struct("pos", "currency_ratio"))).alias("cur"),
    )
    empty = F.create_map().cast("map<int,double>")
    files = (
        header_positions(rows)
        .join(scores, "path", "left")
        .withColumns({"num": F.coalesce("num", empty), "cur": F.coalesce("cur", empty)})
    )
    width, num, cur, named = F.col("width"), F.col("num"), F.col("cur"), F.col("at_currency")
    change, change_code = _amount_and_currency(F.col("at_change"), width, num, cur, named)
    balance, balance_code = _amount_and_currency(F.col("at_balance"), width, num, cur, named)
    return files.withColumns(
        {
            "at_tx_currency": F.coalesce(_nearby(cur, F.col("at_price"), width, NEAR_PRICE, 0.5, True), named),
            "at_pf_currency": F.coalesce(_nearby(cur, F.col("at_closing"), width, NEAR_PRICE, 0.5, True), named),
            "at_change_amount": change,
            "at_change_currency": change_code,
            "at_balance_amount": balance,
            "at_balance_currency": balance_code,
        }
    ).drop("num", "cur")


def located_rows(rows: DataFrame) -> DataFrame:
    """Data rows with their file's column positions and the portfolio label.

    The per-file table joins on path; a file holding most rows is split by skew handling.
    """
    data = rows.where(F.col("row_seq") > 0)
    return data.join(resolve_columns(rows), "path").withColumn("account_label", account_label(F.col("path")))


def cell(field: str) -> Column:
    """Text of a field, "" where the column or value is missing."""
    pos = F.col(f"at_{field}")
    return F.coalesce(F.when(pos.isNotNull(), _value(F.get("cells", pos))), F.lit(""))


# --- fixed values: columns a file cannot do without -------------------------------
REQUIRED_COLUMNS = {
    "Transactions.csv": ["date", "product"],
    "Portfolio.csv": ["product", "pf_value_eur"],
    "Account.csv": ["date", "change_amount", "balance_amount"],
}
# ------------------------------------------------------------------------------


def missing_columns(resolved: DataFrame) -> DataFrame:
    """Files without a required column."""
    name = F.element_at(F.split("path", "/"), -1)
    checks = F.array(
        *[
            F.when((name == f) & F.col(f"at_{c}").isNull(), F.lit(c))
            for f, cols in REQUIRED_COLUMNS.items()
            for c in cols
        ]
    )
    return (
        resolved.select("path", F.array_compact(checks).alias("missing"))
        .where(F.size("missing") > 0)
        .select("path", F.array_join("missing", ", ").alias("missing_columns"))
    )
