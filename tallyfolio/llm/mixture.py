"""Operator 10, mixing sources to target weights by Efraimidis-Spirakis sampling.  DataFrame functions only.

Every document gets the key -ln(u) / quality weight with u drawn from a hash of its id; within a source, documents in
order of their keys are a weighted sample without replacement.  A source's target is split into complete epochs of the
whole source, then a fractional one: documents in key order until a prefix sum of their sizes reaches the budget; the
document at the border is taken in part, so that a source's words meet its target to the word.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the size of all documents; none may
exceed `most_epochs` times its source, and the excess is shared by weight among the others (the water level is solved in
closed form over one row per source).

Large sources: prefix sums have three levels.  Keys fall into 65536 ranges, ranges into 256 groups; group and range sums
are aggregated first, so a window never holds more than one key range of one source, and no source meets in one task.

Defined cases: null and empty texts have size 0 and are taken 0 times; a source without words has target 0; a null source
is a source; rows that repeat an id are rows of their own with the same key, in order of size; other columns are ignored
by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.llm.common import stored

MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
_RANGES, _GROUPS = 65536, 256


def size_of(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.25 (symbols are a quarter of the characters or more) to 1 (no symbols)."""
    n = F.length(text)
    share = (n - F.length(F.translate(text, "#*$%&|<>", ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(F.lit(1.0) - F.lit(0.75) * F.least(F.lit(1.0), share * 4), F.lit(1.0))


def uniform(id_col: Column) -> Column:
    """Between 0 and 1, neither included, from a hash of the id."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).  One row per source, null included."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    s = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * most_epochs)
    s = s.withColumn("level", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("sum_w", F.sum("w").over(all_rows))
    s = s.withColumn("water", (F.col("total") - F.coalesce(F.sum("cap").over(by_level), F.lit(0))) / (F.col("sum_w") - F.coalesce(F.sum("w").over(by_level), F.lit(0))))
    # the first source, by level, that the water doesn't cover sets the water level
    level = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(all_rows)["water"]
    s = s.withColumn("final", level)
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: (id_col, source, size, source_size, target, epochs, taken, key)."""
    text = F.col(text_col)
    keyed = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text).alias("size"), (-F.log(uniform(F.col(id_col))) / quality_weight(text)).alias("key")
    )
    part = F.least(F.floor((1 - F.exp(-F.col("key") / 4)) * _RANGES), F.lit(_RANGES - 1)).cast("int")
    keyed = stored(keyed.withColumn("part", part), "mix-keys")

    names = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")]
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = stored(parts.select("source", *names, "part", "part_size", F.floor(F.col("part") / _GROUPS).cast("int").alias("grp")), "mix-parts")
    groups = parts.groupBy("source", "s", "none", "grp").agg(F.sum("part_size").alias("grp_size"))
    before = Window.partitionBy("s", "none").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("grp_before", F.coalesce(F.sum("grp_size").over(before), F.lit(0)))
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most_epochs)
    goal = goal.select(*names, "source_size", "target")
    groups = groups.join(goal, ["s", "none"]).select("s", "none", "grp", "grp_before", "source_size", "target")
    before = Window.partitionBy("s", "none", "grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("in_grp", F.coalesce(F.sum("part_size").over(before), F.lit(0))).join(groups, ["s", "none", "grp"])
    parts = parts.select("s", "none", "part", (F.col("grp_before") + F.col("in_grp")).alias("part_before"), "source_size", "target")

    rows = keyed.select("*", *names).join(parts, ["s", "none", "part"])
    order = Window.partitionBy("s", "none", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("part_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before")))
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "epochs", taken.alias("taken"), "key")


ORACLE = r"""
WITH k AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / coalesce(1.0::DOUBLE - 0.75::DOUBLE * least(1.0::DOUBLE, (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE * 4), 1.0::DOUBLE) AS key
  FROM {documents}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM k GROUP BY source
), t AS (
  SELECT *, (3 * source_size)::DOUBLE / w AS level, sum(source_size) OVER () AS total, sum(w) OVER () AS sum_w,
    coalesce(sum(3 * source_size) OVER b, 0) AS c_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM s WINDOW b AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (SELECT *, (total - c_before)::DOUBLE / (sum_w - w_before)::DOUBLE AS water FROM t),
v AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT water FROM u WHERE water <= level ORDER BY level, water LIMIT 1) * w) AS target FROM u
), r AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN v ON k.source IS NOT DISTINCT FROM v.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM r
"""
