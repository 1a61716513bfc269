"""Aggregates of the domain beyond a plain groupBy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One row: the total and, for each step, how many rows reached it (null over no rows, as a SUM of CASE gives)."""
    return rows.agg(F.count("*").alias("total"), *(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in steps.items()))


def weighted_recent(events: DataFrame, key: str, order: list[Column], kinds: dict[str, tuple[str, int, int]], n: int) -> DataFrame:
    """Top ``n`` keys by weighted counts over each kind's most recent events.

    ``kinds`` maps an event kind's condition column value to (column, how many
    recent events count, weight). Ties go to the smaller key.
    """
    parts = []
    for kind, (column, recent, weight) in kinds.items():
        last = events.where(F.col(column) == kind).orderBy(*order).limit(recent)
        parts.append(last.select(key, F.lit(weight).alias("w")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(key).agg(F.sum("w").alias("score")).orderBy(F.desc("score"), key).limit(n)


def modal(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each group's most frequent value (ties to the smaller), its share and the group's rows."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc(value))
    ranked = counts.withColumns({"rank": F.row_number().over(order), "total": F.sum("n").over(Window.partitionBy(*group))})
    return ranked.where("rank = 1").select(*group, F.col(value).alias("mode"), (F.col("n") / F.col("total")).alias("confidence"), "total")


def top_and_other(rows: DataFrame, key: str, n: int, other: str = "other") -> DataFrame:
    """Counts of the ``n`` most frequent keys, and of all others together."""
    counts = rows.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(n).select(F.col(key).alias("__top"))
    marked = counts.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("__top")) & F.col(key).isNotNull(), "left")  # n rows
    return marked.groupBy(F.coalesce("__top", F.lit(other)).alias(key)).agg(F.sum("n").alias("n"))


def value_counts(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """``field, value, n``: the ``n`` most frequent values of each column, ties to the smaller value; one pass over the rows.

    Each row is counted under every column at once; only the counts are ranked.
    """
    listed = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    counts = rows.select(listed).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def samples_per(rows: DataFrame, key: str, item: Column, n_samples: int, n_keys: int) -> DataFrame:
    """The ``n_keys`` keys with most rows: count and the first few items in order, comma-joined. Only rows of the chosen keys are ranked."""
    items = rows.select(key, item.alias("__item"))
    top = items.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n_keys)
    own = items.join(F.broadcast(top.select(key)), key, "left_semi")  # n_keys rows
    first = own.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy("__item"))).where(F.col("__at") <= n_samples)
    listed = first.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("__item")).cast("array<string>"), ",").alias("samples"))
    return top.join(listed, key, "left").select(key, "n", "samples")


def totals(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """``source, n``: the rows of each table; 0 for one that is not there."""
    counts = [rows.agg(F.count("*").alias("n")) if rows is not None else spark.range(1).select(F.lit(0).cast("bigint").alias("n")) for rows in tables.values()]
    return reduce(DataFrame.unionByName, [c.select(F.lit(name).alias("source"), "n") for name, c in zip(tables, counts, strict=True)])


def changes(rows: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows each change of a value concerns; rows that stay the same do not count."""
    return rows.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(before, after).agg(F.count("*").alias("n"))
