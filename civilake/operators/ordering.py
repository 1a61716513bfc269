"""Pages, ranks and first/last rows, always under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.session import spread, written


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows, with ``is_last_page`` from one row of look-ahead."""
    ahead = rows.orderBy(*order).offset(number * size).limit(size + 1)
    numbered = ahead.withColumn("__at", F.row_number().over(Window.orderBy(*order)))  # at most size + 1 rows
    flagged = numbered.withColumn("is_last_page", F.count("*").over(Window.partitionBy()) <= size)
    return flagged.where(F.col("__at") <= size).drop("__at")


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under the order; the order should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank_as: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(rank_as, rank).where(F.col(rank_as) <= n)


def nearest_or_latest(rows: DataFrame, key: str, when: str, today: Column) -> DataFrame:
    """One row: the key of the earliest date not before ``today``, or else of the latest date."""
    ahead = F.when(F.col(when) >= today, F.struct(F.col(when), F.col(key)))
    behind = F.struct(F.col(when), (-F.col(key)).alias("k"))
    return rows.agg(F.min(ahead).alias("a"), F.max(behind).alias("b")).select(
        F.coalesce(F.col(f"a.{key}"), -F.col("b.k")).alias(key), F.coalesce(F.col(f"a.{when}"), F.col(f"b.{when}")).alias(when)
    )


def fair_merge(rows: DataFrame, queue: str, order: list[Column], queues: list[str], start: int, n: int) -> DataFrame:
    """Round robin over queues, each in its own order, beginning with queue number ``start``; the first ``n`` turns."""
    turn = F.row_number().over(Window.partitionBy(queue).orderBy(*order))
    seat = F.lit(None).cast("int")
    for at, name in enumerate(queues):
        seat = F.when(F.col(queue) == name, F.lit((at - start) % len(queues))).otherwise(seat)
    ranked = rows.withColumns({"turn": turn, "seat": seat}).where(f"turn <= {n} AND seat IS NOT NULL")
    return ranked.orderBy("turn", "seat").limit(n)


def gap_clusters(rows: DataFrame, keys: list[str], x: str, tie: str, clusters: int, least_gap: float) -> DataFrame:
    """``cluster`` (from 0) of each row along ``x``: a group is cut at its ``clusters - 1`` largest gaps over ``least_gap``.

    A group of at most ``clusters`` rows has one row a cluster; one with fewer
    wide gaps than cuts has no clusters and gives no rows.
    """
    group = Window.partitionBy(*keys)
    along = group.orderBy(x, tie)
    gapped = spread(rows, *keys, of=rows).withColumns({"__gap": F.col(x) - F.lag(x).over(along), "__at": F.row_number().over(along), "__n": F.count("*").over(group)})
    widest = group.orderBy(F.desc_nulls_last("__gap"), x, tie)
    cut = (F.row_number().over(widest) < clusters) & (F.col("__gap") > least_gap)
    counted = gapped.withColumn("__cut", F.when(cut, 1).otherwise(0))
    counted = counted.withColumns({"__cuts": F.sum("__cut").over(group), "__before": F.sum("__cut").over(along.rowsBetween(Window.unboundedPreceding, 0))})
    single = F.col("__n") <= clusters
    found = counted.withColumn("cluster", F.when(single & (clusters > 1), F.col("__at").cast("bigint") - 1).otherwise(F.col("__before")))
    return found.where(single | (F.col("__cuts") == clusters - 1)).drop("__gap", "__at", "__n", "__cut", "__cuts", "__before")


def lines_of(words: DataFrame, page: str, x: str, y: str, word: str, most: float = 3.0) -> DataFrame:
    """``page, line_no, line``: words by rounded y, then x; a new line begins where y is more than ``most`` from that of the line's first word."""
    listed = F.array_sort(F.collect_list(F.struct(F.bround(y).alias("y"), F.col(x).alias("x"), F.col(word).cast("string").alias("w"))))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<string>").alias("lines"))

    def step(state, one):
        fresh = state["y"].isNull() | (F.abs(one["y"] - state["y"]) > most)
        count = F.size(state["lines"])
        grown = F.concat(F.slice(state["lines"], 1, F.greatest(count - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(state["lines"], -1), one["w"])))
        lines = F.when(fresh, F.concat(state["lines"], F.array(one["w"]))).otherwise(grown)
        return F.struct(F.when(fresh, one["y"].cast("double")).otherwise(state["y"]).alias("y"), lines.alias("lines"))

    pages = words.groupBy(page).agg(F.aggregate(listed, start, step, lambda s: s["lines"]).alias("lines"))
    return pages.select(page, F.posexplode("lines").alias("line_no", "line"))


def bounded(rows: DataFrame, when: str, start: Column | None = None, end: Column | None = None, equal: dict | None = None) -> DataFrame:
    """Rows within optional bounds of a date and with optional values of columns; what is None does not filter."""
    for bound, holds in ((start, lambda b: F.col(when) >= b), (end, lambda b: F.col(when) <= b)):
        rows = rows if bound is None else rows.where(holds(bound))
    for column, value in (equal or {}).items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def running_totals(rows: DataFrame, order: list[str], value: str, path: str, total: str = "running") -> DataFrame:
    """``rows`` with the sum of ``value`` (a whole number or decimal) up to and with each row in the order of the columns ``order``, which should be total.

    Rows are dealt into ranges of the order and written once under ``path``; the
    ranges' sums, one row each, are added up and sent back, so no task sees more
    than its range. A null value counts as nothing.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    held = written(ranged, path)
    sums = held.groupBy("__range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sums.select("__range", before.alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return held.withColumn(total, inside).join(F.broadcast(starts), "__range").withColumn(total, F.col(total) + F.col("__before")).drop("__range", "__before")
