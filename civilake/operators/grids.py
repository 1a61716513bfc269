"""Tables of words on a page: merged cells divided again by where their words stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_ranges(cells: DataFrame, table: str, row: str, column: str, left: str, right: str) -> DataFrame:
    """``table, column, lo, hi``: each column's place, the upper median over the rows with most cells, where no cell is merged."""
    counts = cells.groupBy(table, row).agg(F.count("*").alias("__n"))
    most = counts.groupBy(table).agg(F.max("__n").alias("__n"))
    fullest = cells.join(counts.join(most, [table, "__n"], "left_semi").select(table, row), [table, row], "left_semi")
    listed = fullest.groupBy(table, column).agg(F.sort_array(F.collect_list(left)).alias("__l"), F.sort_array(F.collect_list(right)).alias("__r"))
    middle = F.floor(F.size("__l") / 2).cast("int")
    return listed.select(table, column, F.get("__l", middle).alias("lo"), F.get("__r", middle).alias("hi"))


def unmerged_words(cells: DataFrame, words: DataFrame, table: str, row: str, column: str, left: str, right: str, x0: str, x1: str, word: str) -> DataFrame:
    """``table, row, column, text``: the words of each merged cell given to the columns they stand in.

    A cell is merged if its right edge lies over 5 beyond its column's and it
    covers more than one column (within 2). Its words, of the same row and inside
    it (within 2), go to the first column that holds their centre. It is divided
    only if they fall into several columns and all are numbers; other cells, and
    cells of one column, give no rows.
    """
    ranges = column_ranges(cells, table, row, column, left, right)
    own = cells.join(ranges, [table, column]).where(F.col(right) > F.col("hi") + 5)
    merged = own.select(table, row, F.col(column).alias("__cell"), F.col(left).alias("__x0"), F.col(right).alias("__x1"))
    spans = ranges.select(table, F.col(column).alias("__column"), "lo", "hi")
    covered = merged.join(spans, table).where((F.col("lo") >= F.col("__x0") - 2) & (F.col("hi") <= F.col("__x1") + 2))
    centre = (F.col(x0) + F.col(x1)) / 2
    inside = (F.col(x0) >= F.col("__x0") - 2) & (F.col(x1) <= F.col("__x1") + 2)
    held = covered.join(words.select(table, row, x0, x1, word), [table, row]).where(inside & centre.between(F.col("lo") - 2, F.col("hi") + 2))
    placed = held.groupBy(table, row, "__cell", x0, x1, word).agg(F.min("__column").alias(column))
    counted = merged.join(words.select(table, row, x0, x1, word), [table, row]).where(inside).groupBy(table, row, "__cell").agg(F.min(F.trim(word).rlike(r"^\d+\.?\d*$").cast("int")).alias("__numbers"))
    several = placed.groupBy(table, row, "__cell").agg(F.count_distinct(column).alias("__columns")).where("__columns > 1")
    divided = placed.join(several, [table, row, "__cell"], "left_semi").join(counted.where("__numbers = 1"), [table, row, "__cell"], "left_semi")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(x0, word))), lambda w: w[word]), " ")
    return divided.groupBy(table, row, column).agg(texts.alias("text"))
