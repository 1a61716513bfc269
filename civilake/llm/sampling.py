"""Bounded samples of labelled texts to fit a classifier on, and names that a table does not use yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.llm.staging import staged


#: So many rows of one or two numbers are sent to the rows they decide on; of more, both sides are shuffled by key.
BROADCAST_ROWS = 4_000_000


def few(decisions: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of keys, marked to be broadcast if it has at most ``most`` rows (about 24 bytes each), so that texts stay where they are."""
    return F.broadcast(decisions) if decisions.limit(most + 1).count() <= most else decisions


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the table has it (names differ by more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def labelled_sample(docs: DataFrame, label: Column, text: Column, per_label: int, in_all: int) -> DataFrame:
    """``label, h, body``: of each label the distinct texts of smallest hash, at most ``per_label`` of them and about ``in_all`` over all labels.

    Rows with a null label or text teach nothing. Equal texts of a label count
    once, however many copies there are, so a label made of copies keeps each of
    its texts. The table is scanned twice whatever the number of labels: labels
    and hashes alone choose, and the chosen texts are then joined back. Counts by
    the hashes' upper bits tell how far the smallest reach, so of a label only
    little more than the wanted rows are ever ranked.
    """
    known = docs.select(label.alias("label"), text.alias("body")).where("label IS NOT NULL AND body IS NOT NULL").withColumn("h", F.xxhash64("body"))
    upper = F.shiftright("h", 52)
    distinct = staged(known.select("label", "h").distinct().withColumn("upper", upper), "sample-hashes")
    before = F.sum("n").over(Window.partitionBy("label").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1))  # at most 2^12 rows a label
    reach = distinct.groupBy("label", "upper").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    near = distinct.join(reach.where(F.col("before") < per_label).select("label", "upper"), ["label", "upper"], "left_semi")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("rank") <= per_label)
    ranked = staged(ranked.select("label", "h", "rank"), "sample-ranked")
    labels = max(1, ranked.where("rank = 1").count())
    chosen = staged(ranked.where(F.col("rank") <= max(1, min(per_label, in_all // labels))).select("label", "h"), "sample-chosen")
    # The first of equal texts is taken before the shuffle too, so copies do not travel.
    found = known.join(chosen, ["label", "h"], "left_semi").groupBy("label", "h").agg(F.first("body").alias("body"))
    return staged(found, "sample-texts")
