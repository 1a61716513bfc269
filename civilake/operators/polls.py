"""Poll dataflow: options folded and summed, snapshots ranked, leaders, trends and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.functions.polls import UNDECIDED, is_undecided


def folded_options(options: DataFrame, keys: list[str], name: str, percentage: str, normalised: Column) -> DataFrame:
    """Percentages summed by normalised option; undecided options fold into one, which is there only if over 0."""
    folded = F.when(is_undecided(F.col(name)), F.lit(UNDECIDED)).otherwise(normalised)
    summed = options.groupBy(*keys, folded.alias("option")).agg(F.sum(F.coalesce(percentage, F.lit(0))).alias("pct"), F.min("option_id").alias("first_option"))
    return summed.where((F.col("option") != UNDECIDED) | (F.col("pct") > 0))


def first_question(questions: DataFrame, survey: str, number: str, kind: str, kinds: list[str]) -> DataFrame:
    """Each survey's first question of the first of these kinds that it has."""
    rank = F.lit(None).cast("int")
    for at, name in enumerate(kinds):
        rank = F.when(F.col(kind) == name, at).otherwise(rank)
    ranked = questions.withColumn("__kind", rank).where("__kind IS NOT NULL")
    order = Window.partitionBy(survey).orderBy("__kind", number)
    return ranked.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at", "__kind")


def ranked_snapshot(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Options by falling percentage; ties stand in the order of their first option."""
    order = Window.partitionBy(*keys).orderBy(F.desc("pct"), "first_option", "option")
    return folded.withColumn("rank", F.row_number().over(order))


def leaders(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Leader, runner-up, gap (0 without a runner-up) and undecided of each snapshot; none if only undecided is left.

    One grouped pass; a group is the options of one question.
    """
    real = F.col("option") != UNDECIDED
    listed = F.array_sort(F.collect_list(F.when(real, F.struct((-F.col("pct")).alias("fall"), "first_option", "option", "pct"))))
    top = folded.groupBy(*keys).agg(listed.alias("x"), F.coalesce(F.max(F.when(~real, F.col("pct"))), F.lit(0)).alias("undecided")).where("size(x) > 0")
    first, second = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    gap = F.coalesce(first["pct"] - second["pct"], F.lit(0))
    return top.select(*keys, first["option"].alias("leader"), first["pct"].alias("leader_pct"), second["option"].alias("runner_up"), gap.alias("gap"), "undecided")


def lead_second_other(folded: DataFrame, keys: list[str]) -> DataFrame:
    """First and second share, and what is left to 100, never below 0."""
    ranked = ranked_snapshot(folded, keys).where("rank <= 2")
    parts = ranked.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("pct"))).alias("lead"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("pct"))), F.lit(0)).alias("second"))
    return parts.withColumn("other", F.greatest(F.lit(0), F.lit(100) - F.col("lead") - F.col("second")))


def trend_window(points: DataFrame, when: str, months: int) -> DataFrame:
    """The points of the last ``months`` months before the latest one (month ends are clamped)."""
    latest = points.agg(F.max(when).alias("__latest"))
    return points.join(F.broadcast(latest)).where(F.col(when) >= F.add_months("__latest", -months)).drop("__latest")  # one row


def candidate_series(ranked: DataFrame, region: str, survey: str, when: str, wanted: str) -> DataFrame:
    """Each region's candidate in every survey beside the best rival.

    ``ranked`` has ``option, pct, rank`` without undecided ones. The candidate is
    the wanted one if the region's newest survey (ties to the smaller id) has it,
    else the one that survey puts first.
    """
    newest = ranked.groupBy(region).agg(F.max(F.struct(F.col(when), (-F.col(survey)).alias("k"))).alias("x")).select(F.col(region).alias("__region"), (-F.col("x.k")).alias("__survey"))
    last = ranked.join(newest, (F.col(region) == F.col("__region")) & (F.col(survey) == F.col("__survey")))
    has = F.max((F.col("option") == wanted).cast("int")) == 1
    picked = last.groupBy(region).agg(F.when(has, F.lit(wanted)).otherwise(F.min_by("option", "rank")).alias("candidate"))
    own = F.col("option") == F.col("candidate")
    pair = (F.max(F.when(own, F.col("pct"))).alias("own_pct"), F.max(F.when(~own, F.col("pct"))).alias("best_rival"))
    return ranked.join(picked, region).groupBy(region, survey, when, "candidate").agg(*pair)
