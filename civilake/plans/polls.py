"""Poll queries over the fixture analogue: orders are surveys, line items options, customers' nations regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civilake.functions import polls as rules
from civilake.operators import ordering, polls
from civilake.plans.registry import Registry
from civilake.session import table

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles

#: The same views for the oracles.
VIEWS = """
WITH surveys AS (
  SELECT o_orderkey AS survey_id, c_nationkey AS region, CAST(o_orderdate AS DATE) AS end_date, o_orderpriority AS election
  FROM orders JOIN customer ON o_custkey = c_custkey),
options AS (
  SELECT l_orderkey AS survey_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS number, l_linenumber AS option_id,
         CASE l_suppkey % 7 WHEN 0 THEN '지지정당 없음' WHEN 1 THEN '잘 모름' ELSE 'Party ' || CAST(l_suppkey % 7 AS VARCHAR) END AS name, l_quantity AS pct
  FROM lineitem),
folded AS (
  SELECT survey_id, number, CASE WHEN name IN ('지지정당 없음', '잘 모름') THEN 'undecided' ELSE name END AS option, sum(pct) AS pct, min(option_id) AS first_option
  FROM options GROUP BY 1, 2, 3 HAVING CASE WHEN name IN ('지지정당 없음', '잘 모름') THEN 'undecided' ELSE name END <> 'undecided' OR sum(pct) > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY survey_id, number ORDER BY pct DESC, first_option, option) AS rank FROM folded),
decided AS (
  SELECT *, row_number() OVER (PARTITION BY survey_id, number ORDER BY pct DESC, first_option, option) AS place FROM folded WHERE option <> 'undecided'),
chosen AS (
  SELECT survey_id, number FROM (SELECT survey_id, number, row_number() OVER (PARTITION BY survey_id ORDER BY CASE number WHEN 3 THEN 0 ELSE 1 END, number) AS r
    FROM (SELECT DISTINCT survey_id, number FROM options WHERE number IN (2, 3))) WHERE r = 1)"""


def surveys(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    return table(spark, d, "orders").join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("survey_id"), "region", F.col("o_orderdate").cast("date").alias("end_date"), F.col("o_orderpriority").alias("election")
    )


def options(spark: SparkSession, d: str) -> DataFrame:
    """One row per option; the question's number follows the return flag, the option's name the supplier."""
    party = F.col("l_suppkey") % 7
    name = F.when(party == 0, "지지정당 없음").when(party == 1, "잘 모름").otherwise(F.concat(F.lit("Party "), party))
    number = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("survey_id"), number.alias("number"), F.col("l_linenumber").alias("option_id"), name.alias("name"), F.col("l_quantity").alias("pct")
    )


def titled(questions: DataFrame) -> DataFrame:
    """Questions with the kind that their title classifies to."""
    title = F.when(F.col("number") == 1, "정당 지지도").when(F.col("number") == 2, "후보 적합도").otherwise("가상 대결")
    return questions.withColumn("kind", rules.question_kind(title))


def folded(rows: DataFrame) -> DataFrame:
    return polls.folded_options(rows, ["survey_id", "number"], "name", "pct", rules.party_name(F.col("name")))


@query(VIEWS + "\nSELECT survey_id, number, option, pct FROM folded")
def poll_option_agg(spark, d):
    """Percentages by option, undecided answers folded into one."""
    return folded(options(spark, d)).select("survey_id", "number", "option", "pct")


@query(VIEWS + "\nSELECT survey_id, number, option, pct, CAST(rank AS INTEGER) AS rank FROM ranked WHERE number = 1")
def poll_snapshot(spark, d):
    """Party support of every survey, highest first."""
    return polls.ranked_snapshot(folded(options(spark, d).where("number = 1")), ["survey_id", "number"]).drop("first_option")


@query(VIEWS + """,
latest AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY region ORDER BY end_date DESC, survey_id) AS r FROM surveys s) WHERE r = 1)
SELECT region, survey_id, end_date FROM latest""", dates=("end_date",))  # fmt: skip
def latest_per_region(spark, d):
    found = ordering.first_per(surveys(spark, d), ["region"], [F.desc("end_date"), F.asc("survey_id")])
    return found.select("region", "survey_id", "end_date")


@query(VIEWS + "\nSELECT survey_id, number FROM chosen")
def first_question_per_survey(spark, d):
    """A head-to-head question if the survey has one, else the question of candidate fit."""
    questions = titled(options(spark, d).select("survey_id", "number").distinct())
    return polls.first_question(questions, "survey_id", "number", "kind", ["MATCHUP", "CANDIDATE_FIT"]).select("survey_id", "number")


@query(VIEWS + """
SELECT a.survey_id, s.region, s.end_date, a.option AS leader, a.pct AS leader_pct, b.option AS runner_up, coalesce(a.pct - b.pct, 0) AS gap, coalesce(u.pct, 0) AS undecided
FROM decided a JOIN surveys s ON s.survey_id = a.survey_id LEFT JOIN decided b ON b.survey_id = a.survey_id AND b.number = 1 AND b.place = 2
LEFT JOIN folded u ON u.survey_id = a.survey_id AND u.number = 1 AND u.option = 'undecided' WHERE a.number = 1 AND a.place = 1""", dates=("end_date",))  # fmt: skip
def poll_overview_leader_gap(spark, d):
    """Leader, runner-up, gap and undecided of each survey's party question."""
    found = polls.leaders(folded(options(spark, d).where("number = 1")), ["survey_id"])
    return found.join(surveys(spark, d).drop("election"), "survey_id").select("survey_id", "region", "end_date", "leader", "leader_pct", "runner_up", "gap", "undecided")


@query(VIEWS + """
SELECT s.region, s.survey_id, s.end_date, f.pct, CAST(row_number() OVER (PARTITION BY s.region ORDER BY s.end_date ASC NULLS LAST, s.survey_id) AS INTEGER) AS place
FROM folded f JOIN surveys s ON s.survey_id = f.survey_id WHERE f.number = 1 AND f.option = 'Party 3'""", dates=("end_date",))
def poll_party_trend(spark, d):
    """One party's support in each region over time, undated surveys last."""
    own = folded(options(spark, d).where("number = 1")).where("option = 'Party 3'").join(surveys(spark, d), "survey_id")
    return ordering.top_per(own.select("region", "survey_id", "end_date", "pct"), ["region"], [F.asc_nulls_last("end_date"), F.asc("survey_id")], 1 << 30, "place")


@query(VIEWS + """,
own AS (SELECT s.region, s.survey_id, s.end_date, f.pct FROM folded f JOIN surveys s ON s.survey_id = f.survey_id WHERE f.number = 1 AND f.option = 'Party 3')
SELECT region, survey_id, pct, CAST(row_number() OVER (ORDER BY pct DESC, region) AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY end_date DESC, survey_id) AS r FROM own) WHERE r = 1""")
def poll_regional_distribution(spark, d):
    """One party's share in each region's latest survey that asked for it, highest first; the last window sees one row a region."""
    own = folded(options(spark, d).where("number = 1")).where("option = 'Party 3'").join(surveys(spark, d), "survey_id")
    latest = ordering.first_per(own, ["region"], [F.desc("end_date"), F.asc("survey_id")]).select("region", "survey_id", "pct")
    return latest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pct"), "region")))


@query(VIEWS + """
SELECT c.survey_id, s.region, r.option, r.pct, CAST(r.rank AS INTEGER) AS rank FROM chosen c JOIN ranked r ON r.survey_id = c.survey_id AND r.number = c.number
JOIN surveys s ON s.survey_id = c.survey_id WHERE s.election = '1-URGENT'""")
def poll_region_snapshot(spark, d):
    """Candidates of each survey's preferred question, ranked."""
    own = surveys(spark, d).where("election = '1-URGENT'").select("survey_id", "region")
    rows = options(spark, d).where("number IN (2, 3)").join(own, "survey_id")  # only the election's surveys go on
    kinds = titled(rows.select("survey_id", "number").distinct())
    picked = polls.first_question(kinds, "survey_id", "number", "kind", ["MATCHUP", "CANDIDATE_FIT"]).select("survey_id", "number")
    shares = polls.folded_options(rows.join(picked, ["survey_id", "number"], "left_semi"), ["survey_id", "number", "region"], "name", "pct", rules.party_name(F.col("name")))
    return polls.ranked_snapshot(shares, ["survey_id", "number"]).select("survey_id", "region", "option", "pct", "rank")


@query(VIEWS + """,
mine AS (SELECT r.*, s.region, s.end_date FROM chosen c JOIN ranked r ON r.survey_id = c.survey_id AND r.number = c.number JOIN surveys s ON s.survey_id = c.survey_id WHERE r.option <> 'undecided'),
newest AS (SELECT region, arg_max(survey_id, (end_date, -survey_id)) AS survey_id FROM mine GROUP BY 1),
picked AS (SELECT m.region, CASE WHEN max(CASE WHEN option = 'Party 2' THEN 1 ELSE 0 END) = 1 THEN 'Party 2' ELSE arg_min(option, rank) END AS candidate
  FROM mine m JOIN newest n ON n.region = m.region AND n.survey_id = m.survey_id GROUP BY 1)
SELECT m.region, m.survey_id, m.end_date, p.candidate, max(CASE WHEN m.option = p.candidate THEN m.pct END) AS own_pct, max(CASE WHEN m.option <> p.candidate THEN m.pct END) AS best_rival
FROM mine m JOIN picked p ON p.region = m.region GROUP BY 1, 2, 3, 4""", dates=("end_date",))  # fmt: skip
def poll_candidate_series(spark, d):
    """Each region's series of a candidate beside the best rival of the same survey; where the newest survey has no such candidate, of the one it puts first."""
    rows = options(spark, d).where("number IN (2, 3)")
    shares = folded(rows.join(first_question_per_survey(spark, d), ["survey_id", "number"], "left_semi"))
    mine = polls.ranked_snapshot(shares, ["survey_id", "number"]).where("option <> 'undecided'").join(surveys(spark, d).drop("election"), "survey_id")
    return polls.candidate_series(mine, "region", "survey_id", "end_date", "Party 2")


@query(VIEWS + """
SELECT survey_id, max(CASE WHEN rank = 1 THEN pct END) AS lead, coalesce(max(CASE WHEN rank = 2 THEN pct END), 0) AS second,
       greatest(0, 100 - max(CASE WHEN rank = 1 THEN pct END) - coalesce(max(CASE WHEN rank = 2 THEN pct END), 0)) AS other
FROM ranked WHERE number = 1 GROUP BY 1""")
def lead_second_other(spark, d):
    return polls.lead_second_other(folded(options(spark, d).where("number = 1")), ["survey_id"])


@query(VIEWS + """,
top AS (SELECT s.region, s.survey_id, s.end_date, max(CASE WHEN rank = 1 THEN pct END) AS lead, coalesce(max(CASE WHEN rank = 2 THEN pct END), 0) AS second, count(*) AS sample
  FROM ranked r JOIN surveys s ON s.survey_id = r.survey_id WHERE r.number = 1 GROUP BY 1, 2, 3),
newest AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY end_date DESC, survey_id) AS r, count(*) OVER (PARTITION BY region) AS surveys FROM top)
SELECT region, survey_id, lead, second, greatest(0, 100 - lead - second) AS other, sample, surveys FROM newest WHERE r = 1""")
def district_poll_summary(spark, d):
    """Each region's newest survey: first and second share, the rest, its sample size, and how many surveys the region has."""
    shares = folded(options(spark, d).where("number = 1"))
    top = polls.lead_second_other(shares, ["survey_id"]).join(shares.groupBy("survey_id").agg(F.count("*").alias("sample")), "survey_id").join(surveys(spark, d), "survey_id")
    counts = top.groupBy("region").agg(F.count("*").alias("surveys"))
    newest = ordering.first_per(top, ["region"], [F.desc("end_date"), F.asc("survey_id")])
    return newest.join(counts, "region").select("region", "survey_id", "lead", "second", "other", "sample", "surveys")


@query(VIEWS + """,
own AS (SELECT a.survey_id, s.region, s.end_date, a.option AS leader, a.pct AS leader_pct FROM decided a JOIN surveys s ON s.survey_id = a.survey_id WHERE a.number = 1 AND a.place = 1 AND s.election = '2-HIGH')
SELECT region, survey_id, end_date, leader, leader_pct, CAST(row_number() OVER (PARTITION BY region ORDER BY end_date DESC, survey_id) AS INTEGER) AS newest,
       CAST(row_number() OVER (PARTITION BY region ORDER BY end_date ASC NULLS LAST, survey_id) AS INTEGER) AS in_trend FROM own""", dates=("end_date",))  # fmt: skip
def poll_overview_lists(spark, d):
    """An election's surveys with their leading party, as the two lists of a region's overview: newest first, and by date for the trend."""
    own = surveys(spark, d).where("election = '2-HIGH'")
    rows = options(spark, d).where("number = 1").join(own, "survey_id", "left_semi")
    led = polls.leaders(folded(rows), ["survey_id"]).join(own, "survey_id").select("region", "survey_id", "end_date", "leader", "leader_pct")
    newest = Window.partitionBy("region").orderBy(F.desc("end_date"), "survey_id")
    return led.withColumns({"newest": F.row_number().over(newest), "in_trend": F.row_number().over(Window.partitionBy("region").orderBy(F.asc_nulls_last("end_date"), "survey_id"))})


@query(VIEWS + """
SELECT survey_id, end_date FROM surveys WHERE end_date >= (SELECT max(end_date) FROM surveys) - INTERVAL 3 MONTH""", dates=("end_date",))
def trend_window_months(spark, d):
    return polls.trend_window(surveys(spark, d), "end_date", 3).select("survey_id", "end_date")


@query(VIEWS + """
SELECT DISTINCT s.region, f.option FROM folded f JOIN surveys s ON s.survey_id = f.survey_id WHERE f.number = 1 AND f.option <> 'undecided'""")
def names_over_trend(spark, d):
    """Distinct party names by region."""
    named = folded(options(spark, d).where("number = 1")).where("option <> 'undecided'")
    return named.join(surveys(spark, d), "survey_id").select("region", "option").distinct()


@query(VIEWS + """
SELECT option, round(sum(pct), 4) AS pct, count(*) AS n FROM folded WHERE number = 1 GROUP BY 1""")
def party_reaggregation(spark, d):
    """Snapshots summed once more by party."""
    return folded(options(spark, d).where("number = 1")).groupBy("option").agg(F.round(F.sum("pct"), 4).alias("pct"), F.count("*").alias("n"))
