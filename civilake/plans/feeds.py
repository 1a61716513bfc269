"""Bill feeds and details over the fixture analogue: orders are bills, suppliers are members, nations are parties, a customer's purchases are likes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilake.operators import aggregates, joins, ordering
from civilake.plans.registry import Registry
from civilake.session import table

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles

#: The user whose likes a feed shows.
READER = 8


def likes(spark: SparkSession, d: str) -> DataFrame:
    """``bill_id, user_id`` of every like."""
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("bill_id"), "user_id")


def proposers(spark: SparkSession, d: str, wanted: Column | None = None) -> DataFrame:
    """``bill_id, representatives, others``: a bill's proposers with their parties as ``member/party``, each once, by name. ``wanted`` reaches the scan of the lines."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("member_id"), (F.col("l_linenumber") == 1).alias("first"))
    lines = (lines if wanted is None else lines.where(wanted)).groupBy("bill_id", "member_id").agg(F.max("first").alias("first"))
    member = table(spark, d, "supplier").select(F.col("s_suppkey").alias("member_id"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    named = lines.join(member, "member_id").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    listed = lambda own: F.array_join(F.array_sort(F.collect_list(F.when(own, F.concat_ws("/", "s_name", "n_name")))), ",")  # noqa: E731  one bill's proposers
    return named.groupBy("bill_id").agg(listed(F.col("first")).alias("representatives"), listed(~F.col("first")).alias("others"))


PROPOSERS_SQL = """
p AS (SELECT l_orderkey AS bill_id, l_suppkey, max(l_linenumber = 1) AS first FROM lineitem GROUP BY 1, 2),
n AS (SELECT bill_id, first, s_name || '/' || n_name AS name FROM p JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
g AS (SELECT bill_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (first), '') AS representatives, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT first), '') AS others FROM n GROUP BY 1)"""


@query(f"""
WITH shown AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20), {PROPOSERS_SQL.strip()}
SELECT s.o_orderkey AS bill_id, CAST(CAST(s.o_orderdate AS DATE) AS VARCHAR) AS propose_date, coalesce(g.representatives, '') AS representatives, coalesce(g.others, '') AS others,
       s.o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id = {READER}) AS liked, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') <= 40 AS is_last_page
FROM shown s LEFT JOIN g ON g.bill_id = s.o_orderkey""")
def main_feed_page(spark: SparkSession, d: str, size: int = 20, number: int = 1) -> DataFrame:
    """One page of open bills, newest first, with proposers, parties, whether the reader likes them, and whether it is the last.

    The page itself, ``size`` rows, is fetched first, so that its keys reach the scans of the large tables as a list.
    """
    open_bills = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("bill_id"), "o_orderdate")
    shown = ordering.page(open_bills, [F.desc("o_orderdate"), F.desc("bill_id")], number, size)
    rows = shown.select("bill_id", F.col("o_orderdate").cast("date").cast("string").alias("propose_date"), "is_last_page").collect()  # a page
    keys = [r["bill_id"] for r in rows]
    page = spark.createDataFrame(rows, "bill_id bigint, propose_date string, is_last_page boolean")
    own = likes(spark, d).where((F.col("user_id") == READER) & F.col("bill_id").isin(keys))
    told = joins.exists_flag(page, own, ["bill_id"], "liked").join(proposers(spark, d, F.col("bill_id").isin(keys)), "bill_id", "left")
    return told.select("bill_id", "propose_date", F.coalesce("representatives", F.lit("")).alias("representatives"), F.coalesce("others", F.lit("")).alias("others"), "liked", "is_last_page")


@query(f"""
WITH {PROPOSERS_SQL.strip()},
v AS (SELECT l_orderkey AS bill_id, n_name, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag <> 'A') AS no FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
vp AS (SELECT bill_id, string_agg(n_name || '=' || yes || ':' || no, ',' ORDER BY n_name) AS votes FROM v GROUP BY 1),
s AS (SELECT a.o_orderkey AS bill_id, string_agg(CAST(b.o_orderkey AS VARCHAR), ',' ORDER BY b.o_orderkey) AS similar FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey AND b.o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey AS bill_id, o_orderstatus AS stage, coalesce(g.representatives, '') AS representatives, coalesce(g.others, '') AS others, coalesce(vp.votes, '') AS votes, coalesce(s.similar, '') AS similar,
       o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id = {READER}) AS liked
FROM orders LEFT JOIN g ON g.bill_id = o_orderkey LEFT JOIN vp ON vp.bill_id = o_orderkey LEFT JOIN s ON s.bill_id = o_orderkey""")
def bill_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every bill as a detail page shows it: proposers with parties, votes of each party for and against, finished bills of the same name, and whether the reader likes it."""
    bills = table(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("stage"))
    member = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    votes = table(spark, d, "lineitem").join(member, "l_suppkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    yes = F.col("l_returnflag") == "A"
    votes = votes.groupBy(F.col("l_orderkey").alias("bill_id"), "n_name").agg(F.count_if(yes).alias("yes"), F.count_if(~yes).alias("no"))
    said = F.concat(F.col("n_name"), F.lit("="), F.col("yes"), F.lit(":"), F.col("no"))
    votes = votes.groupBy("bill_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_name", said.alias("said"))))["said"], ",").alias("votes"))  # a bill's parties
    # All finished bills of a name are listed once; each bill leaves itself out of its list.
    same = bills.where("stage = 'F'").groupBy("owner", "kind").agg(F.sort_array(F.collect_list("bill_id")).alias("same"))
    joined = bills.join(proposers(spark, d), "bill_id", "left").join(votes, "bill_id", "left").join(same, ["owner", "kind"], "left")
    told = joins.exists_flag(joined, likes(spark, d).where(F.col("user_id") == READER), ["bill_id"], "liked")
    others = F.array_join(F.array_remove("same", F.col("bill_id")).cast("array<string>"), ",")
    text = lambda c: F.coalesce(c, F.lit(""))
    return told.select("bill_id", "stage", text("representatives").alias("representatives"), text("others").alias("others"), text("votes").alias("votes"), text(others).alias("similar"), "liked")


@query("""
WITH l AS (SELECT event_id * 7 % 1000 AS bill_id, 8 AS w FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 1000), v AS (SELECT event_id * 7 % 1000 AS bill_id, 2 AS w FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 3000),
s AS (SELECT bill_id, CAST(sum(w) AS BIGINT) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY 1)
SELECT bill_id, score, o_orderstatus AS stage, o_orderpriority AS kind, CAST(row_number() OVER (ORDER BY score DESC, bill_id) AS INTEGER) AS place FROM s JOIN orders ON o_orderkey = bill_id ORDER BY score DESC, bill_id LIMIT 10""")
def popular_bills(spark: SparkSession, d: str) -> DataFrame:
    """The ten most popular bills that there are, in order: eight for each of the last 1,000 likes, two for each of the last 3,000 views."""
    rows = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") * 7 % 1000).alias("bill_id"))
    kinds = {"purchase": ("event_type", 1000, 8), "view": ("event_type", 3000, 2)}
    bills = table(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("kind"))
    scored = aggregates.weighted_recent(rows, "bill_id", [F.desc("event_id")], kinds, 4000)  # no more than both queues hold
    found = bills.join(F.broadcast(scored), "bill_id").withColumn("all", F.lit(1))
    return ordering.top_per(found, ["all"], [F.desc("score"), F.asc("bill_id")], 10, "place").select("bill_id", "score", "stage", "kind", "place")
