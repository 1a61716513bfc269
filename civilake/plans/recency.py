"""Queries on recency, order and shares: first and last rows, bounded queues, round robin, monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civilake.operators import aggregates, joins, ordering
from civilake.plans.registry import Registry
from civilake.session import table, work_path

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def keep_last(spark, d):
    """The last row of each key, as one aggregate instead of a sort."""
    last = F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x")
    return events(spark, d).groupBy("user_id").agg(last).select("user_id", "x.event_id", "x.event_type")


@query("""
SELECT p_name AS name, p_partkey AS part_id, p_brand AS brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1""")
def keep_first(spark, d):
    first = F.min_by(F.struct("p_partkey", "p_brand"), "p_partkey").alias("x")
    found = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(first)
    return found.select("name", F.col("x.p_partkey").alias("part_id"), F.col("x.p_brand").alias("brand"))


@query("""
WITH likes AS (SELECT user_id, 8 AS w FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 1000),
views AS (SELECT user_id, 2 AS w FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 3000)
SELECT user_id, CAST(sum(w) AS BIGINT) AS score FROM (SELECT * FROM likes UNION ALL SELECT * FROM views) GROUP BY 1 ORDER BY score DESC, user_id LIMIT 10""")
def popularity_weighted(spark, d):
    """The ten most popular: eight for each of the last 1,000 likes, two for each of the last 3,000 views."""
    kinds = {"purchase": ("event_type", 1000, 8), "view": ("event_type", 3000, 2)}
    return aggregates.weighted_recent(events(spark, d), "user_id", [F.desc("event_id")], kinds, 10)


@query("""
WITH last AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000)
SELECT count(*) AS calls, round(avg(value), 4) AS mean_value, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 4) AS success,
       count(*) FILTER (value > 30) AS slow FROM last""")
def recent_call_stats(spark, d):
    """The monitor's figures over the last 1,000 calls."""
    last = events(spark, d).orderBy(F.desc("event_id")).limit(1000)
    ok = F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)
    return last.agg(F.count("*").alias("calls"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.avg(ok), 4).alias("success"), F.count_if(F.col("value") > 30).alias("slow"))


@query("""
SELECT event_id, user_id, count(*) OVER w AS calls, round(sum(value) OVER w, 4) AS total FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def sliding_call_stats(spark, d):
    """Count and sum over each user's last ten events, at every event."""
    window = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return events(spark, d).select("event_id", "user_id", F.count("*").over(window).alias("calls"), F.round(F.sum("value").over(window), 4).alias("total"))


@query("""
WITH q AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn,
  CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 0 WHEN 'error' THEN 1 END AS seat FROM events WHERE event_type IN ('view', 'click', 'error'))
SELECT event_id, event_type, CAST(turn AS INTEGER) AS turn, CAST(seat AS INTEGER) AS seat FROM q ORDER BY turn, seat LIMIT 25""")
def fair_round_robin(spark, d):
    """Three queues in turn, beginning with the second."""
    rows = events(spark, d).select("event_id", "event_type")
    return ordering.fair_merge(rows, "event_type", [F.asc("event_id")], ["view", "click", "error"], 1, 25)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, event_type AS mode, round(n / total, 6) AS confidence, CAST(total AS BIGINT) AS total FROM r WHERE r = 1""")
def modal_confidence(spark, d):
    return aggregates.modal(events(spark, d), ["user_id"], "event_type").withColumn("confidence", F.round("confidence", 6))


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, round(100.0 * sum(n) OVER (ORDER BY n DESC, event_type) / sum(n) OVER (), 4) AS cumulative FROM c""")
def cum_share(spark, d):
    """Running percentage over the kinds, largest first."""
    counts = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("last", -F.col("n"))
    running = ordering.running_totals(counts, ["last", "event_type"], "n", work_path(spark, "shares"))
    total = counts.agg(F.sum("n").alias("total"))
    return running.join(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("running") / F.col("total"), 4).alias("cumulative"))  # one row


@query("""
WITH s AS (SELECT o_orderkey AS file, o_orderdate AS made, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders),
r AS (SELECT file, sum(bytes) OVER (ORDER BY made DESC, file DESC) AS running FROM s)
SELECT file, CAST(running AS BIGINT) AS running, running <= (SELECT sum(bytes) // 3 FROM s) AS kept FROM r""")
def dump_rotation(spark, d):
    """Which dumps stay when the oldest go until the rest fit in a third of the room, with the running size from the newest on."""
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"), (-F.col("o_orderkey")).alias("tie"), F.floor("o_totalprice").cast("bigint").alias("bytes"))
    room = files.agg(F.expr("sum(bytes) div 3").alias("room"))
    running = ordering.running_totals(files, ["age", "tie"], "bytes", work_path(spark, "dumps"))
    return running.join(F.broadcast(room)).select("file", "running", (F.col("running") <= F.col("room")).alias("kept"))  # one row


@query("""
SELECT l_orderkey AS bill_id, l_linenumber AS line FROM (
  SELECT *, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS confirmed FROM lineitem) WHERE l_returnflag = 'A' OR confirmed = 0""")
def confirmed_fallback(spark, d):
    """Confirmed rows of each group, or all of them if none is confirmed."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return joins.preferred_or_all(rows, ["bill_id"], F.col("l_returnflag") == "A").drop("l_returnflag")


@query("""
WITH k AS (SELECT user_id, event_type || '-' || CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS word, max(event_id) AS touched FROM events GROUP BY 1, 2)
SELECT user_id, word, touched, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY touched DESC, word) AS rank FROM k) WHERE rank <= 10""")
def recent_keywords(spark, d):
    """Each user's ten distinct keywords touched last."""
    word = F.concat_ws("-", "event_type", F.floor("value") % 5)
    touched = events(spark, d).groupBy("user_id", word.alias("word")).agg(F.max("event_id").alias("touched"))
    return ordering.top_per(touched, ["user_id"], [F.desc("touched"), F.asc("word")], 10)


@query("""
SELECT * FROM (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM events WHERE event_type = 'error') WHERE rank <= 3""")
def top_unread(spark, d):
    """Three newest unread notifications of every user."""
    unread = events(spark, d).where("event_type = 'error'").select("user_id", "event_id", "value")
    return ordering.top_per(unread, ["user_id"], [F.desc("event_id")], 3)


@query("""
SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, event_type, count(*) AS calls, count(*) > 0.8 * 2500 AS near_budget FROM events GROUP BY 1, 2""")
def monthly_calls(spark, d):
    """Calls of each month against a budget, with its 80 % warning."""
    counts = events(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("calls"))
    return counts.withColumn("near_budget", F.col("calls") > 0.8 * 2500)


@query("SELECT event_id, user_id, value FROM events WHERE value > 30")
def slow_calls(spark, d):
    return events(spark, d).where("value > 30").select("event_id", "user_id", "value")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1, 2""", dates=("day",))
def day_loop_scan(spark, d):
    """One grouped pass instead of a request for each day."""
    day = F.col("ts").cast("date").alias("day")
    return events(spark, d).groupBy("user_id", day).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"))


@query("""
WITH RECURSIVE w AS (SELECT l_orderkey AS page, CAST(l_partkey % 12 AS BIGINT) AS y, l_linenumber AS x, CAST(l_suppkey AS VARCHAR) AS word,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 12, l_linenumber, CAST(l_suppkey AS VARCHAR)) AS n FROM lineitem),
f AS (SELECT page, n, y AS first_y, 0 AS line_no, word FROM w WHERE n = 1 UNION ALL
  SELECT w.page, w.n, CASE WHEN abs(w.y - f.first_y) > 3 THEN w.y ELSE f.first_y END, CASE WHEN abs(w.y - f.first_y) > 3 THEN f.line_no + 1 ELSE f.line_no END, w.word
  FROM f JOIN w ON w.page = f.page AND w.n = f.n + 1)
SELECT page, CAST(line_no AS INTEGER) AS line_no, string_agg(word, ' ' ORDER BY n) AS line FROM f GROUP BY 1, 2""")
def line_rebuild(spark, d):
    """The text lines of each page from its words' places."""
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 12).alias("y"), F.col("l_linenumber").alias("x"), F.col("l_suppkey").alias("word"))
    return ordering.lines_of(words, "page", "x", "y", "word")


@query("""
WITH w AS (SELECT l_orderkey AS page, CAST(l_partkey * 100 + l_linenumber AS BIGINT) AS word, l_quantity AS x FROM lineitem),
g AS (SELECT *, x - lag(x) OVER (PARTITION BY page ORDER BY x, word) AS gap, row_number() OVER (PARTITION BY page ORDER BY x, word) AS spot, count(*) OVER (PARTITION BY page) AS n FROM w),
c AS (SELECT *, CASE WHEN gap > 10 AND row_number() OVER (PARTITION BY page ORDER BY gap DESC NULLS LAST, x, word) <= 2 THEN 1 ELSE 0 END AS cut FROM g),
s AS (SELECT *, sum(cut) OVER (PARTITION BY page) AS cuts, sum(cut) OVER (PARTITION BY page ORDER BY x, word ROWS UNBOUNDED PRECEDING) AS before FROM c)
SELECT page, word, CAST(CASE WHEN n <= 3 THEN spot - 1 ELSE before END AS BIGINT) AS cluster FROM s WHERE n <= 3 OR cuts = 2""")
def gap_cluster(spark, d):
    """Words of each page cut into three clusters at the two largest gaps over 10; no cluster where there are fewer such gaps."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("word"), F.col("l_quantity").alias("x"))
    return ordering.gap_clusters(rows, ["page"], "x", "word", 3, 10.0).drop("x")
