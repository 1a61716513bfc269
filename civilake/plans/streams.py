"""Queries that run streams to their end over landed changes, in several runs, and read what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.operators import ordering
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.session import table, work_path
from civilake.streaming import changes, state

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles

#: So many times rows land and the stream runs, each time from where it stopped.
RUNS = 2


def landed_in_runs(rows: DataFrame, order: str, schema: str, name: str, stream_of) -> DataFrame:
    """Land rows in ``RUNS`` parts of their order, and run the stream ``stream_of`` makes of what has landed after each part."""
    spark = rows.sparkSession
    landed, out, checkpoint = (work_path(spark, f"{name}-{part}") for part in ("landed", "out", "checkpoint"))
    last = rows.agg(F.max(order)).first()[0] or 0
    for run in range(RUNS):
        low, high = (last * r // RUNS + 3 for r in (run, run + 1))  # not where a transaction ends
        part = rows.where(F.col(order) <= high) if run == 0 else rows.where(F.col(order) > low)
        (part if run == RUNS - 1 else part.where(F.col(order) <= high)).write.mode("append").json(landed)
        found = state.run_available(stream_of(spark.readStream.schema(schema).json(landed)), out, checkpoint)
    return found


# The dictionary of the watched tables, as the log numbers their columns.
COLUMNS = (("RepresentativeProposer", ("id", "member")), ("Bill", ("id", "stage", "bill_result")), ("Congressman", ("id", "party_id")))


def binary_log(spark, d: str) -> DataFrame:
    """Rows of a database's log: of every five events a transaction, with its tables' numbers, a row a change, and a commit, an abort or no end."""
    rows = events(spark, d).withColumns({"t": F.expr("event_id div 5"), "at": F.col("event_id") % 5, "v": F.floor("value").cast("bigint")})
    txn = F.concat(F.lit("x"), F.col("t"))
    number = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 9).otherwise(2).cast("bigint")
    text = lambda *values: F.array(*(F.lit(v).cast("string") if not isinstance(v, Column) else v.cast("string") for v in values))
    user, v = F.col("user_id"), F.col("v")
    kind = F.when(number == 1, "write").otherwise("update")
    before = F.when(number == 2, text(user, v % 3, "-")).when(number == 3, text(user, v % 2)).when(number == 9, text(user))
    after = F.when(number == 1, text(user, v)).when(number == 2, text(user, v % 4, v % 2)).when(number == 3, text(user, v % 3)).otherwise(text(user))
    none = F.lit(None)
    made = [rows.select(txn.alias("txn"), (F.col("t") * 100 + 10 + F.col("at")).alias("seq"), kind.alias("kind"), "ts", number.alias("table_id"), none.cast("string").alias("table"), before.alias("before"), after.alias("after"))]
    firsts = rows.groupBy("t").agg(F.min("ts").alias("ts"), F.max("ts").alias("last")).withColumn("txn", txn)
    nothing = none.cast("array<string>")
    for number_, name in ((1, "representativeproposer"), (2, "bill"), (3, "congressman"), (9, "other")):
        made.append(firsts.select("txn", (F.col("t") * 100 + number_).alias("seq"), F.lit("map").alias("kind"), "ts", F.lit(number_).cast("bigint").alias("table_id"), F.lit(name).alias("table"), nothing.alias("before"), nothing.alias("after")))
    end = F.when(F.col("t") % 7 == 3, "abort").otherwise("commit")
    made.append(firsts.where("t % 7 <> 5").select("txn", (F.col("t") * 100 + 99).alias("seq"), end.alias("kind"), F.col("last").alias("ts"), none.cast("bigint").alias("table_id"), none.cast("string").alias("table"), nothing.alias("before"), nothing.alias("after")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS v, event_id // 5 AS t FROM events WHERE (event_id // 5) % 7 NOT IN (3, 5)),
c AS (SELECT t, user_id, 'RP_INSERT' AS event, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM e WHERE event_type = 'signup'
  UNION ALL SELECT t, user_id, 'BILL_STAGE_UPDATE', CAST(v % 3 AS VARCHAR), CAST(v % 4 AS VARCHAR) FROM e WHERE event_type IN ('view', 'click') AND v % 3 <> v % 4
  UNION ALL SELECT t, user_id, 'BILL_RESULT_UPDATE', '-', CAST(v % 2 AS VARCHAR) FROM e WHERE event_type IN ('view', 'click')
  UNION ALL SELECT t, user_id, 'CONGRESSMAN_PARTY_UPDATE', CAST(v % 2 AS VARCHAR), CAST(v % 3 AS VARCHAR) FROM e WHERE event_type = 'purchase' AND v % 2 <> v % 3)
SELECT 'x' || t AS txn_id, event, CAST(user_id AS VARCHAR) AS target, before, after FROM c""")
def committed_changes(spark, d):
    """Watched changes of committed transactions alone; transactions are cut by a restart, aborted, or never end."""
    found = landed_in_runs(binary_log(spark, d), "seq", state.LOG, "log", state.committed)
    names = spark.createDataFrame([(t, i, c) for t, cols in COLUMNS for i, c in enumerate(cols)], "table string, ordinal int, name string")
    exact = names.select("table").distinct().withColumnRenamed("table", "exact")  # the log writes names in lower case
    named = state.by_name(found, names).join(F.broadcast(exact), F.col("table") == F.lower("exact")).withColumn("table", F.col("exact"))
    return changes.watched(named, "id")


@query("""
WITH likes AS (SELECT user_id, 8 AS w FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 1000),
views AS (SELECT user_id, 2 AS w FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 3000)
SELECT CAST(user_id AS VARCHAR) AS item, CAST(sum(w) AS BIGINT) AS score FROM (SELECT * FROM likes UNION ALL SELECT * FROM views) GROUP BY 1 ORDER BY score DESC, item LIMIT 10""")
def popularity_stream(spark, d):
    """The most popular, kept by queues of the last likes and views; only counts that change are handed on."""
    rows = events(spark, d).select(F.col("event_type").alias("queue"), F.col("event_id").alias("number"), F.col("user_id").cast("string").alias("item"))
    moved = landed_in_runs(rows, "number", "queue string, number bigint, item string", "popularity", lambda s: state.queue_changes(s, {"purchase": 1000, "view": 3000}))
    return state.popularity(moved, {"purchase": 8, "view": 2}, 10)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place FROM events)
SELECT event_type AS service, count(*) AS total_calls, count(*) FILTER (place <= 1000 AND user_id % 5 <> 0) AS success, count(*) FILTER (place <= 1000 AND user_id % 5 = 0) AS failure,
       round(avg(value) FILTER (place <= 1000), 4) AS mean, least(100, count(*) FILTER (value > 30)) AS slow FROM r GROUP BY 1""")
def monitor_stream(spark, d):
    """Every service's figures over its last calls, as the stream's last micro-batch leaves them."""
    rows = events(spark, d).select(F.col("event_type").alias("service"), F.col("event_id").alias("number"), F.col("value").alias("millis"), (F.col("user_id") % 5 != 0).alias("ok"))
    said = landed_in_runs(rows, "number", "service string, number bigint, millis double, ok boolean", "monitor", lambda s: state.monitored(s, 1000, 30, 100))
    last = said.groupBy("service").agg(F.max_by(F.struct(*[c for c in said.columns if c != "service"]), "total_calls").alias("x"))
    return last.select("service", "x.*").withColumn("mean", F.round("mean", 4))


STATES = [*state.OPEN, *state.ENDED, "PAUSED"]


@query(f"""
WITH e AS (SELECT event_id % 97 AS job, event_id AS number, CAST(ts AS TIMESTAMP) AS ts, {STATES}[1 + (event_id // 97 + CAST(floor(value) AS BIGINT)) % {len(STATES)}] AS state FROM events),
p AS (SELECT *, CASE WHEN list_position({list(state.OPEN)}, state) > 0 THEN list_position({list(state.OPEN)}, state) WHEN state = 'PAUSED' THEN 0 ELSE 9 END AS place, min(ts) OVER (PARTITION BY job) + INTERVAL 10 DAY AS deadline FROM e),
m AS (SELECT *, coalesce(max(place) OVER (PARTITION BY job ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE ts < deadline),
g AS (SELECT job, arg_max(state, place) AS state, min(ts) AS created, max(CASE WHEN place = 9 THEN ts END) AS completed, max(place) AS place FROM m WHERE place > before GROUP BY 1),
j AS (SELECT job, min(deadline) AS deadline FROM p GROUP BY 1)
SELECT j.job, CASE WHEN g.place = 9 THEN g.state ELSE 'EXPIRED' END AS state, date_trunc('second', coalesce(g.created, j.deadline)) AS created_at, date_trunc('second', CASE WHEN g.place = 9 THEN g.completed ELSE j.deadline END) AS completed_at
FROM j LEFT JOIN g USING (job)""", dates=("created_at", "completed_at"))
def job_states_stream(spark, d):
    """Jobs after all that was said of them: moves forward alone count, and a job without an end expires at its deadline."""
    said = F.element_at(F.array(*map(F.lit, STATES)), (1 + (F.expr("event_id div 97") + F.floor("value")) % len(STATES)).cast("int"))
    rows = events(spark, d).select((F.col("event_id") % 97).alias("job"), F.col("event_id").alias("number"), said.alias("state"), "ts")
    moves = landed_in_runs(rows, "number", "job bigint, number bigint, state string, ts timestamp", "jobs", lambda s: state.job_moves(s, 10 * 86_400_000))
    return state.jobs_now(moves).withColumns({c: F.date_trunc("second", c) for c in ("created_at", "completed_at")})


@query("""
WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS provider, o_orderdate AS created, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rank FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT job_id, provider, CAST(rank AS INTEGER) AS rank FROM j WHERE rank <= 10""")
def jobs_to_poll(spark, d):
    """The ten oldest open jobs of every provider."""
    jobs = table(spark, d, "orders").where("o_orderstatus IN ('O', 'P')").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("created"))
    return ordering.top_per(jobs, ["provider"], [F.asc("created"), F.asc("job_id")], 10).drop("created")


@query("SELECT DISTINCT l_partkey AS id, l_partkey % 13 AS page FROM lineitem")
def resumed_stream(spark, d):
    """Ids of list pages that overlap, each once, from a crawl that is stopped and goes on."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_partkey") % 13).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return landed_in_runs(rows, "place", "id bigint, page bigint, place bigint", "list", lambda s: state.first_seen(s.select("id", "page"), "id"))
