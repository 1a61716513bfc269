"""Incremental queries: upserts, child replacement, checkpoints, key creation, stage and job folds, change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from civilake.functions.bills import stage_order
from civilake.operators import joins, merge
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.plans.relational import bills, members, proposals
from civilake.session import table, work_path
from civilake.sinks import versions

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


@query("""
WITH old AS (SELECT o_orderkey AS bill_id, o_orderstatus AS stage, o_orderpriority AS summary, 7 AS views FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS bill_id, 'N' AS stage, CASE WHEN o_orderkey % 2 = 0 THEN 'new' END AS summary FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(old.bill_id, new.bill_id) AS bill_id, CASE WHEN new.bill_id IS NOT NULL THEN new.stage ELSE old.stage END AS stage,
       coalesce(new.summary, old.summary) AS summary, coalesce(old.views, 0) AS views FROM old FULL JOIN new ON old.bill_id = new.bill_id""")
def upsert_bills(spark, d):
    """Stage is overwritten, the summary kept where the new one is null, the view count set only on insert."""
    b = bills(spark, d)
    old = b.where("bill_id % 3 <> 0").select("bill_id", "stage", F.col("kind").alias("summary"), F.lit(7).alias("views"))
    new = b.where("bill_id % 5 <> 0").select("bill_id", F.lit("N").alias("stage"), F.when(F.col("bill_id") % 2 == 0, "new").alias("summary"))
    return merge.upsert(old, new, ["bill_id"], overwrite=("stage",), fill=("summary",), on_insert={"views": F.lit(0)})


@query("""
SELECT l_orderkey AS bill_id, l_suppkey AS member_id, l_linenumber AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)
UNION ALL SELECT o_orderkey, o_custkey % 10, 1 FROM orders WHERE o_orderkey % 7 = 0""")
def replace_children(spark, d):
    new = bills(spark, d).where("bill_id % 7 = 0").select("bill_id", (F.col("user_id") % 10).alias("member_id"), F.lit(1).alias("line"))
    return merge.replace_children(proposals(spark, d), new, "bill_id")


@query("""
SELECT s.s_suppkey AS member_id, coalesce(CASE WHEN s.s_suppkey % 2 = 0 THEN 'x' || n.n_name END, s.s_name) AS member, coalesce(CASE WHEN s.s_suppkey % 3 = 0 THEN 0.0 END, s.s_acctbal) AS balance
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def partial_update(spark, d):
    """Each column takes the new value unless it is null."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("party_id"), "n_name")
    own = members(spark, d)
    new = own.join(nation, "party_id").select(
        "member_id", F.when(F.col("member_id") % 2 == 0, F.concat(F.lit("x"), "n_name")).alias("member"), F.when(F.col("member_id") % 3 == 0, 0.0).alias("balance")
    )
    return merge.upsert(own.select("member_id", "member", "balance"), new, ["member_id"], fill=("member", "balance"))


@query("""
WITH old AS (SELECT p_brand AS name, count(*) AS n, min(p_partkey) AS first_seen, max(p_partkey) AS last_seen FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
new AS (SELECT p_brand AS name, count(*) AS n, min(p_partkey) AS first_seen, max_by(p_size, p_partkey) AS last_seen FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT coalesce(old.name, new.name) AS name, coalesce(old.n, 0) + coalesce(new.n, 0) AS n, coalesce(old.first_seen, new.first_seen) AS first_seen,
       CAST(coalesce(new.last_seen, old.last_seen) AS BIGINT) AS last_seen FROM old FULL JOIN new ON old.name = new.name""")
def catalog_upsert(spark, d):
    """Counts add up, the first sighting stays, the last is the one written last (not the largest)."""
    part = table(spark, d, "part")
    named = lambda rows, last: rows.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen"), last.cast("bigint").alias("last_seen"))
    old = named(part.where("p_partkey % 2 = 0"), F.max("p_partkey"))
    new = named(part.where("p_partkey % 2 = 1"), F.max_by("p_size", "p_partkey"))
    merged = merge.upsert(old, new, ["name"], fill=("last_seen",), on_insert={"n": F.lit(0).cast("bigint")})
    more = new.select("name", F.col("n").alias("more"))
    return merged.join(more, "name", "left").select("name", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "first_seen", "last_seen")


@query("""
SELECT event_type AS source, CAST(greatest(max(event_id), max(CASE WHEN event_id % 2 = 0 THEN event_id END)) AS BIGINT) AS reference,
       '{"rows":' || CAST(count(*) FILTER (event_id % 2 = 1) AS VARCHAR) || '}' AS metadata FROM events GROUP BY 1""")
def checkpoint_advance(spark, d):
    """A checkpoint of each source moves to the largest reference seen, with metadata of the run."""
    rows = events(spark, d)
    old = rows.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("source")).agg(F.max("event_id").alias("reference")).withColumn("metadata", F.lit("{}"))
    run = rows.where("event_id % 2 = 1").groupBy(F.col("event_type").alias("source")).agg(F.max("event_id").alias("reference"), F.count("*").alias("rows"))
    run = run.select("source", "reference", F.to_json(F.struct("rows")).alias("metadata"))
    ahead = run.join(old.select("source", F.col("reference").alias("was")), "source", "left")
    ahead = ahead.select("source", F.greatest("reference", F.coalesce("was", "reference")).alias("reference"), "metadata")
    return merge.upsert(old, ahead, ["source"], fill=("reference", "metadata"))


@query("""
WITH known AS (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS key FROM nation WHERE n_nationkey < 20), wanted AS (SELECT DISTINCT n_name AS name FROM nation)
SELECT w.name, k.key, false AS created FROM wanted w JOIN known k ON k.name = w.name UNION ALL
SELECT name, (SELECT max(key) FROM known) + row_number() OVER (ORDER BY name), true FROM wanted WHERE name NOT IN (SELECT name FROM known)""")
def resolve_or_create_keys(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("key"))
    return joins.resolve_or_create(names.select("name"), names.where("key < 20"), "name", "key")


@query("""
WITH t AS (SELECT p_name AS name, p_brand AS brand, p_partkey AS code FROM part WHERE p_partkey % 2 = 0),
x AS (SELECT name, brand, min(code) AS code FROM t GROUP BY 1, 2), r AS (SELECT name, min(code) AS code FROM t GROUP BY 1)
SELECT p.p_partkey AS id, coalesce(x.code, r.code) AS code FROM part p LEFT JOIN x ON x.name = p.p_name AND x.brand = p.p_brand LEFT JOIN r ON r.name = p.p_name WHERE p.p_partkey % 2 = 1""")
def relaxed_lookup(spark, d):
    """A code by name and brand, or else by name alone; the first of several."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    codes = part.where("id % 2 = 0").select("name", "brand", F.col("id").alias("code"), F.col("id").alias("ordinal"))
    return joins.relaxed_lookup(part.where("id % 2 = 1"), codes, ["name", "brand"], ["name"], "code", "ordinal").select("id", "code")


@query("""
SELECT o_orderkey AS bill_id, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'E' || o_orderstatus END, o_orderstatus) AS stage, coalesce(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN 'better' END, o_orderpriority) AS kind FROM orders""")
def enrich_coalesce(spark, d):
    rows = bills(spark, d).select("bill_id", "stage", "kind")
    some = rows.where("bill_id % 4 = 0")
    better = some.select("bill_id", F.concat(F.lit("E"), "stage").alias("stage"), F.when(F.col("bill_id") % 8 == 0, "better").alias("kind"))
    return joins.enriched(rows, better, "bill_id", ["stage", "kind"])


@query("""
SELECT o.o_orderkey AS winner_id, (SELECT min(l_suppkey) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'A') AS candidate_id FROM orders o""")
def scalar_subquery_link(spark, d):
    """A correlated scalar subquery as one grouped join."""
    confirmed = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("bill_id")).agg(F.min("l_suppkey").alias("candidate_id"))
    return bills(spark, d).select("bill_id").join(confirmed, "bill_id", "left").select(F.col("bill_id").alias("winner_id"), "candidate_id")


@query("""
WITH a AS (SELECT event_id, user_id, event_type AS stage, CAST(ts AS DATE) AS day FROM events), known AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0),
there AS (SELECT DISTINCT user_id, stage, day FROM a WHERE event_id % 2 = 0)
SELECT a.event_id, CASE WHEN a.user_id NOT IN (SELECT c_custkey FROM known) THEN 'unknown' WHEN t.user_id IS NOT NULL THEN 'duplicate' ELSE 'applied' END AS outcome,
       CASE WHEN a.user_id IN (SELECT c_custkey FROM known) AND t.user_id IS NOT NULL THEN a.user_id || '-' || a.stage || '-' || a.day END AS duplicate_bill
FROM a LEFT JOIN there t ON t.user_id = a.user_id AND t.stage = a.stage AND t.day = a.day WHERE a.event_id % 2 = 1""")
def stage_apply_report(spark, d):
    """Which incoming stage rows apply, which name an unknown bill, and which are in the timeline already with bill, stage and date (even events are the timeline, odd ones come in)."""
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    rows = events(spark, d).select("event_id", "user_id", F.col("event_type").alias("stage"), F.col("ts").cast("date").alias("day"))
    incoming = joins.exists_flag(rows.where("event_id % 2 = 1"), known, ["user_id"], "known")
    marked = joins.exists_flag(incoming, rows.where("event_id % 2 = 0"), ["user_id", "stage", "day"], "there")
    outcome = F.when(~F.col("known"), "unknown").when(F.col("there"), "duplicate").otherwise("applied")
    info = F.when(F.col("known") & F.col("there"), F.concat_ws("-", "user_id", "stage", "day"))
    return marked.select("event_id", outcome.alias("outcome"), info.alias("duplicate_bill"))


@query("""
WITH e AS (
  SELECT o_orderkey AS bill_id, '접수' AS stage, CAST(o_orderdate AS DATE) AS day, 1 AS place FROM orders
  UNION ALL SELECT o_orderkey, '본회의심의', CAST(o_orderdate AS DATE) + 30, 2 FROM orders WHERE o_orderstatus IN ('P', 'F')
  UNION ALL SELECT o_orderkey, '공포', CAST(o_orderdate AS DATE) + 60, 3 FROM orders WHERE o_orderstatus = 'F')
SELECT bill_id, stage, day, day = max(day) OVER (PARTITION BY bill_id) AS latest FROM e""", dates=("day",))
def lifecycle_project(spark, d):
    """Wide date columns become one row for each stage reached, the latest marked."""
    wide = bills(spark, d).select(
        "bill_id", F.col("propose_date").alias("received"), F.when(F.col("stage").isin("P", "F"), F.date_add("propose_date", 30)).alias("plenary"),
        F.when(F.col("stage") == "F", F.date_add("propose_date", 60)).alias("law"),
    )
    stages = {"received": "접수", "plenary": "본회의심의", "law": "공포"}
    reached = F.filter(F.array(*(F.struct(F.lit(name).alias("stage"), F.col(c).alias("day")) for c, name in stages.items())), lambda x: x["day"].isNotNull())
    listed = wide.select("bill_id", reached.alias("reached")).withColumn("last", F.array_max(F.transform("reached", lambda x: x["day"])))
    return listed.select("bill_id", "last", F.inline("reached")).select("bill_id", "stage", "day", (F.col("day") == F.col("last")).alias("latest"))


STAGE_OF = {"signup": "접수", "view": "소관위심사", "click": "본회의심의", "purchase": "공포", "error": "재의"}


@query("""
WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN '접수' WHEN 'view' THEN '소관위심사' WHEN 'click' THEN '본회의심의' WHEN 'purchase' THEN '공포' ELSE '재의' END AS stage,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 3 WHEN 'click' THEN 5 WHEN 'purchase' THEN 7 END AS place FROM events),
free AS (SELECT user_id, max(event_id) AS last FROM p WHERE place IS NULL GROUP BY 1),
far AS (SELECT p.user_id, arg_max(stage, place) AS stage FROM p LEFT JOIN free f ON f.user_id = p.user_id WHERE place IS NOT NULL AND (last IS NULL OR event_id > last) GROUP BY 1)
SELECT u.user_id, coalesce(far.stage, '재의') AS stage FROM (SELECT DISTINCT user_id FROM p) u LEFT JOIN far ON far.user_id = u.user_id""")
def monotone_stage_fold(spark, d):
    """Stages only move forward between predefined ones; an unknown stage is always accepted, so the order of events matters."""
    stage = F.col("event_type")
    for kind, name in STAGE_OF.items():
        stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
    rows = events(spark, d).select("user_id", "event_id", stage.alias("stage"))
    return merge.folded_stages(rows, "user_id", "event_id", "stage", stage_order(F.col("stage")))


@query("""
WITH items AS (SELECT l_orderkey AS job_id, l_returnflag AS result FROM lineitem)
SELECT job_id, count(*) FILTER (result = 'A') AS succeeded, count(*) FILTER (result = 'R') AS failed, count(*) FILTER (result = 'N') AS missing,
       CASE WHEN count(*) FILTER (result = 'N') > 0 THEN 'SUBMITTED' WHEN count(*) FILTER (result = 'A') > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM items GROUP BY 1""")
def job_state_fold(spark, d):
    """A batch job's counters and state from its items' outcomes."""
    result = F.col("l_returnflag")
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count_if(result == "A").alias("succeeded"), F.count_if(result == "R").alias("failed"), F.count_if(result == "N").alias("missing")
    )
    return counts.withColumn("status", F.when(F.col("missing") > 0, "SUBMITTED").when(F.col("succeeded") > 0, "COMPLETED").otherwise("FAILED"))


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT 'likes' AS kind, o_custkey AS user_id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone) GROUP BY 2
UNION ALL SELECT 'events', user_id, count(*) FROM events WHERE user_id NOT IN (SELECT * FROM gone) GROUP BY 2""")
def cascade_delete(spark, d):
    """What is left of every table after some users' accounts are deleted."""
    gone = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    left = merge.without_user({"likes": bills(spark, d), "events": events(spark, d)}, gone, "user_id")
    counts = [rows.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "user_id", "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1])


@query("""
SELECT s_suppkey AS bill_id, s_nationkey + count(event_id) AS views FROM supplier LEFT JOIN events ON user_id = s_suppkey AND event_type = 'view' GROUP BY s_suppkey, s_nationkey""")
def view_counter(spark, d):
    """Counters grow by the number of view events, not by reading and writing back."""
    views = events(spark, d).where("event_type = 'view'").groupBy(F.col("user_id").alias("member_id")).agg(F.count("*").alias("more"))
    base = members(spark, d).select("member_id", "party_id")
    return base.join(views, "member_id", "left").select(F.col("member_id").alias("bill_id"), (F.col("party_id") + F.coalesce("more", F.lit(0))).alias("views"))


@query("""
SELECT user_id, event_id, before, after FROM (SELECT user_id, event_id, lag(event_type) OVER w AS before, event_type AS after, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE r > 1 AND before IS DISTINCT FROM after""")
def cdc_column_change(spark, d):
    """Change events of one watched column."""
    return merge.changed(events(spark, d), "user_id", "event_id", "event_type")


@query("""
WITH c AS (SELECT user_id, event_id, after FROM (SELECT user_id, event_id, lag(event_type) OVER w AS before, event_type AS after, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  WHERE r > 1 AND before IS DISTINCT FROM after AND after = 'purchase')
SELECT c.event_id, o.o_custkey AS subscriber, c.user_id AS target, count(*) AS follows FROM c JOIN orders o ON o.o_orderkey % 150 = c.user_id GROUP BY 1, 2, 3""")
def notify_fanout(spark, d):
    """One notification for each subscriber of a changed target, by its composite key."""
    moved = merge.changed(events(spark, d), "user_id", "event_id", "event_type").where("after = 'purchase'").select("event_id", F.col("user_id").alias("target"))
    follows = bills(spark, d).select((F.col("bill_id") % 150).alias("target"), F.col("user_id").alias("subscriber")).groupBy("target", "subscriber").agg(F.count("*").alias("follows"))
    return moved.join(follows, "target").select("event_id", "subscriber", "target", "follows")


@query("""
WITH c AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 20 AS target, event_id, event_type = 'click' AS wanted FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT *, coalesce(lag(wanted) OVER (PARTITION BY user_id, target ORDER BY event_id), false) AS was FROM c)
SELECT event_id, user_id, target, CASE WHEN wanted = was THEN 'error' WHEN wanted THEN 'created' ELSE 'deleted' END AS outcome FROM b""")
def like_requests(spark, d):
    """Every request to like (click) or unlike (view): made, undone, or refused since it asks for what is already so."""
    rows = events(spark, d).where("event_type IN ('click', 'view')")
    asked = rows.select("event_id", "user_id", (F.floor("value") % 20).alias("target"), (F.col("event_type") == "click").alias("wanted"))
    return merge.toggle_outcomes(asked, ["user_id", "target"], "event_id", "wanted").select("event_id", "user_id", "target", "outcome")


@query("""
SELECT user_id, CAST(floor(value) AS BIGINT) % 20 AS target, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def toggle_fold(spark, d):
    """Likes that are on after all toggles."""
    clicks = events(spark, d).where("event_type = 'click'").select("user_id", (F.floor("value") % 20).alias("target"), "event_id")
    return merge.toggled(clicks, ["user_id", "target"], "event_id")


@query("""
SELECT o_orderkey AS bill_id, o_orderstatus AS stage, CAST(count(l_linenumber) AS BIGINT) AS proposals, 2 AS version FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY 1, 2""")
def published_together(spark, d):
    """Bills and proposals of one version: the second version replaces the first as a whole, and a third that fails between its tables is never seen."""
    root, rows, lines = work_path(spark, "published"), table(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_orderstatus").alias("stage")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), "l_linenumber")
    versions.publish(spark, root, {"bills": rows.withColumn("stage", F.lit("?")), "proposals": lines})
    versions.publish(spark, root, {"bills": rows, "proposals": lines.where("l_linenumber > 1")}, base=1)
    broken = lines.withColumn("l_linenumber", F.when(F.col("bill_id") > 0, F.raise_error(F.lit("broken"))).cast("int"))
    try:
        versions.publish(spark, root, {"bills": rows.limit(0), "proposals": broken})
    except Exception as e:
        if "broken" not in str(e):
            raise
    now = versions.current(spark, root)
    found = versions.read(spark, root, "proposals", now).groupBy("bill_id").agg(F.count("*").alias("proposals"))
    return versions.read(spark, root, "bills", now).join(found, "bill_id").withColumn("version", F.lit(now))
