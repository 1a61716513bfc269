"""Lifecycle, votes, results, batch jobs and notifications over the fixture analogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilake.functions import bills as bill_rules
from civilake.functions import lifecycle as rules
from civilake.functions.text import optional_text
from civilake.operators import joins, merge, ordering
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.plans.relational import bills, members, parties, proposals
from civilake.session import table

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


def lifecycle_rows(spark: SparkSession, d: str) -> DataFrame:
    """Landed lifecycle rows: dates as text in two notations, most of them missing at random by key."""
    day, key = F.col("propose_date"), F.col("bill_id")
    iso, dots = (lambda c: F.date_format(c, "yyyy-MM-dd")), (lambda c: F.date_format(c, "yyyy.MM.dd"))
    return bills(spark, d).select(
        key.cast("string").alias("BILL_ID"),
        F.when(key % 4 != 3, iso(day)).otherwise(" ").alias("PPSL_DT"),
        F.when(F.col("stage").isin("P", "F"), dots(F.date_add(day, 10))).alias("JRCMIT_PRSNT_DT"),
        F.when(F.col("stage") == "F", iso(F.date_add(day, 30))).otherwise("soon").alias("RGS_RSLN_DT"),
        F.when((F.col("stage") == "F") & (key % 2 == 0), iso(F.date_add(day, 50))).alias("PROM_DT"),
        F.when(key % 5 != 0, iso(F.date_add(day, 1))).alias("PROC_DT"),
        F.when(key % 3 == 0, F.col("kind")).alias("JRCMIT_NM"), F.when(F.col("stage") == "F", "passed").alias("RGS_CONF_RSLT"),
    )


LIFECYCLE = """
WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS committee FROM orders),
w AS (SELECT *, CASE WHEN k % 4 <> 3 THEN day END AS a, CASE WHEN s IN ('P', 'F') THEN day + 10 END AS b, CASE WHEN s = 'F' THEN day + 30 END AS c,
        CASE WHEN s = 'F' AND k % 2 = 0 THEN day + 50 END AS e, CASE WHEN k % 5 <> 0 THEN day + 1 END AS p FROM r),
x AS (SELECT *, CASE WHEN e IS NOT NULL THEN e WHEN s = 'F' THEN c END AS first_ref, s <> 'F' AS soon FROM w),
ev AS (
  SELECT k, '접수' AS stage, a AS day, committee, NULL AS result FROM x WHERE a IS NOT NULL UNION ALL SELECT k, '위원회 심사', b, committee, NULL FROM x WHERE b IS NOT NULL
  UNION ALL SELECT k, '본회의 심의', c, committee, 'passed' FROM x WHERE c IS NOT NULL UNION ALL SELECT k, '공포', e, committee, NULL FROM x WHERE e IS NOT NULL)"""


@query(LIFECYCLE + """
SELECT CAST(k AS VARCHAR) AS bill_id, stage, day, committee, result FROM ev""", dates=("day",))  # fmt: skip
def lifecycle_events(spark, d):
    """Every stage a bill has a date for, with its committee, and the result with the plenary stage alone."""
    rows = lifecycle_rows(spark, d)
    found = rules.with_events(rows, optional_text(F.col("JRCMIT_NM")), optional_text(F.col("RGS_CONF_RSLT")))
    return found.select(F.col("BILL_ID").alias("bill_id"), F.inline("events")).select("bill_id", "stage", "day", "committee", "result")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS bill_id, '접수' AS stage, CAST(o_orderdate AS DATE) + 1 AS day, CAST(o_orderdate AS DATE) + 1 AS reference FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 = 3 AND o_orderkey % 5 <> 0""", dates=("day", "reference"))
def lifecycle_fallback(spark, d):
    """Bills with no stage date but a reference date become a receipt; those with neither give nothing."""
    rows = lifecycle_rows(spark, d).where("PPSL_DT = ' ' AND JRCMIT_PRSNT_DT IS NULL").drop("RGS_RSLN_DT", "PROM_DT")
    found = rules.with_events(rows, optional_text(F.col("JRCMIT_NM")), optional_text(F.col("RGS_CONF_RSLT")))
    return found.select(F.col("BILL_ID").alias("bill_id"), F.inline("events")).select("bill_id", "stage", "day", "reference")


@query(LIFECYCLE + """,
last AS (SELECT k, arg_max(stage, (day, stage)) AS stage FROM ev GROUP BY 1)
SELECT CAST(x.k AS VARCHAR) AS bill_id, last.stage, x.committee, CASE WHEN s = 'F' THEN 'passed' END AS result FROM x JOIN last ON last.k = x.k""")
def lifecycle_updates(spark, d):
    """The latest stage of every bill that has one, with committee and result: what a bill row is updated to."""
    rows = lifecycle_rows(spark, d)
    found = rules.with_events(rows, optional_text(F.col("JRCMIT_NM")), optional_text(F.col("RGS_CONF_RSLT")))
    # Rows whose only sign of life is a fallback are left to ``lifecycle_fallback``.
    dated = found.withColumn("last", F.element_at("events", -1)).where("PPSL_DT <> ' ' OR JRCMIT_PRSNT_DT IS NOT NULL")
    return dated.select(F.col("BILL_ID").alias("bill_id"), "last.stage", "last.committee", optional_text(F.col("RGS_CONF_RSLT")).alias("result"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS bill_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN c.c_mktsegment END) AS committee,
       o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AS backfilled FROM orders JOIN customer c ON c.c_custkey = o_custkey""")
def review_backfill(spark, d):
    """A review row is asked for only where all six review fields are empty; its committee then stands in."""
    rows = lifecycle_rows(spark, d)
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("reviewer"))
    reviews = bills(spark, d).join(segments, "user_id").select(F.col("bill_id").cast("string").alias("review_id"), "reviewer")
    missing = rules.review_missing(rows.columns)
    asked = rows.where(missing).select("BILL_ID").join(reviews, F.col("BILL_ID") == F.col("review_id")).select("BILL_ID", "reviewer")
    own = rows.withColumn("backfilled", missing).join(asked, "BILL_ID", "left")
    return own.select(F.col("BILL_ID").alias("bill_id"), F.coalesce(optional_text(F.col("JRCMIT_NM")), F.col("reviewer")).alias("committee"), "backfilled")


@query("""
WITH v AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'R') AS no, count(*) FILTER (l_returnflag = 'N') AS blank, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS bill_id, CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE yes * 1000 END AS BIGINT) AS votes_for, CAST(no AS BIGINT) AS votes_against, CAST(CASE WHEN k % 2 = 0 THEN blank ELSE 0 END AS BIGINT) AS abstentions, CAST(n AS BIGINT) AS total FROM v""")
def vote_projection(spark, d):
    """Vote counts landed under two naming schemes, as text with commas or not at all."""
    flag, key = F.col("l_returnflag"), F.col("k")
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(flag == "A").alias("a"), F.count_if(flag == "R").alias("r"), F.count_if(flag == "N").alias("b"), F.count("*").alias("n"))
    even = key % 2 == 0
    landed = v.select(
        F.when(even, key.cast("string")).alias("BILL_ID"), F.when(~even, key.cast("string")).alias("billId"),
        F.when(even, F.when(key % 7 == 0, "none").otherwise(F.format_number(F.col("a") * 1000, 0))).alias("YES_TCNT"), F.when(~even & (key % 7 != 0), F.col("a") * 1000).alias("voteForCount"),
        F.when(even, F.col("r")).alias("NO_TCNT"), F.when(~even, F.col("r")).alias("voteAgainstCount"), F.when(even, F.col("b")).alias("BLANK_TCNT"), F.col("n").alias("VOTE_TCNT"),
    )
    count = lambda *names: rules.vote_count(landed.columns, *names)
    return landed.select(
        F.coalesce("BILL_ID", "billId").alias("bill_id"), count("YES_TCNT", "voteForCount").alias("votes_for"), count("NO_TCNT", "voteAgainstCount").alias("votes_against"),
        count("BLANK_TCNT", "abstentionCount").alias("abstentions"), count("VOTE_TCNT", "totalVoteCount").alias("total"),
    )


@query("""
WITH t AS (SELECT l_orderkey AS bill_id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_returnflag = 'A' THEN '본회의 심의' ELSE '위원회 심사' END AS stage, CASE WHEN l_suppkey % 3 = 0 THEN 'old' END AS result FROM lineitem)
SELECT t.bill_id, line, part, stage, CASE WHEN stage = '본회의 심의' AND t.result IS NULL AND o.o_orderkey IS NOT NULL THEN 'passed-' || o.o_orderpriority ELSE t.result END AS result
FROM t LEFT JOIN orders o ON o.o_orderkey = t.bill_id AND o.o_orderstatus = 'F'""")
def result_apply(spark, d):
    """New results go to a bill's plenary timeline rows that have none yet; all other rows keep theirs."""
    timeline = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") == "A", rules.PLENARY).otherwise("위원회 심사").alias("stage"), F.when(F.col("l_suppkey") % 3 == 0, "old").alias("result"),
    )
    results = bills(spark, d).where("stage = 'F'").select("bill_id", F.concat(F.lit("passed-"), "kind").alias("new"))
    takes = (F.col("stage") == rules.PLENARY) & F.col("result").isNull()
    return timeline.join(results, "bill_id", "left").select("bill_id", "line", "part", "stage", F.when(takes, F.col("new")).otherwise(F.col("result")).alias("result"))


@query("""
SELECT DISTINCT l_orderkey AS bill_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS member_id FROM lineitem l WHERE EXISTS (
  SELECT 1 FROM orders o JOIN supplier s ON s.s_suppkey = o.o_custkey % 10 + 1 WHERE o.o_orderkey = l.l_orderkey AND s.s_suppkey = l.l_suppkey AND o.o_orderkey % 7 = l.l_linenumber AND CAST(o.o_orderdate AS DATE) <= CAST(l.l_shipdate AS DATE))""")
def timeline_exact(spark, d):
    """Timeline rows that match a wanted row in all of four columns."""
    wanted = bills(spark, d).select("bill_id", (F.col("user_id") % 10 + 1).alias("member_id"), (F.col("bill_id") % 7).cast("int").alias("line"), "propose_date")
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("member_id"), F.col("l_shipdate").cast("date").alias("day"))
    matched = own.join(wanted, (own.bill_id == wanted.bill_id) & (own.member_id == wanted.member_id) & (own.line == wanted.line) & (own.day >= wanted.propose_date), "left_semi")
    return matched.select("bill_id", "line", "part", "member_id").distinct()


RAW_STATES = ["JOB_STATE_RUNNING", "completed", "Cancelled", None, "validating", "JOB_STATE_SUCCEEDED", "JOB_STATE_UNSPECIFIED", "EXPIRED"]
STATES = ["IN_PROGRESS", "COMPLETED", "CANCELED", "UNKNOWN", "VALIDATING", "COMPLETED", "UNKNOWN", "EXPIRED"]


def raw_state(key):
    out = F.lit(None).cast("string")
    for at, state in enumerate(RAW_STATES):
        out = F.when(key % len(RAW_STATES) == at, F.lit(state)).otherwise(out)
    return out


STATE_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"


@query(f"SELECT event_id, {STATE_SQL} AS state FROM events")
def batch_states(spark, d):
    """Providers' states in common terms."""
    return events(spark, d).select("event_id", rules.batch_state(raw_state(F.col("event_id"))).alias("state"))


@query(f"""
WITH j AS (SELECT event_id AS job_id, {STATE_SQL} AS state, value > 5 AS has_output, user_id % 4 = 0 AS dry_run, event_type <> 'error' AS applied FROM events),
a AS (SELECT *, CASE WHEN NOT (state = 'COMPLETED' AND has_output) THEN 'wait' WHEN dry_run THEN 'skip' WHEN NOT applied THEN 'rollback' ELSE 'apply' END AS action FROM j)
SELECT job_id, action, CASE WHEN action = 'rollback' THEN 'FINALIZING' ELSE state END AS stored FROM a""")
def ingest_loop(spark, d):
    """What one ingest run does with every job, and the state it stores for it."""
    jobs = events(spark, d).select(
        F.col("event_id").alias("job_id"), rules.batch_state(raw_state(F.col("event_id"))).alias("state"), (F.col("value") > 5).alias("has_output"),
        (F.col("user_id") % 4 == 0).alias("dry_run"), (F.col("event_type") != "error").alias("applied"),
    )
    action, stored = rules.job_action(F.col("state"), F.col("has_output"), F.col("dry_run"), F.col("applied"))
    return jobs.select("job_id", action.alias("action"), stored.alias("stored"))


@query("""
WITH i AS (SELECT l_orderkey AS job_id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_linestatus = 'O' THEN 'SUBMITTED' ELSE 'DONE' END AS status, l_returnflag AS answer, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS known FROM lineitem)
SELECT job_id, line, part, CASE WHEN status <> 'SUBMITTED' THEN status WHEN answer = 'A' AND known THEN 'DONE' ELSE 'FAILED' END AS status,
       CASE WHEN status <> 'SUBMITTED' THEN NULL WHEN answer = 'A' AND known THEN NULL WHEN answer = 'A' THEN 'no such bill' WHEN answer = 'R' THEN 'error' ELSE 'no answer' END AS error,
       CASE WHEN status = 'SUBMITTED' AND NOT (answer = 'A' AND known) THEN 1 ELSE 0 END AS retries FROM i""")
def batch_results(spark, d):
    """Items still submitted take their answer: done, failed by an error or an unknown bill, or failed for want of an answer; others are left alone, so a rerun changes nothing."""
    known = members(spark, d).where("balance > 0").select(F.col("member_id").alias("l_suppkey"))
    items = joins.exists_flag(table(spark, d, "lineitem"), known, ["l_suppkey"], "known")
    open_, answer = F.col("l_linestatus") == "O", F.col("l_returnflag")
    good = (answer == "A") & F.col("known")
    error = F.when(good, None).when(answer == "A", "no such bill").when(answer == "R", "error").otherwise("no answer")
    return items.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.when(open_ & ~good, "FAILED").otherwise("DONE").alias("status"),
        F.when(open_, error).alias("error"), (open_ & ~good).cast("int").alias("retries"),
    )


@query("""
WITH r AS (SELECT o_orderkey AS bill_id, CASE o_orderkey % 4 WHEN 0 THEN 'CHAIRMAN' WHEN 1 THEN 'GOVERNMENT' ELSE 'CONGRESSMAN' END AS kind, o_orderpriority AS brief, o_orderstatus AS stage, c_name AS proposers FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT l_orderkey AS bill_id, list_sort(list(DISTINCT n_name)) AS parties FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_linenumber = 1 GROUP BY 1)
SELECT r.bill_id, array_to_string(list_concat([CAST(r.bill_id AS VARCHAR), brief, stage, kind], CASE WHEN kind = 'CONGRESSMAN' THEN coalesce(parties, []) ELSE [proposers] END), '|') AS parts
FROM r LEFT JOIN p ON p.bill_id = r.bill_id WHERE stage <> 'O'""")
def stage_notices(spark, d):
    """The parts of a stage notification: id, summary, stage and kind, then a member bill's parties or else the proposers."""
    key = F.col("bill_id")
    kind = F.when(key % 4 == 0, "위원장").when(key % 4 == 1, "정부").otherwise("의원")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("proposers"))
    rows = bills(spark, d).where("stage <> 'O'").join(people, "user_id").withColumn("code", bill_rules.proposer_kind(kind))
    named = proposals(spark, d).where("line = 1").join(members(spark, d), "member_id").join(parties(spark, d), "party_id").select("bill_id", "party").distinct()
    found = joins.nested(rows, named, "bill_id", F.col("party"), "parties")
    tail = F.when(F.col("code") == "CONGRESSMAN", F.col("parties")).otherwise(F.array("proposers"))
    return found.select("bill_id", F.array_join(F.concat(F.array(key.cast("string"), "kind", "stage", "code"), tail), "|").alias("parts"))


@query("""
SELECT l.l_orderkey AS bill_id, l.l_suppkey AS member_id, s.s_name || '|' || coalesce(CASE WHEN n.n_nationkey % 5 <> 0 THEN n.n_name END, 'defaultPartyName') || ':' || s.s_suppkey AS parts
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE l.l_orderkey % 4 NOT IN (0, 1)""")
def proposer_notices(spark, d):
    """Only members' bills notify of their representative proposer; a party without a name has a default one."""
    key = F.col("bill_id")
    kind = bill_rules.proposer_kind(F.when(key % 4 == 0, "위원장").when(key % 4 == 1, "정부").otherwise("의원"))
    rep = proposals(spark, d).where("line = 1").select("bill_id", "member_id").distinct().where(kind == "CONGRESSMAN")
    named = rep.join(members(spark, d), "member_id").join(parties(spark, d), "party_id")
    party = F.coalesce(F.when(F.col("party_id") % 5 != 0, F.col("party")), F.lit("defaultPartyName"))
    return named.select("bill_id", "member_id", F.concat_ws("|", "member", F.concat_ws(":", party, "member_id")).alias("parts"))


@query("""
WITH a AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 30 AS notice, event_id, event_type FROM events),
n AS (SELECT user_id, notice, min(event_id) AS born, max(event_id) FILTER (event_type = 'view') AS read, max(event_id) FILTER (event_type = 'error') AS gone FROM a GROUP BY 1, 2),
u AS (SELECT user_id, max(event_id) AS all_read FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT n.user_id, n.notice, coalesce(n.read > n.born, false) OR coalesce(u.all_read > n.born, false) AS is_read FROM n LEFT JOIN u ON u.user_id = n.user_id WHERE n.gone IS NULL OR n.gone <= n.born""")
def notice_states(spark, d):
    """Notifications after all marks and deletions: read by a mark of their own or by one for all that came later; deleted ones are gone."""
    kind, at = F.col("event_type"), F.col("event_id")
    rows = events(spark, d).withColumn("notice", F.floor("value") % 30)
    own = rows.groupBy("user_id", "notice").agg(F.min(at).alias("born"), F.max(F.when(kind == "view", at)).alias("read"), F.max(F.when(kind == "error", at)).alias("gone"))
    every = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.max(at).alias("all_read"))
    later = lambda c: F.coalesce(F.col(c) > F.col("born"), F.lit(False))
    left = own.join(every, "user_id", "left").where(~later("gone"))
    return left.select("user_id", "notice", (later("read") | later("all_read")).alias("is_read"))


@query("""
SELECT l_orderkey AS document, l_partkey % 4 AS question, min(l_linenumber * 1000000 + l_suppkey) AS first_place FROM lineitem GROUP BY 1, 2""")
def seen_questions(spark, d):
    """Each question number of a document once, where it first appears across its pages."""
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_partkey") % 4).alias("question"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("first_place"))
    return pages.groupBy("document", "question").agg(F.min("first_place").alias("first_place"))


@query("""
WITH v AS (SELECT l_orderkey AS bill_id, s_nationkey AS party_id, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A' GROUP BY 1, 2),
b AS (SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s, o_orderpriority AS committee FROM orders),
p AS (SELECT b.day, string_agg(v.bill_id || ':' || v.party_id || '=' || v.n, ',' ORDER BY v.bill_id, v.party_id) AS votes FROM b JOIN v ON v.bill_id = b.bill_id WHERE s = 'P' GROUP BY 1),
c AS (SELECT day, committee, count(*) AS n FROM b WHERE s = 'O' GROUP BY 1, 2), cc AS (SELECT day, string_agg(committee || '=' || n, ',' ORDER BY committee) AS committees, CAST(sum(n) AS BIGINT) AS submitted FROM c GROUP BY 1)
SELECT d.day, coalesce(cc.submitted, 0) AS submitted, coalesce(cc.committees, '') AS committees, coalesce(p.votes, '') AS plenary_votes FROM (SELECT DISTINCT day FROM b) d LEFT JOIN p ON p.day = d.day LEFT JOIN cc ON cc.day = d.day""", dates=("day",))
def timeline_assembly(spark, d):
    """Each day's submitted bills in all and by committee, and the party votes of the bills in plenary."""
    b = bills(spark, d).select("bill_id", F.col("propose_date").alias("day"), "stage", F.col("kind").alias("committee"))
    ballots = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("member_id"))
    votes = ballots.join(members(spark, d).select("member_id", "party_id"), "member_id").groupBy("bill_id", "party_id").agg(F.count("*").alias("n"))
    plenary = b.where("stage = 'P'").select("day", "bill_id").join(votes, "bill_id")
    counts = b.where("stage = 'O'").groupBy("day", "committee").agg(F.count("*").alias("n"))
    days = b.select("day").distinct()
    listed = joins.nested(joins.nested(days, counts, "day", F.struct("committee", "n"), "c"), plenary, "day", F.struct("bill_id", "party_id", "n"), "v")
    submitted = F.aggregate("c", F.lit(0).cast("bigint"), lambda total, x: total + x["n"])
    committees = F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["committee"], x["n"])), ",")
    party_votes = F.array_join(F.transform("v", lambda x: F.concat(x["bill_id"], F.lit(":"), x["party_id"], F.lit("="), x["n"])), ",")
    return listed.select("day", submitted.alias("submitted"), committees.alias("committees"), party_votes.alias("plenary_votes"))


@query("""
WITH old AS (SELECT l_orderkey AS bill_id, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), new AS (SELECT l_orderkey AS bill_id, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)
SELECT coalesce(o.bill_id, n.bill_id) AS bill_id, coalesce(o.line, n.line) AS line, coalesce(n.n, o.n) AS votes, CASE WHEN o.bill_id IS NULL THEN 'insert' WHEN n.bill_id IS NULL THEN 'keep' ELSE 'update' END AS action
FROM old o FULL JOIN new n ON n.bill_id = o.bill_id AND n.line = o.line""")
def vote_party_write(spark, d):
    """Party votes have no unique key: rows are looked up by bill and party and updated, or inserted."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), "l_returnflag")
    count = lambda some: some.groupBy("bill_id", "line").agg(F.count("*").alias("votes"))
    old, new = count(rows.where("l_returnflag = 'A'")), count(rows.where("l_returnflag <> 'A'"))
    merged = merge.upsert(old, new, ["bill_id", "line"], overwrite=("votes",))
    marked = joins.exists_flag(joins.exists_flag(merged, old, ["bill_id", "line"], "was"), new, ["bill_id", "line"], "comes")
    return marked.select("bill_id", "line", "votes", F.when(~F.col("was"), "insert").when(~F.col("comes"), "keep").otherwise("update").alias("action"))


@query("""
SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events WHERE event_type IN ('click', 'signup')) WHERE rank <= 20""")
def followed_changes(spark, d):
    """The twenty newest changes of what each user follows."""
    rows = events(spark, d).where("event_type IN ('click', 'signup')").select("user_id", "event_id", "value")
    return ordering.top_per(rows, ["user_id"], [F.desc("event_id")], 20)
