"""Changes and what follows from them: watched events, notices of results and parties, refreshed members, vote records, row builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civilake.functions import bills as bill_rules
from civilake.functions import dates, lifecycle, text
from civilake.operators import joins, merge, ordering
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.plans.relational import bills, members, parties, proposals
from civilake.session import table, work_path
from civilake.sinks import artifacts
from civilake.sources import envelopes
from civilake.streaming import changes

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Change events made of each user's consecutive events: inserts of proposers, updates of bills and members."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, d).withColumns({"was": F.lag("event_type").over(order), "old": F.lag(F.floor("value").cast("string")).over(order)})
    kind, key = F.col("event_type"), F.concat(F.lit("b"), F.col("user_id"))
    side = lambda stage, result: F.create_map(F.lit("id"), key, F.lit("stage"), stage, F.lit("bill_result"), result, F.lit("party_id"), stage)
    tables = F.when(kind == "purchase", "RepresentativeProposer").when(kind == "error", "Congressman").otherwise("Bill")
    op = F.when(kind == "purchase", "c").otherwise("u")
    return rows.select(
        F.col("event_id").alias("txn_id"), tables.alias("table"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"),
        side(F.col("was"), F.when(F.col("event_id") % 2 == 0, F.col("old"))).alias("before"), side(kind, F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("string"))).alias("after"),
    )


@query("""
WITH e AS (SELECT *, lag(event_type) OVER w AS was, lag(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) OVER w AS old FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
v AS (SELECT event_id, 'b' || user_id AS target, event_type AS kind, was, CASE WHEN event_id % 2 = 0 THEN old END AS old, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS new FROM e)
SELECT event_id AS txn_id, 'RP_INSERT' AS event, target FROM v WHERE kind = 'purchase'
UNION ALL SELECT event_id, 'BILL_STAGE_UPDATE', target FROM v WHERE kind NOT IN ('purchase', 'error') AND was IS DISTINCT FROM kind
UNION ALL SELECT event_id, 'BILL_RESULT_UPDATE', target FROM v WHERE kind NOT IN ('purchase', 'error') AND old IS DISTINCT FROM new
UNION ALL SELECT event_id, 'CONGRESSMAN_PARTY_UPDATE', target FROM v WHERE kind = 'error' AND was IS DISTINCT FROM kind""")
def watched_changes(spark, d):
    """The change events that a rule watches: inserts by table, updates by column, and only where the column changed. The same code runs on a stream."""
    return changes.watched(change_log(spark, d), "id").select("txn_id", "event", "target")


@query("""
SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS propose_date, c_custkey AS user_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""", dates=("propose_date",))
def liked_bills(spark, d):
    """The chain from users over their likes to the bills: each user's liked bills, newest first."""
    users = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    moments = table(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_orderdate").alias("moment"))
    likes = bills(spark, d).select("bill_id", "user_id", "propose_date").join(users, "user_id").join(moments, "bill_id")
    return ordering.top_per(likes, ["user_id"], [F.desc("moment"), F.desc("bill_id")], 1 << 30, "place").select("bill_id", "propose_date", "user_id", "place")


@query("""
WITH r AS (SELECT o_orderkey AS bill_id, CASE o_orderkey % 4 WHEN 0 THEN 'CHAIRMAN' WHEN 1 THEN 'GOVERNMENT' ELSE 'CONGRESSMAN' END AS kind, o_orderpriority AS brief, CASE WHEN o_totalprice > 50000 THEN 'passed' ELSE 'rejected' END AS result, c_name AS proposers FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'),
p AS (SELECT l_orderkey AS bill_id, list_sort(list(DISTINCT n_name)) AS parties FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_linenumber = 1 GROUP BY 1)
SELECT r.bill_id, array_to_string(list_concat([CAST(r.bill_id AS VARCHAR), brief, result, kind], CASE WHEN kind = 'CONGRESSMAN' THEN coalesce(parties, []) ELSE [proposers] END), '|') AS parts FROM r LEFT JOIN p ON p.bill_id = r.bill_id""")
def result_notices(spark, d):
    """The parts of a result notification: id, summary, result and kind, then a member bill's parties or else the proposers."""
    key = F.col("bill_id")
    code = bill_rules.proposer_kind(F.when(key % 4 == 0, "위원장").when(key % 4 == 1, "정부").otherwise("의원"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("proposers"))
    rows = bills(spark, d).where("stage = 'F'").join(people, "user_id").withColumns({"code": code, "result": F.when(F.col("price") > 50000, "passed").otherwise("rejected")})
    named = proposals(spark, d).where("line = 1").join(members(spark, d), "member_id").join(parties(spark, d), "party_id").select("bill_id", "party").distinct()
    found = joins.nested(rows, named, "bill_id", F.col("party"), "parties")
    tail = F.when(F.col("code") == "CONGRESSMAN", F.col("parties")).otherwise(F.array("proposers"))
    return found.select("bill_id", F.array_join(F.concat(F.array(key.cast("string"), "kind", "result", "code"), tail), "|").alias("parts"))


@query("""
SELECT s_suppkey AS member_id, s_suppkey || '|' || coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN n_name END, 'defaultPartyName') || '|' || s_name || '|' || coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN n_name END, 'defaultPartyName') || ':img' || s_suppkey AS parts FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def party_notices(spark, d):
    """The parts of a notification that a member changed party."""
    own = members(spark, d).join(parties(spark, d), "party_id")
    party = F.coalesce(F.when(F.col("party_id") % 5 != 0, F.col("party")), F.lit("defaultPartyName"))
    return own.select("member_id", F.concat_ws("|", "member_id", party, "member", F.concat(party, F.lit(":img"), "member_id")).alias("parts"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS bill_id, n_name AS party, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS votes_for FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 6 <> 0 GROUP BY 1, 2""")
def vote_party_projection(spark, d):
    """Votes of parties landed under three naming schemes; rows without a bill or a party name are left out."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("member_id"), "l_returnflag").join(members(spark, d), "member_id").join(parties(spark, d), "party_id")
    votes = rows.groupBy("k", "party_id", "party").agg(F.count_if(F.col("l_returnflag") == "A").alias("n"))
    key, named = F.col("k"), F.when(F.col("party_id") % 6 != 0, F.col("party")).otherwise("  ")
    landed = votes.select(
        F.when(key % 3 == 0, key).alias("BILL_NUMBER"), F.when(key % 3 == 1, key).alias("billId"), F.when(key % 3 == 2, key).alias("bill_no"),
        F.when(key % 3 == 0, named).alias("POLY_NM"), F.when(key % 3 == 1, named).alias("partyName"), F.when(key % 3 == 2, named).alias("PARTY_TITLE"),
        F.when(key % 3 == 0, F.col("n")).alias("YES_TCNT"), F.when(key % 3 == 1, F.col("n")).alias("voteForCount"), F.when(key % 3 == 2, F.col("n")).alias("votes_for_count"),
    )
    bill = text.first_text(*(F.col(c).cast("string") for c in ("BILL_NUMBER", "billId", "bill_no")))
    party = text.first_text(F.col("POLY_NM"), F.col("partyName"), F.col("PARTY_TITLE"))
    found = landed.select(bill.alias("bill"), party.alias("party"), lifecycle.vote_count(landed.columns, "YES_TCNT", "voteForCount", "votes_for_count").alias("votes_for"))
    return found.where("bill IS NOT NULL AND party IS NOT NULL").select(F.col("bill").alias("bill_id"), "party", "votes_for")


@query("""
WITH old AS (SELECT s_suppkey AS id, s_name AS name, true AS active FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS id, 'new ' || s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, n.id IS NOT NULL AS active FROM old o FULL JOIN new n ON n.id = o.id""")
def member_refresh(spark, d):
    """A full refresh of members: those that come are updated or inserted as active, those that do not are deactivated."""
    rows = members(spark, d).select(F.col("member_id").alias("id"), F.col("member").alias("name"))
    old = rows.where("id % 3 <> 0").withColumn("active", F.lit(True))
    new = rows.where("id % 5 <> 0").select("id", F.concat(F.lit("new "), "name").alias("name"))
    return merge.refreshed(old, new, "id", "active")


@query("""
WITH old AS (SELECT o_orderkey AS bill_id, 1 AS yes, 1 AS no, 2 AS total FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT l_orderkey AS bill_id, CAST(count(*) FILTER (l_returnflag = 'A') AS INTEGER) AS yes, CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS no, CAST(count(*) AS INTEGER) AS total FROM lineitem GROUP BY 1)
SELECT coalesce(o.bill_id, n.bill_id) AS bill_id, coalesce(n.yes, o.yes) AS yes, coalesce(n.no, o.no) AS no, coalesce(n.total, o.total) AS total FROM old o FULL JOIN new n ON n.bill_id = o.bill_id""")
def vote_record_write(spark, d):
    """Vote records by bill: all counts replaced, or the record inserted."""
    flag = F.col("l_returnflag")
    old = bills(spark, d).where("bill_id % 2 = 0").select("bill_id", F.lit(1).alias("yes"), F.lit(1).alias("no"), F.lit(2).alias("total"))
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("bill_id")).agg(F.count_if(flag == "A").cast("int").alias("yes"), F.count_if(flag == "R").cast("int").alias("no"), F.count("*").cast("int").alias("total"))
    return merge.upsert(old, new, ["bill_id"], overwrite=("yes", "no", "total"))


CONFIG = '{"regions":[{"slug":"seoul","region":"NATION_3"},{"slug":"busan","region":"NATION_5"}],"elections":[{"slug":"mayor","names":["BUILDING","MACHINERY"]}],"targets":[{"slug":"t1","region":"seoul","election":"mayor"},{"slug":"t2","region":"busan","election":null},{"slug":"t3","region":null,"election":"mayor"}]}'


@query("""
WITH r AS (SELECT c_custkey AS record, n_name AS region, c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT record, 't1' AS target FROM r WHERE region = 'NATION_3' AND segment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT record, 't2' FROM r WHERE region = 'NATION_5' UNION ALL SELECT record, 't3' FROM r WHERE segment IN ('BUILDING', 'MACHINERY')""")
def configured_targets(spark, d):
    """Targets of a JSON configuration, their regions and elections looked up by slug, and the records each one fits."""
    targets = envelopes.target_config(spark.range(1).select(F.lit(CONFIG).alias("body")))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    records = table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("record"), "region", F.array("c_mktsegment").alias("names"))
    fits = (F.col("want_region").isNull() | (F.col("region") == F.col("want_region"))) & (F.col("want_names").isNull() | F.arrays_overlap("names", "want_names"))
    return envelopes.records_for_targets(records, targets, fits, ("region", "want_region")).select("record", "target")


@query("""
SELECT o_orderkey AS bill_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'untitled') AS bill_name, CAST(22 AS INTEGER) AS assembly_number, CAST(o_orderdate AS DATE) AS propose_date,
       CASE o_orderkey % 3 WHEN 0 THEN 'CHAIRMAN' WHEN 1 THEN 'GOVERNMENT' ELSE 'CONGRESSMAN' END AS proposer_kind, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'brief' END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'untitled' END) AS brief_summary FROM orders""", dates=("propose_date",))
def bill_rows(spark, d):
    """Landed bills as rows to write: fields renamed, each from the first source that has it, kinds and dates normalised, a brief derived."""
    key = F.col("bill_id")
    landed = bills(spark, d).select(
        key.alias("BILL_ID"), F.when(key % 2 == 0, F.col("kind")).alias("BILL_NM"), F.when(key % 4 == 1, " ").alias("bill_name"), F.date_format("propose_date", "yyyyMMdd").alias("PPSL_DT"),
        F.when(key % 3 == 0, "위원장").when(key % 3 == 1, "정부").otherwise("nobody").alias("kind"), F.when(key % 5 == 0, "brief").alias("brief"), F.lit("제22대").alias("age"),
    )
    name = F.coalesce(text.first_text(F.col("bill_name"), F.col("BILL_NM")), F.lit("untitled"))
    return landed.select(
        F.col("BILL_ID").alias("bill_id"), name.alias("bill_name"), text.last_number(F.col("age"), 22).alias("assembly_number"), dates.multi_date(F.col("PPSL_DT")).alias("propose_date"),
        bill_rules.proposer_kind(F.col("kind")).alias("proposer_kind"), text.brief_summary(F.lit(None).cast("string"), name, F.col("brief")).alias("brief_summary"),
    )


@query("""
WITH b AS (SELECT o_orderkey AS bill_id, o_orderstatus AS stage, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS committee, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE WHEN o_orderkey % 4 = 1 THEN 'passed' WHEN o_orderkey % 4 = 2 THEN 'rejected' END AS result FROM orders)
SELECT CAST(bill_id AS VARCHAR) AS bill_id, stage, committee, day AS status_update_date, result AS bill_result FROM b""")
def stage_rows(spark, d):
    """Landed stages and results as rows to write: each field from the first of its spellings that has it, blank is null."""
    key = F.col("bill_id")
    given = lambda n, c: F.when(key % 3 == n, c)
    day = F.col("propose_date").cast("string")
    landed = bills(spark, d).select(
        F.when(key % 2 == 0, key).alias("billId"), F.when(key % 2 == 1, F.concat(F.lit(" "), key)).alias("bill_id"), "stage", given(0, F.col("kind")).alias("committee"),
        given(0, day).alias("statusUpdateDate"), given(1, day).alias("status_update_date"), given(2, day).alias("DT"), F.when(key % 4 == 1, "passed").otherwise("  ").alias("billProposeResult"), F.when(key % 4 == 2, "rejected").alias("bill_result"),
    )
    first = lambda *names: text.first_text(*map(F.col, names))
    return landed.select(
        first("billId", "bill_id").alias("bill_id"), first("stage").alias("stage"), first("committee").alias("committee"), first("statusUpdateDate", "status_update_date", "DT").alias("status_update_date"),
        first("billProposeResult", "bill_result").alias("bill_result"),
    )


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS member_id, s_name AS name, CASE WHEN s_suppkey % 4 <> 1 THEN n_name END AS party_name, CASE WHEN s_suppkey % 3 = 0 THEN 'https://example.org/' || s_suppkey || '.png' ELSE '/congressman/' || CASE WHEN s_suppkey % 2 = 0 THEN 21 ELSE 22 END || '/' || s_suppkey || '.jpg' END AS image
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 7""")
def member_rows(spark, d):
    """Landed members as rows to write: those without an id are left out, one without a picture gets the address of its assembly's."""
    key = F.col("member_id")
    landed = members(spark, d).join(parties(spark, d).select("party_id", "party"), "party_id").select(
        F.when(key % 10 == 7, " ").otherwise(key.cast("string")).alias("congressmanId"), F.concat(F.lit(" "), "member").alias("congressmanName"), F.when(key % 4 == 1, "").otherwise(F.col("party")).alias("partyName"),
        F.when(key % 2 == 0, "21").otherwise("none").alias("assemblyNumber"), F.when(key % 3 == 0, F.concat(F.lit("https://example.org/"), key, F.lit(".png"))).alias("congressmanImage"),
    )
    told = text.mapped(landed, {"member_id": ("congressmanId", "text"), "name": ("congressmanName", "text"), "party_name": ("partyName", "text"), "given": ("congressmanImage", "text"), "number": ("assemblyNumber", "as is")})
    path = F.concat(F.lit("/congressman/"), text.safe_int(F.col("number"), 22), F.lit("/"), F.col("member_id"), F.lit(".jpg"))
    return told.where("member_id IS NOT NULL").select("member_id", "name", "party_name", F.coalesce("given", path).alias("image"))


@query("""
SELECT 'json' AS kind, o_orderkey AS bill_id, o_orderstatus AS stage, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority || ', "' || o_orderkey || '"' END AS note FROM orders
UNION ALL SELECT 'csv', o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority || ', "' || o_orderkey || '"' END FROM orders""")
def artifacts_read_back(spark, d):
    """Artifacts in the test and the production mode read back; a dry run leaves none."""
    folder = work_path(spark, "artifacts")
    rows = bills(spark, d).select("bill_id", "stage", F.when(F.col("bill_id") % 5 > 0, F.concat("kind", F.lit(', "'), "bill_id", F.lit('"'))).alias("note"))
    assert artifacts.write_artifact(rows, folder, "dry", "dry-run") is None
    schema = "bill_id bigint, stage string, note string"
    found = spark.read.schema(schema).json(artifacts.write_artifact(rows, folder, "bills", "test"))
    other = spark.read.schema(schema).option("header", "true").option("escape", '"').csv(artifacts.write_artifact(rows, folder, "bills", "prod", "csv"))
    return found.select(F.lit("json").alias("kind"), "*").unionByName(other.select(F.lit("csv").alias("kind"), "*"))
