"""Reports, filters and classifications over the fixture analogue: distributions, coverage, committees, profiles, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civilake.functions import text
from civilake.operators import aggregates, fulltext, joins, ordering
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.plans.relational import bills, members, parties, proposals
from civilake.session import table, work_path

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as bills with four texts to search."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("bill_id"), F.lower("p_name").alias("name"), F.lower("p_type").alias("brief"), F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("gpt"),
        F.lower(F.concat_ws(" ", "p_name", "p_type", "p_name")).alias("summary"), F.col("p_size").alias("day"), (F.col("p_partkey") % 11 != 0).alias("ready"),
    )


SEARCHED = ["name", "brief", "gpt", "summary"]


@query(r"""
WITH a AS (SELECT p_partkey AS bill_id, p_size AS day, lower(p_name) AS name, lower(p_type) AS brief, lower(p_brand || ' ' || p_type) AS gpt, lower(p_name || ' ' || p_type || ' ' || p_name) AS summary FROM part),
h AS (SELECT bill_id, field, len(regexp_extract_all(text, '\bst\w*')) AS n FROM a UNPIVOT (text FOR field IN (name, brief, gpt, summary))),
c AS (SELECT field, count(*) AS rows, count(*) FILTER (n > 0) AS hits FROM h GROUP BY 1),
r AS (SELECT bill_id, field, n * pow(log10(1 + rows / hits), 2) AS rel FROM h JOIN c USING (field) WHERE n > 0),
w AS (SELECT bill_id, round(coalesce(max(rel) FILTER (field = 'name'), 0), 6) AS name_rel, round(coalesce(max(rel) FILTER (field = 'brief'), 0), 6) AS brief_rel,
  round(coalesce(max(rel) FILTER (field = 'gpt'), 0), 6) AS gpt_rel, round(coalesce(max(rel) FILTER (field = 'summary'), 0), 6) AS summary_rel FROM r GROUP BY 1)
SELECT w.* FROM w JOIN a USING (bill_id) WHERE bill_id % 11 <> 0 ORDER BY day DESC, name_rel DESC, brief_rel DESC, gpt_rel DESC, summary_rel DESC, bill_id LIMIT 20 OFFSET 20""")
def bill_search(spark, d):
    """The second page of a word-prefix search in four columns of finished bills: newest first, then by the relevance in each column. Only the prefix's postings of the index are read."""
    index = fulltext.build(articles(spark, d), "bill_id", SEARCHED, work_path(spark, "bill-index"))
    found = fulltext.search(index, "st*", SEARCHED).withColumnRenamed("id", "bill_id")
    rels = [f"{c}_rel" for c in SEARCHED]
    shown = articles(spark, d).where("ready").select("bill_id", "day").join(found, "bill_id").withColumns({c: F.round(c, 6) for c in rels})
    return ordering.page(shown, [F.desc("day"), *map(F.desc, rels), F.asc("bill_id")], 1, 20).select("bill_id", *rels)


@query(r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT id, len(list_filter(w, lambda x: x = 'of')) AS a, len(list_filter(w, lambda x: x = 'la')) AS b, len(list_filter(w, lambda x: starts_with(x, 'st'))) AS c,
  len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS p FROM w),
n AS (SELECT count(*) AS rows, count(*) FILTER (a > 0) AS da, count(*) FILTER (c > 0) AS dc, count(*) FILTER (p > 0) AS dp FROM t)
SELECT id, round(a * pow(log10(1 + rows / da), 2) + coalesce(c * pow(log10(1 + rows / nullif(dc, 0)), 2), 0) + coalesce(p * pow(log10(1 + rows / nullif(dp, 0)), 2), 0), 6) AS text_rel
FROM t, n WHERE a > 0 AND b = 0""")
def boolean_search(spark, d):
    """Documents with one word and without another, ranked also by a prefix and a phrase."""
    index = fulltext.build(table(spark, d, "documents"), "doc_id", ["text"], work_path(spark, "document-index"))
    return fulltext.search(index, '+of -la st* "of the"', ["text"]).withColumn("text_rel", F.round("text_rel", 6))


@query(r"""
WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'a new text of few words' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0),
w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM a WHERE text IS NOT NULL),
t AS (SELECT id, len(list_filter(w, lambda x: x = 'new')) AS a, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'few')) AS p FROM w),
n AS (SELECT count(*) AS rows, count(*) FILTER (a > 0) AS da, count(*) FILTER (p > 0) AS dp FROM t)
SELECT id, round(coalesce(a * pow(log10(1 + rows / nullif(da, 0)), 2), 0) + coalesce(p * pow(log10(1 + rows / nullif(dp, 0)), 2), 0), 6) AS text_rel FROM t, n WHERE a > 0 OR p > 0""")
def updated_search(spark, d):
    """The index after new and changed documents were merged into it."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = fulltext.build(docs.where("doc_id % 7 <> 0"), "doc_id", ["text"], work_path(spark, "old-index"))
    changed = docs.where("doc_id % 5 = 0").withColumn("text", F.lit("a new text of few words"))
    index = fulltext.updated(old, changed, "doc_id", ["text"], work_path(spark, "new-index"))
    return fulltext.search(index, 'new "of few"', ["text"]).withColumn("text_rel", F.round("text_rel", 6))


@query("""
SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'members', count(*) FROM supplier UNION ALL SELECT 'events', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'missing', 0""")
def source_totals(spark, d):
    """Totals of several sources; one that is not there counts as 0."""
    tables = {"orders": bills(spark, d), "members": members(spark, d), "events": events(spark, d).where("event_type = 'error'"), "missing": None}
    return aggregates.totals(spark, tables)


@query("""
WITH v AS (SELECT 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'type', CAST(c_custkey % 40 AS VARCHAR) FROM customer),
c AS (SELECT field, value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
SELECT field, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def data_distribution(spark, d):
    """The ten most frequent values of each of several fields, from one pass."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 40).alias("type"))
    return aggregates.value_counts(rows, ["segment", "nation", "type"], 10)


@query("""
WITH m AS (SELECT o_orderpriority AS kind, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderstatus = 'O'), k AS (SELECT kind, count(*) AS n FROM m GROUP BY 1),
y AS (SELECT year, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, year) AS r FROM m GROUP BY 1)
SELECT 'kind' AS field, kind AS value, n FROM k UNION ALL SELECT 'year', CASE WHEN r <= 5 THEN year ELSE 'other' END, CAST(sum(n) AS BIGINT) FROM y GROUP BY 2""")
def missing_summaries(spark, d):
    """Bills without a summary by kind, and by year: the five fullest years and the rest."""
    missing = bills(spark, d).where("stage = 'O'").select("kind", F.year("propose_date").alias("year"))
    kinds = missing.groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("field"), "value", "n")
    return kinds.unionByName(aggregates.top_and_other(missing, "year", 5).select(F.lit("year").alias("field"), F.col("year").alias("value"), "n"))


@query("""
WITH v AS (SELECT 'province' AS field, r_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'pollster', 'P' || c_custkey % 60 FROM customer UNION ALL SELECT 'method', c_mktsegment FROM customer),
c AS (SELECT field, value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
SELECT field, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30""")
def collection_stats(spark, d):
    """Records by province, pollster (the first thirty) and method."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("province"))
    nation = table(spark, d, "nation").join(F.broadcast(region), "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "province")  # five regions
    rows = table(spark, d, "customer").join(nation, "c_nationkey").select("province", F.concat(F.lit("P"), F.col("c_custkey") % 60).alias("pollster"), F.col("c_mktsegment").alias("method"))
    return aggregates.value_counts(rows, ["province", "pollster", "method"], 30)


@query("""
SELECT c_nationkey AS region, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS methods, count(DISTINCT c_custkey % 7) AS pollsters, count(*) AS surveys FROM customer GROUP BY 1""")
def survey_catalog(spark, d):
    """Each region's distinct methods and pollsters, and its surveys."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("method"), (F.col("c_custkey") % 7).alias("pollster"))
    return rows.groupBy("region").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"), F.count_distinct("pollster").alias("pollsters"), F.count("*").alias("surveys"))


@query("""
WITH r AS (SELECT 'P' || l_suppkey % 9 AS before, CASE l_suppkey % 9 WHEN 0 THEN 'P1' WHEN 2 THEN 'P3' ELSE 'P' || l_suppkey % 9 END AS after FROM lineitem)
SELECT before, after, count(*) AS n FROM r WHERE before <> after GROUP BY 1, 2""")
def update_summary(spark, d):
    """How many rows a renaming changes, by the name before and after."""
    before = F.concat(F.lit("P"), F.col("l_suppkey") % 9)
    after = F.when(before == "P0", "P1").when(before == "P2", "P3").otherwise(before)
    return aggregates.changes(table(spark, d, "lineitem").select(before.alias("before"), after.alias("after")), "before", "after")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS bill_id, s_nationkey AS party_id, s_suppkey AS member_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT bill_id, party_id, string_agg(member_id, '+' ORDER BY member_id) AS people FROM p GROUP BY 1, 2)
SELECT bill_id, string_agg(party_id || '=' || people, ' ' ORDER BY party_id) AS by_party FROM g GROUP BY 1""")
def proposers_by_party(spark, d):
    """Each bill's proposers grouped by party, parties in the order of their ids."""
    rows = proposals(spark, d).select("bill_id", "member_id").distinct().join(members(spark, d).select("member_id", "party_id"), "member_id")
    people = F.array_join(F.sort_array(F.collect_list("member_id")).cast("array<string>"), "+")
    grouped = rows.groupBy("bill_id", "party_id").agg(people.alias("people"))
    listed = F.array_sort(F.collect_list(F.struct("party_id", "people")))
    return grouped.groupBy("bill_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["party_id"], x["people"])), " ").alias("by_party"))


@query("""
SELECT event_type AS step, count(*) AS rows, count(*) FILTER (value > 30) AS failed, round(sum(value), 2) AS elapsed, false AS summary FROM events GROUP BY 1
UNION ALL SELECT 'all', count(*), count(*) FILTER (value > 30), round(sum(value), 2), true FROM events""")
def run_metrics(spark, d):
    """Counts and elapsed time of every step of a run, and one row of them all."""
    measures = (F.count("*").alias("rows"), F.count_if(F.col("value") > 30).alias("failed"), F.round(F.sum("value"), 2).alias("elapsed"))
    return events(spark, d).rollup("event_type").agg(*measures, (F.grouping("event_type") == 1).alias("summary")).select(F.coalesce("event_type", F.lit("all")).alias("step"), "rows", "failed", "elapsed", "summary")


@query("""
SELECT n_name AS party, s_suppkey AS member_id, s_name AS member, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_name, s_suppkey) AS INTEGER) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 10 = 3)""")
def followed_members(spark, d):
    """Members a user follows, with their parties, in order of name."""
    follows = proposals(spark, d).where("bill_id % 10 = 3").select("member_id")
    own = members(spark, d).join(follows, "member_id", "left_semi").join(parties(spark, d), "party_id").select("party", "member_id", "member")
    return ordering.top_per(own, ["party"], [F.asc("member"), F.asc("member_id")], 1 << 30, "place")


@query("""
SELECT DISTINCT n_nationkey AS party_id, n_name AS party FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE l_orderkey % 10 = 3""")
def followed_parties(spark, d):
    """Parties with a followed member, each once."""
    follows = proposals(spark, d).where("bill_id % 10 = 3").select("member_id")
    own = members(spark, d).join(follows, "member_id", "left_semi").select("party_id")
    return parties(spark, d).join(own, "party_id", "left_semi").select("party_id", "party")


def pollsters(spark, d: str) -> DataFrame:
    """Surveys of pollsters whose names are a part's words, some as stock companies write them."""
    key, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size"))
    written = F.when(key % 4 == 1, F.concat(F.lit("(주) "), name)).when(key % 4 == 2, F.concat(F.lit("주식회사  "), name)).when(key % 4 == 3, F.concat(name, F.lit(" (주)"))).otherwise(F.replace(name, F.lit(" "), F.lit("  ")))
    return table(spark, d, "part").select(key.alias("survey"), written.alias("pollster"))


@query("""
WITH s AS (SELECT p_partkey AS survey, p_name || ' ' || p_type || ' ' || p_size AS pollster FROM part),
k AS (SELECT p_partkey AS ordinal, substring(p_name, 3, 5) || CASE WHEN p_partkey % 2 = 0 THEN substring(p_name, 8) || ' ' || substring(p_type, 1, 4) ELSE '' END AS keyword, p_brand AS parser FROM part WHERE p_size % 5 = 0),
m AS (SELECT n.pollster, arg_min(k.parser, k.ordinal) AS parser FROM (SELECT DISTINCT pollster FROM s) n JOIN k ON contains(n.pollster, k.keyword) GROUP BY 1)
SELECT survey, parser FROM s LEFT JOIN m USING (pollster)""")
def parser_of_pollster(spark, d):
    """The parser of the first registry keyword that a pollster's name holds."""
    parts = table(spark, d, "part")
    more = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("p_name", 8, 1000), F.lit(" "), F.substring("p_type", 1, 4))).otherwise("")
    registry = parts.where("p_size % 5 = 0").select(F.col("p_partkey").alias("ordinal"), F.concat(F.substring("p_name", 3, 5), more).alias("keyword"), F.col("p_brand").alias("parser"))
    surveys = pollsters(spark, d).withColumn("pollster", text.company_name(F.col("pollster")))
    return joins.first_contained(surveys, registry, "pollster", "keyword", "ordinal", "parser").select("survey", "parser")


@query("""
WITH s AS (SELECT p_partkey AS survey, p_name || ' ' || p_type || ' ' || p_size AS name FROM part),
r AS (SELECT 1 AS kind, p_partkey AS ordinal, p_name || ' ' || p_type AS name, 'supported' AS status, p_brand AS parser FROM part WHERE p_partkey % 40 = 0
  UNION ALL SELECT 1, p_partkey, p_name || ' ' || p_type || ' ' || p_size || ' center', 'supported', p_brand FROM part WHERE p_partkey % 40 = 1
  UNION ALL SELECT 2, p_partkey, CASE WHEN p_partkey % 40 = 2 THEN p_name || ' ' || p_type || ' ' || p_size ELSE substring(p_name, 2) END, 'unparseable', NULL FROM part WHERE p_partkey % 40 = 2 OR p_partkey % 400 = 3),
m AS (SELECT n.name, r.status, r.parser, row_number() OVER (PARTITION BY n.name ORDER BY n.name <> r.name, kind, ordinal) AS place FROM (SELECT DISTINCT name FROM s) n JOIN r ON contains(n.name, r.name) OR contains(r.name, n.name))
SELECT survey, coalesce(m.status, 'uncovered') AS status, m.parser FROM s LEFT JOIN m ON m.name = s.name AND m.place = 1""")
def coverage_classes(spark, d):
    """Pollsters by whether a parser is known: the name itself, the unparseable list, then either name inside the other. Rules are only met once marks of stock companies and spaces are stripped."""
    parts = table(spark, d, "part")
    key, two, whole = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size"))
    rule = lambda kind, name, status, parser: (F.lit(kind).alias("kind"), key.alias("ordinal"), name.alias("name"), F.lit(status).alias("status"), parser.alias("parser"))
    rules = parts.where("p_partkey % 40 = 0").select(*rule(1, two, "supported", F.col("p_brand")))
    rules = rules.unionByName(parts.where("p_partkey % 40 = 1").select(*rule(1, F.concat(whole, F.lit(" center")), "supported", F.col("p_brand"))))
    hard = F.when(key % 40 == 2, whole).otherwise(F.substring("p_name", 2, 1000))
    rules = rules.unionByName(parts.where("p_partkey % 40 = 2 OR p_partkey % 400 = 3").select(*rule(2, hard, "unparseable", F.lit(None).cast("string"))))
    plain = pollsters(spark, d).withColumn("pollster", text.company_name(F.col("pollster")))
    return joins.classified(plain, rules, "survey", "pollster").select("survey", "status", "parser")


@query("""
WITH m AS (SELECT s_nationkey AS k, list_sort(list(s_name)) AS names FROM supplier GROUP BY 1)
SELECT n_name AS committee, coalesce(len(m.names), 0) AS n_members, coalesce(array_to_string(m.names, ','), '') AS members, CASE WHEN n_nationkey % 2 = 0 THEN m.names[1] END AS chair FROM nation LEFT JOIN m ON m.k = n_nationkey""")
def committee_detail(spark, d):
    """Committees with their members, and the chair where the member list has that name."""
    people = members(spark, d)
    first = people.groupBy("party_id").agg(F.min("member").alias("first"))
    committees = parties(spark, d).select("party_id", F.col("party").alias("committee")).join(first, "party_id", "left").withColumn("chair_name", F.when(F.col("party_id") % 2 == 0, F.col("first")).otherwise("nobody"))
    found = joins.nested(committees, people, "party_id", F.struct("member", "member_id"), "m")
    chair = F.get(F.filter("m", lambda x: x["member"] == F.col("chair_name")), F.lit(0))["member"]
    return found.select("committee", F.size("m").cast("bigint").alias("n_members"), F.array_join(F.transform("m", lambda x: x["member"]), ",").alias("members"), chair.alias("chair"))


@query("""
WITH r AS (SELECT c_custkey AS survey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN '미분류' ELSE ' ' END AS given, CASE c_custkey % 4 WHEN 0 THEN '여론조사꽃_' || c_name || '.pdf' WHEN 1 THEN c_name || '.pdf' WHEN 2 THEN '뉴스1 ' || c_name END AS file FROM customer),
f AS (SELECT c_name || '.pdf' AS file, 'pollster of ' || c_name AS fixture FROM customer WHERE c_nationkey < 10),
h AS (SELECT survey, nullif(nullif(trim(given), ''), '미분류') AS given, fixture, CASE WHEN contains(r.file, '여론조사꽃') THEN '여론조사꽃' WHEN contains(r.file, '뉴스1') THEN '(주)한국리서치' END AS hint FROM r LEFT JOIN f USING (file))
SELECT survey, coalesce(given, fixture, hint) AS pollster, CASE WHEN given IS NOT NULL THEN 'already_classified' WHEN fixture IS NOT NULL THEN 'fixture' WHEN hint IS NOT NULL THEN 'filename_hint' ELSE 'unresolved' END AS how FROM h""")
def pollster_hints(spark, d):
    """A survey's pollster: given, else by its file in a map, else by a pattern in the file's name, else unresolved."""
    people, key, name = table(spark, d, "customer"), F.col("c_custkey"), F.col("c_name")
    file = F.when(key % 4 == 0, F.concat(F.lit("여론조사꽃_"), name, F.lit(".pdf"))).when(key % 4 == 1, F.concat(name, F.lit(".pdf"))).when(key % 4 == 2, F.concat(F.lit("뉴스1 "), name))
    rows = people.select(key.alias("survey"), F.when(key % 3 == 0, F.col("c_mktsegment")).when(key % 3 == 1, "미분류").otherwise(" ").alias("given"), file.alias("file"))
    fixtures = people.where("c_nationkey < 10").select(F.concat(name, F.lit(".pdf")).alias("file"), F.concat(F.lit("pollster of "), name).alias("fixture"))
    found = rows.join(fixtures, "file", "left")
    given = F.nullif(text.optional_text(F.col("given")), F.lit("미분류"))
    hint = F.when(F.col("file").contains("여론조사꽃"), "여론조사꽃").when(F.col("file").contains("뉴스1"), "(주)한국리서치")
    how = F.when(given.isNotNull(), "already_classified").when(F.col("fixture").isNotNull(), "fixture").when(hint.isNotNull(), "filename_hint").otherwise("unresolved")
    return found.select("survey", F.coalesce(given, F.col("fixture"), hint).alias("pollster"), how.alias("how"))


@query("""
WITH lists AS (
  SELECT l_suppkey AS member_id, count(*) FILTER (l_linenumber = 1) AS bills, count(*) FILTER (l_returnflag = 'A') AS votes, count(DISTINCT l_orderkey % 17) FILTER (l_returnflag = 'N') AS committees, count(*) FILTER (l_returnflag = 'R') AS reports FROM lineitem GROUP BY 1),
e AS (SELECT user_id AS member_id, count(*) FILTER (event_type = 'view') AS speeches, count(*) FILTER (event_type = 'click') AS posts, count(*) FILTER (event_type = 'signup') AS petitions, count(*) FILTER (event_type = 'purchase') AS career, count(*) FILTER (event_type = 'error') AS details FROM events GROUP BY 1)
SELECT s_suppkey AS member_id, s_name AS member, n_name AS party, coalesce(bills, 0) AS bills, coalesce(votes, 0) AS votes, coalesce(committees, 0) AS committees, coalesce(reports, 0) AS reports, coalesce(speeches, 0) AS speeches, coalesce(posts, 0) AS posts, coalesce(petitions, 0) AS petitions, coalesce(career, 0) AS career, coalesce(details, 0) AS details
FROM supplier LEFT JOIN lists ON lists.member_id = s_suppkey LEFT JOIN e ON e.member_id = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def member_fanout(spark, d):
    """A member beside ten sources, each 0 where it has nothing: one pass over the lines, one over the events."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("member_id")).agg(
        F.count_if(line == 1).alias("bills"), F.count_if(flag == "A").alias("votes"), F.count_distinct(F.when(flag == "N", F.col("l_orderkey") % 17)).alias("committees"), F.count_if(flag == "R").alias("reports")
    )
    kinds = {"view": "speeches", "click": "posts", "signup": "petitions", "purchase": "career", "error": "details"}
    acts = events(spark, d).groupBy(F.col("user_id").alias("member_id")).agg(*(F.count_if(F.col("event_type") == kind).alias(name) for kind, name in kinds.items()))
    joined = members(spark, d).join(lines, "member_id", "left").join(acts, "member_id", "left").join(parties(spark, d).select("party_id", "party"), "party_id", "left")
    counted = ("bills", "votes", "committees", "reports", *kinds.values())
    return joined.select("member_id", "member", "party", *(F.coalesce(c, F.lit(0)).alias(c) for c in counted))


@query("""
SELECT n_name AS party, count(s_suppkey) AS n_members, count(s_suppkey) FILTER (s_acctbal < 0) AS proportional, coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (s_acctbal > 7000), '') AS executives FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def party_detail(spark, d):
    """Parties with their members, how many are on the list, and the executives by name."""
    rows = parties(spark, d).select("party_id", "party").join(members(spark, d), "party_id", "left")
    names = F.sort_array(F.collect_list(F.when(F.col("balance") > 7000, F.col("member"))))
    return rows.groupBy("party").agg(F.count("member_id").alias("n_members"), F.count_if(F.col("balance") < 0).alias("proportional"), F.array_join(names, ",").alias("executives"))


@query("""
SELECT o_orderkey AS petition, o_orderstatus AS state, o_orderpriority AS committee, CAST(o_orderdate AS DATE) AS day FROM orders WHERE contains(lower(o_orderpriority), 'high') OR (contains(lower(o_orderpriority), 'low') AND o_orderstatus = 'P')""", dates=("day",))
def petition_list(spark, d):
    """Petitions whose text holds a keyword in any of several fields, case ignored, some with a filter of their own."""
    kind = F.lower("kind")
    found = bills(spark, d).where(kind.contains("high") | (kind.contains("low") & (F.col("stage") == "P")))
    return found.select(F.col("bill_id").alias("petition"), F.col("stage").alias("state"), F.col("kind").alias("committee"), F.col("propose_date").alias("day"))


@query("""
SELECT o_orderpriority AS committee, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS pending, CAST(max(o_orderdate) AS DATE) AS newest FROM orders GROUP BY 1""", dates=("newest",))
def petition_stats(spark, d):
    """Petitions by committee: all, pending, and the newest day."""
    return bills(spark, d).groupBy(F.col("kind").alias("committee")).agg(F.count("*").alias("n"), F.count_if(F.col("stage") == "O").alias("pending"), F.max("propose_date").alias("newest"))


@query("""
SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1999-03-01' AND o_orderstatus = 'F' ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 50""", dates=("day",))
def bounded_bills(spark, d):
    """Bills within optional bounds: a start, no end, a stage and a limit."""
    rows = bills(spark, d).select("bill_id", F.col("propose_date").alias("day"), "stage")
    found = ordering.bounded(rows, "day", start=F.lit("1999-03-01").cast("date"), end=None, equal={"stage": "F", "bill_id": None})
    return found.orderBy("day", "bill_id").limit(50).select("bill_id", "day")


@query("""
SELECT event_id, event_type, user_id FROM events WHERE (event_type IN ('view', 'click') AND user_id % 5 = 3) OR (event_type = 'signup' AND CAST(floor(value) AS BIGINT) % 4 = 1) OR event_type = 'error'""")
def feed_by_party(spark, d):
    """A party's feed: items of each type by the field that names their party; types without one stay."""
    party, kind = F.lit(3), F.col("event_type")
    mine = F.when(kind.isin("view", "click"), F.col("user_id") % 5 == party).when(kind == "signup", F.floor("value") % 4 == 1).when(kind == "error", True).otherwise(False)
    return events(spark, d).where(mine).select("event_id", "event_type", "user_id")


@query("""
SELECT o_orderkey AS id, 'pending' AS list FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' UNION ALL SELECT o_orderkey, 'schedule' FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-05-01' AND DATE '2000-05-31' AND contains(lower(o_orderpriority), 'u')""")
def committee_lists(spark, d):
    """A committee's pending bills, and the month's schedule by keyword."""
    b = bills(spark, d)
    pending = b.where("stage = 'O' AND kind = '2-HIGH'")
    month = b.where("propose_date BETWEEN DATE '2000-05-01' AND DATE '2000-05-31'").where(F.lower("kind").contains("u"))
    return pending.select(F.col("bill_id").alias("id"), F.lit("pending").alias("list")).unionByName(month.select(F.col("bill_id").alias("id"), F.lit("schedule").alias("list")))


@query("""
WITH s AS (SELECT o_custkey AS survey, list_sort(list(DISTINCT o_orderpriority)) AS kinds FROM orders GROUP BY 1)
SELECT survey, array_to_string(kinds, ',') AS kinds, CAST(row_number() OVER (ORDER BY len(kinds) DESC, survey) AS INTEGER) AS place FROM s ORDER BY len(kinds) DESC, survey LIMIT 25""")
def coverage_order(spark, d):
    """The surveys that cover most kinds, fullest first."""
    sets = bills(spark, d).groupBy(F.col("user_id").alias("survey")).agg(F.sort_array(F.collect_set("kind")).alias("k"))
    top = sets.orderBy(F.desc(F.size("k")), "survey").limit(25)
    return top.select("survey", F.array_join("k", ",").alias("kinds"), F.row_number().over(Window.orderBy(F.desc(F.size("k")), "survey")).alias("place"))  # 25 rows


@query("""
WITH p AS (SELECT l_orderkey AS document, l_linenumber AS page, list(DISTINCT l_partkey % 6) AS questions FROM lineitem GROUP BY 1, 2),
n AS (SELECT document, page, questions, lead(questions) OVER (PARTITION BY document ORDER BY page) AS following FROM p)
SELECT document, page, coalesce(list_has_any(questions, following), false) AS goes_on FROM n""")
def page_overlap(spark, d):
    """Whether each page shares a question with the one after it."""
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page")).agg(F.collect_set(F.col("l_partkey") % 6).alias("q"))
    following = F.lead("q").over(Window.partitionBy("document").orderBy("page"))
    return pages.select("document", "page", F.coalesce(F.arrays_overlap("q", following), F.lit(False)).alias("goes_on"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '41' ELSE NULL END AS age, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CAST(CASE WHEN c_custkey % 2 = 0 THEN 41 END AS BIGINT) AS age_number FROM customer""")
def field_map(spark, d):
    """A landed record mapped to a row: blanks become null, except in key columns, and numbers are cast."""
    landed = table(spark, d, "customer").select(
        F.col("c_custkey").alias("huboid"), F.when(F.col("c_custkey") % 2 == 0, " 41 ").otherwise("  ").alias("age"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"),
    )
    fields = {"id": ("huboid", "as is"), "age": ("age", "text"), "name": ("name", "key"), "age_number": ("age", "int")}
    return text.mapped(landed, fields)
