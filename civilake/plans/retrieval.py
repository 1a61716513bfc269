"""Search, retrieval and report queries: vector neighbours, context texts, tracking, samples, coverage, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from civilake.operators import aggregates, joins, ordering, retrieval, vectors
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.plans.relational import bills, members, parties, proposals
from civilake.session import table, work_path

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v), 6) AS score FROM embeddings e, q ORDER BY score DESC, e.vec_id LIMIT 10""")
def vector_topk(spark, d):
    """The ten vectors nearest to one query vector by cosine."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    wanted = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return retrieval.nearest(rows, wanted, "vec_id", "embedding", "q", 10)


def vector_file(spark, d) -> vectors.Cells:
    return vectors.build(table(spark, d, "embeddings"), "vec_id", "embedding", work_path(spark, "vector-cells"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM v q, v e WHERE q.vec_id % 100 = 7),
r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, id, score FROM s WHERE score >= 0.3)
SELECT query, CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= 10""")
def vector_cells(spark, d):
    """The ten nearest of a hundredth of the vectors, none under a threshold, exact by the cells' radii."""
    index = vector_file(spark, d)
    asked = vectors.usable(table(spark, d, "embeddings").where("vec_id % 100 = 7"), "vec_id", "embedding")
    return vectors.search(index, asked, 10, 0.3)


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 3),
w AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 <> 2 AND vec_id % 10 <> 3
  UNION ALL SELECT vec_id + 1000000, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 10 = 1
  UNION ALL SELECT vec_id - 1, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 10 = 3)
SELECT CAST(3 AS BIGINT) AS query, CAST(row_number() OVER (ORDER BY round(list_cosine_similarity(w.v, q.v), 6) DESC, id) AS INTEGER) AS rank, id, round(list_cosine_similarity(w.v, q.v), 6) AS score
FROM w, q QUALIFY rank <= 20""")
def vector_merge(spark, d):
    """The nearest after an upsert: some vectors are added, some replaced, and cells that neither concerns stay as they were written."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vectors.build(rows.where("vec_id % 10 <> 3"), "vec_id", "embedding", work_path(spark, "vector-cells"))
    added = rows.where("vec_id % 10 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    replaced = rows.where("vec_id % 10 = 3").withColumn("vec_id", F.col("vec_id") - 1)
    index = vectors.upsert(index, added.unionByName(replaced), "vec_id", "embedding", work_path(spark, "vector-upsert"))
    return vectors.search(index, vectors.usable(rows.where("vec_id = 3"), "vec_id", "embedding"), 20)


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
n AS (SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v), 6) AS score FROM embeddings e, q ORDER BY score DESC, e.vec_id LIMIT 3)
SELECT string_agg('[' || vec_id || '] ' || text, chr(10) || chr(10) ORDER BY score DESC, vec_id) AS context, count(*) AS n FROM n JOIN documents ON doc_id = vec_id WHERE score >= 0.2""")
def rag_context(spark, d):
    """The nearest documents over a threshold as one context text, best first; found in the inverted file."""
    asked = vectors.usable(table(spark, d, "embeddings").where("vec_id = 0"), "vec_id", "embedding")
    found = vectors.search(vector_file(spark, d), asked, 3, 0.2).withColumnRenamed("id", "vec_id")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    named = texts.join(F.broadcast(found), "vec_id").withColumn("line", F.concat(F.lit("["), "vec_id", F.lit("] "), "text"))  # three rows
    return retrieval.context(named, F.col("score"), F.col("vec_id"), F.col("line"))


@query("""
SELECT doc_id AS id, 'lang: ' || coalesce(lang, '-') || ' | source: ' || coalesce(source, '-') || ' | ' || replace(text, chr(10), ' ') AS input FROM documents WHERE trim(text) <> ''""")
def embedding_text(spark, d):
    """What is embedded: labelled fields on one line; blank texts are left out."""
    line = F.concat(F.lit("lang: "), F.coalesce("lang", F.lit("-")), F.lit(" | source: "), F.coalesce("source", F.lit("-")), F.lit(" | "), F.translate("text", "\n", " "))
    return table(spark, d, "documents").where("trim(text) <> ''").select(F.col("doc_id").alias("id"), line.alias("input"))


@query("""
WITH hits AS (SELECT p_partkey AS id, 0 AS word FROM part WHERE contains(lower(p_name), 'ring') UNION ALL SELECT p_partkey, 1 FROM part WHERE contains(lower(p_name), 'red')),
first AS (SELECT id, min(word) AS word FROM hits GROUP BY 1)
SELECT f.id, CASE f.word WHEN 0 THEN 'ring' ELSE 'red' END AS keyword, count(l.l_orderkey) AS history FROM (SELECT * FROM first ORDER BY id DESC LIMIT 5) f LEFT JOIN lineitem l ON l.l_partkey = f.id GROUP BY 1, 2""")
def keyword_track(spark, d):
    """The five newest items that any of a few keywords finds, each once under its first keyword, with the length of their history."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    first = retrieval.first_keyword(rows, F.col("name"), ["ring", "red"]).orderBy(F.desc("id")).limit(5).select("id", "keyword")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"))
    counts = lines.join(F.broadcast(first.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))  # five rows
    return first.join(counts, "id", "left").select("id", "keyword", F.coalesce("n", F.lit(0)).alias("history"))


@query("""
WITH r AS (SELECT l_suppkey AS member_id, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS place FROM lineitem WHERE l_linenumber = 1)
SELECT member_id, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) FILTER (place <= 3) AS samples FROM r GROUP BY 1 ORDER BY n DESC, member_id LIMIT 10""")
def proposer_group_samples(spark, d):
    rep = proposals(spark, d).where("line = 1")
    return aggregates.samples_per(rep, "member_id", F.col("bill_id"), 3, 10)


@query("""
WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS covered FROM documents GROUP BY 1)
SELECT source, n, covered, round(100.0 * covered / n, 4) AS share FROM c""")
def coverage_report(spark, d):
    marked = joins.exists_flag(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"], "covered")
    counts = marked.groupBy("source").agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"))
    return counts.withColumn("share", F.round(100.0 * F.col("covered") / F.col("n"), 4))


@query("""
SELECT l_suppkey AS member_id, l_orderkey AS item, 'bill' AS kind FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey, l_orderkey, 'vote' FROM lineitem WHERE l_returnflag = 'A'""")
def activity_feed(spark, d):
    lines = table(spark, d, "lineitem")
    tagged = lambda rows, kind: rows.select(F.col("l_suppkey").alias("member_id"), F.col("l_orderkey").alias("item"), F.lit(kind).alias("kind"))
    return tagged(lines.where("l_linenumber = 1"), "bill").unionByName(tagged(lines.where("l_returnflag = 'A'"), "vote"))


@query("""
WITH b AS (SELECT l_suppkey, list(DISTINCT l_orderkey ORDER BY l_orderkey DESC)[1:3] AS ids FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT s.s_suppkey AS member_id, s.s_name AS member, coalesce(array_to_string(b.ids, ','), '') AS last_bills, n.n_name AS party FROM supplier s LEFT JOIN b ON b.l_suppkey = s.s_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def profile_fanout(spark, d):
    """A member beside what other sources hold; a source without rows gives an empty list."""
    rep = proposals(spark, d).where("line = 1").select("member_id", "bill_id").distinct()
    top = ordering.top_per(rep, ["member_id"], [F.desc("bill_id")], 3)
    lists = top.groupBy("member_id").agg(F.array_join(F.reverse(F.sort_array(F.collect_list("bill_id"))).cast("array<string>"), ",").alias("last_bills"))
    joined = members(spark, d).join(lists, "member_id", "left").join(parties(spark, d).select("party_id", "party"), "party_id", "left")
    return joined.select("member_id", "member", F.coalesce("last_bills", F.lit("")).alias("last_bills"), "party")


@query(r"""
WITH h AS (SELECT o_orderkey AS bill_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(CAST(o_orderkey AS VARCHAR) AS BLOB)) AS x FROM orders)
SELECT bill_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(x, 17, 1)), 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS uuid FROM h""")
def deterministic_uuid(spark, d):
    """UUIDv5 ids of bills: the same in every run."""
    return bills(spark, d).select("bill_id", retrieval.uuid5(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.col("bill_id").cast("string")).alias("uuid"))


@query("""
SELECT s_suppkey AS id, s_name AS name, 'member' AS kind FROM supplier WHERE contains(lower(s_name), '00001') UNION ALL SELECT n_nationkey, n_name, 'party' FROM nation WHERE contains(lower(n_name), '1')""")
def member_party_search(spark, d):
    """One result of two searches, case ignored."""
    found = members(spark, d).where(F.lower("member").contains("00001")).select(F.col("member_id").alias("id"), F.col("member").alias("name"), F.lit("member").alias("kind"))
    named = parties(spark, d).where(F.lower("party").contains("1")).select(F.col("party_id").cast("bigint").alias("id"), F.col("party").alias("name"), F.lit("party").alias("kind"))
    return found.unionByName(named)


@query("""
SELECT CASE WHEN turn = 0 THEN 'opening' ELSE role END AS part, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def conversation_parts(spark, d):
    part = F.when(F.col("turn") == 0, "opening").otherwise(F.col("role"))
    return table(spark, d, "conversations").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("""
SELECT n_name AS district, coalesce(c.n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) c ON c.s_nationkey = n_nationkey""")
def district_map(spark, d):
    """Every district with its count, 0 where there is none."""
    counts = members(spark, d).where("balance > 8000").groupBy("party_id").agg(F.count("*").alias("n"))
    return parties(spark, d).join(counts, "party_id", "left").select(F.col("party").alias("district"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT user_id, coalesce(event_type, 'total') AS event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY GROUPING SETS ((user_id, event_type), (user_id))""")
def office_counts(spark, d):
    """Counts by kind without the excluded kinds, and their total, in one pass; kinds without rows do not appear."""
    counts = events(spark, d).where(~F.col("event_type").isin("error", "view")).groupingSets([["user_id", "event_type"], ["user_id"]], "user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.coalesce("event_type", F.lit("total")).alias("event_type"), "n")
