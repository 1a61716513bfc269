"""Core relational queries over the fixture analogue: orders are bills, line items proposals, suppliers members, nations parties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilake.operators import aggregates, joins, ordering
from civilake.plans.registry import Registry
from civilake.session import spread, table

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


def bills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("bill_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("stage"),
        F.col("o_orderdate").cast("date").alias("propose_date"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"),
    )


def proposals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("member_id"), F.col("l_linenumber").alias("line"))


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("member_id"), F.col("s_name").alias("member"), F.col("s_nationkey").alias("party_id"), F.col("s_acctbal").alias("balance")
    )


def parties(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select("r_regionkey", (F.col("r_name") == "EUROPE").alias("parliamentary"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("party_id"), F.col("n_name").alias("party"), F.col("n_regionkey").alias("r_regionkey"))
    return nation.join(F.broadcast(region), "r_regionkey").drop("r_regionkey")  # five regions


@query("""
SELECT count(*) AS total, CAST(sum(CASE WHEN o_orderstatus IN ('O', 'F') THEN 1 ELSE 0 END) AS BIGINT) AS past_committee,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM orders""")
def state_funnel(spark, d):
    return aggregates.funnel(bills(spark, d), {"past_committee": F.col("stage").isin("O", "F"), "passed": F.col("stage") == "F"})


@query("""
SELECT o_orderkey AS bill_id, o_orderstatus AS stage FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 AND l.l_suppkey = 7)""")
def semi_rep_bills(spark, d):
    rep = proposals(spark, d).where("line = 1 AND member_id = 7")
    return bills(spark, d).join(rep, "bill_id", "left_semi").select("bill_id", "stage")


@query("""
SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS propose_date FROM orders
WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 7) AND o_orderstatus = 'F'""", dates=("propose_date",))
def semi_in_distinct(spark, d):
    co = proposals(spark, d).where("member_id = 7")
    return bills(spark, d).where("stage = 'F'").join(co, "bill_id", "left_semi").select("bill_id", "propose_date")


@query("""
SELECT o_orderkey AS bill_id FROM orders o WHERE EXISTS (
  SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 AND n.n_name = 'NATION_3')""")
def two_hop_semi(spark, d):
    own = members(spark, d).join(parties(spark, d).where("party = 'NATION_3'"), "party_id").select("member_id")
    by_party = proposals(spark, d).where("line = 1").join(own, "member_id", "left_semi")
    return bills(spark, d).join(by_party, "bill_id", "left_semi").select("bill_id")


@query("""
SELECT DISTINCT o.o_orderkey AS bill_id, o.o_orderstatus AS stage FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey = 3""")
def join_distinct(spark, d):
    """Inner join and DISTINCT on a key is a semi-join: no row is multiplied first."""
    own = members(spark, d).where("party_id = 3")
    by_party = proposals(spark, d).join(own, "member_id", "left_semi")
    return bills(spark, d).join(by_party, "bill_id", "left_semi").select("bill_id", "stage")


@query("""
SELECT o_orderkey AS bill_id, EXISTS (SELECT 1 FROM orders b JOIN customer c ON b.o_custkey = c.c_custkey
  WHERE b.o_orderkey = o.o_orderkey AND c.c_mktsegment = 'BUILDING') AS liked FROM orders o WHERE o_orderstatus = 'P'""")
def liked_flag(spark, d):
    users = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    likes = bills(spark, d).join(users, "user_id", "left_semi")
    return joins.exists_flag(bills(spark, d).where("stage = 'P'").select("bill_id"), likes, ["bill_id"], "liked")


@query("SELECT o_orderkey AS bill_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_new_rows(spark, d):
    return bills(spark, d).join(proposals(spark, d), "bill_id", "left_anti").select("bill_id")


@query("""
SELECT o_orderkey AS bill_id FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (
  SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_orderkey = o.o_orderkey AND s.s_acctbal > 0)""")
def not_exists_active(spark, d):
    active = proposals(spark, d).join(members(spark, d).where("balance > 0"), "member_id", "left_semi")
    return bills(spark, d).where("stage = 'O'").join(active, "bill_id", "left_anti").select("bill_id")


@query("""
SELECT n.n_nationkey AS party_id, n.n_name AS party, s.s_suppkey AS member_id FROM nation n
LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000""")
def left_outer_party(spark, d):
    rich = members(spark, d).where("balance > 5000").select("party_id", "member_id")
    return parties(spark, d).select("party_id", "party").join(rich, "party_id", "left")


#: Rows of one name and brand that meet as a block; all pairs of blocks are dealt out evenly.
SIMILAR_BLOCK = 1024


@query("""
SELECT a.p_partkey AS id, b.p_partkey AS similar_id FROM part a JOIN part b
ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey""")
def similar_self_join(spark, d):
    """Rows of the same name that are not the row itself, in set form."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    largest = part.groupBy("p_name", "p_brand").count().agg(F.max("count")).first()[0] or 0
    block = F.pmod(F.xxhash64("p_partkey"), F.lit(-(-largest // SIMILAR_BLOCK) or 1))
    blocks = part.groupBy("p_name", "p_brand", block.alias("block")).agg(F.collect_list("p_partkey").alias("ids"))  # about SIMILAR_BLOCK rows
    pairs = blocks.join(blocks.select("p_name", "p_brand", F.col("ids").alias("others")), ["p_name", "p_brand"])
    each = spread(pairs.select("ids", "others")).select(F.explode("ids").alias("id"), "others").select("id", F.explode("others").alias("similar_id"))
    return each.where("id <> similar_id")


@query("""
SELECT bill_id, party_id, votes, CAST(row_number() OVER (PARTITION BY bill_id ORDER BY CASE WHEN party_id = 0 THEN 1 ELSE 0 END, votes DESC, party_id) AS INTEGER) AS rank
FROM (SELECT l_orderkey AS bill_id, s_nationkey AS party_id, count(*) AS votes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      WHERE l_returnflag = 'A' GROUP BY 1, 2)""")
def vote_sort_case(spark, d):
    """Votes in favour by bill and party; independents (party 0) last, then most votes first."""
    ballots = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("member_id"))
    votes = ballots.join(members(spark, d), "member_id").groupBy("bill_id", "party_id").agg(F.count("*").alias("votes"))
    order = [F.when(F.col("party_id") == 0, 1).otherwise(0), F.desc("votes"), F.asc("party_id")]
    return ordering.top_per(votes, ["bill_id"], order, 1 << 30)


@query("""
SELECT n.n_name AS party, count(*) AS n_members FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'EUROPE' GROUP BY n.n_name HAVING count(*) >= 2""")
def party_counts_having(spark, d):
    seats = members(spark, d).join(parties(spark, d).where("parliamentary"), "party_id").groupBy("party").agg(F.count("*").alias("n_members"))
    return seats.where("n_members >= 2")


@query("""
SELECT s_nationkey AS party_id, count(*) FILTER (s_acctbal < 0) AS proportional, count(*) FILTER (s_acctbal >= 0) AS district FROM supplier GROUP BY 1""")
def seat_split_pivot(spark, d):
    return members(spark, d).groupBy("party_id").agg(F.count_if(F.col("balance") < 0).alias("proportional"), F.count_if(F.col("balance") >= 0).alias("district"))


@query("""
SELECT s_nationkey AS party_id, count(DISTINCT l_orderkey) AS n_bills FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def distinct_bills_per_party(spark, d):
    """Bills with at least one proposer now in the party."""
    pairs = proposals(spark, d).join(members(spark, d), "member_id").select("party_id", "bill_id").distinct()
    return pairs.groupBy("party_id").agg(F.count("*").alias("n_bills"))


@query("""
WITH seats AS (SELECT s_nationkey AS party_id, count(*) AS seats FROM supplier WHERE s_acctbal >= 0 GROUP BY 1),
prop AS (SELECT s_nationkey AS party_id, count(*) AS proportional FROM supplier WHERE s_acctbal < 0 GROUP BY 1),
rep AS (SELECT s_nationkey AS party_id, count(*) AS rep_rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1 GROUP BY 1),
pub AS (SELECT s_nationkey AS party_id, count(*) AS public_rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber > 1 GROUP BY 1)
SELECT party_id, CAST(coalesce(seats, 0) AS BIGINT) AS seats, CAST(coalesce(proportional, 0) AS BIGINT) AS proportional,
       CAST(coalesce(rep_rows, 0) AS BIGINT) AS rep_rows, CAST(coalesce(public_rows, 0) AS BIGINT) AS public_rows
FROM seats FULL JOIN prop USING (party_id) FULL JOIN rep USING (party_id) FULL JOIN pub USING (party_id)""")
def stat_refresh_full_outer(spark, d):
    """Proposer rows by the party stored with them; parties absent from all four counts do not appear."""
    own = members(spark, d)
    seats = own.groupBy("party_id").agg(F.count_if(F.col("balance") >= 0).alias("seats"), F.count_if(F.col("balance") < 0).alias("proportional"))
    rows = proposals(spark, d).join(own.select("member_id", "party_id"), "member_id")
    bills_of = rows.groupBy("party_id").agg(F.count_if(F.col("line") == 1).alias("rep_rows"), F.count_if(F.col("line") > 1).alias("public_rows"))
    return joins.combined_counts([seats, bills_of], "party_id")


@query("""
SELECT l_suppkey AS member_id, CAST(max(o_orderdate) AS DATE) AS last_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1""", dates=("last_date",))
def last_date_per_member(spark, d):
    rep = proposals(spark, d).where("line = 1")
    return rep.join(bills(spark, d), "bill_id").groupBy("member_id").agg(F.max("propose_date").alias("last_date"))


@query("SELECT p_brand AS name, min(p_partkey) AS first_order FROM part GROUP BY 1")
def distinct_names_by_min(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("first_order"))


@query("""
SELECT o_orderpriority AS committee, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS bill_ids, count(DISTINCT o_orderkey) AS n_bills
FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 1""")
def group_concat_committee(spark, d):
    """Bill ids of each committee on the last day, in one string (never cut short)."""
    rows = bills(spark, d)
    last = rows.agg(F.max("propose_date").alias("propose_date"))
    day = rows.join(F.broadcast(last), "propose_date")  # one row
    ids = F.sort_array(F.collect_set("bill_id"))
    return day.groupBy(F.col("kind").alias("committee")).agg(F.array_join(ids.cast("array<string>"), ",").alias("bill_ids"), F.size(ids).cast("long").alias("n_bills"))


@query("""
WITH every AS (
  SELECT o_orderkey AS bill_id, 'pending' AS source, 1 AS rank FROM orders WHERE o_orderstatus IN ('O', 'P')
  UNION ALL SELECT o_orderkey, 'processed', 2 FROM orders WHERE o_orderstatus IN ('P', 'F')
  UNION ALL SELECT DISTINCT l_orderkey, 'plenary', 3 FROM lineitem WHERE l_returnflag = 'R')
SELECT bill_id, source FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY rank DESC) AS r FROM every) WHERE r = 1""")
def multi_source_union(spark, d):
    """Candidates of several sources; the last source that has a bill wins."""
    b = bills(spark, d)
    sources = [
        ("pending", b.where("stage IN ('O', 'P')")), ("processed", b.where("stage IN ('P', 'F')")),
        ("plenary", table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("bill_id"))),
    ]
    tagged = [df.select("bill_id", F.lit(rank).alias("rank"), F.lit(name).alias("source")) for rank, (name, df) in enumerate(sources)]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return every.groupBy("bill_id").agg(F.max_by("source", "rank").alias("source"))


@query("""
WITH old AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT id, 'keep' AS action FROM old WHERE id IN (SELECT id FROM new) UNION ALL SELECT id, 'deactivate' FROM old WHERE id NOT IN (SELECT id FROM new)
UNION ALL SELECT id, 'insert' FROM new WHERE id NOT IN (SELECT id FROM old)""")
def intersect_except_sync(spark, d):
    """What a full refresh of members does to each id, by one full outer join."""
    ids = members(spark, d).select(F.col("member_id").alias("id"))
    old, new = ids.where("id % 3 <> 0").withColumn("was", F.lit(True)), ids.where("id % 5 <> 0").withColumn("now", F.lit(True))
    action = F.when(F.col("was") & F.col("now"), "keep").when(F.col("was"), "deactivate").otherwise("insert")
    return old.join(new, "id", "full").select("id", action.alias("action"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY day DESC LIMIT 5 OFFSET 5", dates=("day",))
def paged_distinct_dates(spark, d):
    return bills(spark, d).select(F.col("propose_date").alias("day")).distinct().orderBy(F.desc("day")).offset(5).limit(5)


@query("""
SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS propose_date FROM orders WHERE o_orderdate >= DATE '2000-06-15' ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 1""", dates=("propose_date",))
def nearest_future(spark, d):
    return ordering.nearest_or_latest(bills(spark, d).select("bill_id", "propose_date"), "bill_id", "propose_date", F.lit("2000-06-15").cast("date"))


@query("""
SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS propose_date,
       (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') <= 30 AS is_last_page
FROM orders WHERE o_orderstatus = 'F' ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 10 OFFSET 20""", dates=("propose_date",))
def page_with_lookahead(spark, d):
    passed = bills(spark, d).where("stage = 'F'").select("bill_id", "propose_date")
    return ordering.page(passed, [F.desc("propose_date"), F.desc("bill_id")], 2, 10)


@query("""
SELECT s.s_suppkey AS member_id, s.s_name AS member, n.n_name AS party, coalesce(r.n, 0) AS n_rep, coalesce(p.n, 0) AS n_public, s.s_acctbal < 0 AS proportional
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) r ON r.l_suppkey = s.s_suppkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) p ON p.l_suppkey = s.s_suppkey""")
def member_profile(spark, d):
    """Both proposal counts come from one pass over the proposals."""
    counts = proposals(spark, d).groupBy("member_id").agg(F.count_if(F.col("line") == 1).alias("n_rep"), F.count_if(F.col("line") > 1).alias("n_public"))
    own = members(spark, d).join(parties(spark, d), "party_id").join(counts, "member_id", "left")
    return own.select("member_id", "member", "party", F.coalesce("n_rep", F.lit(0)).alias("n_rep"), F.coalesce("n_public", F.lit(0)).alias("n_public"), (F.col("balance") < 0).alias("proportional"))


@query("""
WITH c AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, year) AS rank FROM c)
SELECT CASE WHEN rank <= 3 THEN year ELSE 'other' END AS year, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def missing_by_year(spark, d):
    return aggregates.top_and_other(bills(spark, d).where("stage = 'O'").withColumn("year", F.year("propose_date")), "year", 3)


@query("""
SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (o_orderstatus = 'O') AS submitted, count(*) FILTER (o_orderstatus = 'P') AS plenary,
       count(*) FILTER (o_orderstatus = 'F') AS promulgated, count(DISTINCT o_orderpriority) AS committees FROM orders GROUP BY 1""", dates=("day",))
def daily_timeline(spark, d):
    counts = {"submitted": "O", "plenary": "P", "promulgated": "F"}
    return bills(spark, d).groupBy(F.col("propose_date").alias("day")).agg(
        *(F.count_if(F.col("stage") == stage).alias(name) for name, stage in counts.items()), F.count_distinct("kind").alias("committees")
    )


@query("""
SELECT o.o_orderkey AS bill_id, o.o_orderstatus AS stage, s.s_name AS representative, coalesce(v.votes, 0) AS votes,
       (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey <> o.o_orderkey) AS n_similar
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN (SELECT l_orderkey, count(*) AS votes FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) v ON v.l_orderkey = o.o_orderkey""")
def bill_detail(spark, d):
    """Details of every bill at once: representative, votes in favour, and how many bills share its owner."""
    b = bills(spark, d)
    lines = table(spark, d, "lineitem")
    rep = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("member_id"))
    rep = rep.join(members(spark, d).select("member_id", F.col("member").alias("representative")), "member_id").drop("member_id")
    votes = lines.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("bill_id")).agg(F.count("*").alias("votes"))
    owners = b.groupBy("user_id").agg((F.count("*") - 1).alias("n_similar"))
    joined = b.join(rep, "bill_id", "left").join(votes, "bill_id", "left").join(owners, "user_id", "left")
    return joined.select("bill_id", "stage", "representative", F.coalesce("votes", F.lit(0)).alias("votes"), "n_similar")


@query("""
WITH liked AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2))
SELECT DISTINCT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS propose_date FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1
WHERE l_suppkey IN (SELECT s_suppkey FROM liked)""", dates=("propose_date",))
def following_feed(spark, d):
    liked = members(spark, d).where("party_id IN (1, 2)")
    theirs = proposals(spark, d).where("line = 1").join(liked, "member_id", "left_semi")
    return bills(spark, d).join(theirs, "bill_id", "left_semi").select("bill_id", "propose_date")
