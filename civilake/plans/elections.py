"""Election reads over the fixture analogue: years of orders are elections, customers candidates, nations districts, regions provinces, orders pledges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civilake.operators import joins, ordering
from civilake.plans.registry import Registry
from civilake.session import table

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles

TODAY = "2000-06-15"

VIEWS = """
WITH codes AS (
  SELECT strftime(o_orderdate, '%Y') AS election_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS typecode, max(substr(o_orderpriority, 3)) AS name, max(CAST(o_orderdate AS DATE)) AS vote_date
  FROM orders GROUP BY 1, 2),
districts AS (SELECT n_nationkey, n_name AS district, r_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey),
candidates AS (
  SELECT c_custkey AS candidate_id, c_name AS candidate, c_mktsegment AS party, district, province, CAST(c_custkey % 12 AS INTEGER) AS typecode,
         CASE WHEN c_acctbal > 9000 THEN 'confirmed' ELSE 'PRELIMINARY' END AS candidate_type, c_acctbal AS support
  FROM customer JOIN districts ON n_nationkey = c_nationkey),
pledges AS (SELECT o_custkey AS candidate_id, o_orderkey AS ord, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'P')"""


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Elections by type: one row for each election and type code."""
    kind = F.col("o_orderpriority")
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("election_id"), (F.substring(kind, 1, 1).cast("int") - 1).alias("typecode")).agg(
        F.max(F.expr("substr(o_orderpriority, 3)")).alias("name"), F.max(F.col("o_orderdate").cast("date")).alias("vote_date")
    )


def districts(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("province"))
    return table(spark, d, "nation").join(F.broadcast(region), "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("district"), "province")  # five regions


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(districts(spark, d), "c_nationkey").select(
        F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("candidate"), F.col("c_mktsegment").alias("party"), "district", "province",
        (F.col("c_custkey") % 12).cast("int").alias("typecode"), F.when(F.col("c_acctbal") > 9000, "confirmed").otherwise("PRELIMINARY").alias("candidate_type"), F.col("c_acctbal").alias("support"),
    )


def pledges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"))


@query(VIEWS + f""",
e AS (SELECT election_id, name, vote_date FROM codes WHERE typecode = 0)
SELECT election_id, name, vote_date, vote_date > DATE '{TODAY}' AS upcoming, CAST(row_number() OVER (ORDER BY vote_date DESC, election_id) AS INTEGER) AS place,
       election_id = coalesce((SELECT arg_min(election_id, vote_date) FROM e WHERE vote_date >= DATE '{TODAY}'), (SELECT arg_max(election_id, vote_date) FROM e)) AS is_default FROM e""", dates=("vote_date",))
def election_selector(spark, d):
    """Representative elections, newest vote first; the default is the next one, or else the newest. The window sees one row an election."""
    own = codes(spark, d).where("typecode = 0").select("election_id", "name", "vote_date")
    today = F.lit(TODAY).cast("date")
    ahead = F.when(F.col("vote_date") >= today, F.struct("vote_date", "election_id"))
    chosen = own.agg(F.coalesce(F.min(ahead)["election_id"], F.max(F.struct("vote_date", "election_id"))["election_id"]).alias("chosen"))
    rank = F.row_number().over(Window.orderBy(F.desc("vote_date"), "election_id"))
    listed = own.join(F.broadcast(chosen))  # one row
    return listed.select("election_id", "name", "vote_date", (F.col("vote_date") > today).alias("upcoming"), rank.alias("place"), (F.col("election_id") == F.col("chosen")).alias("is_default"))


@query(VIEWS + f"""
SELECT election_id, typecode, CAST(row_number() OVER (ORDER BY CASE WHEN election_id = '2001' THEN 0 WHEN vote_date > DATE '{TODAY}' THEN 1 ELSE 2 END, vote_date DESC, name, election_id, typecode) AS INTEGER) AS place FROM codes""")
def election_list_order(spark, d):
    """Elections by priority (the coming local one, other coming ones, the rest), newest first, then by name in Korean order."""
    priority = F.when(F.col("election_id") == "2001", 0).when(F.col("vote_date") > F.lit(TODAY).cast("date"), 1).otherwise(2)
    order = Window.orderBy(priority, F.desc("vote_date"), F.collate("name", "ko"), "election_id", "typecode")  # one row an election
    return codes(spark, d).select("election_id", "typecode", F.row_number().over(order).alias("place"))


@query(VIEWS + """
SELECT election_id, CASE WHEN count(*) FILTER (typecode = 1) > 0 THEN 'CANDIDATE' ELSE 'REGIONAL' END AS template, coalesce(max(name) FILTER (typecode = 0), 'election') AS title, 'PROVINCE' AS region_type, '' AS region_code FROM codes GROUP BY 1""")
def election_overview(spark, d):
    """How each election is shown: by candidate if it is presidential (type 1), else by region; its title is that of type 0."""
    presidential = F.max((F.col("typecode") == 1).cast("int")) == 1
    title = F.coalesce(F.max(F.when(F.col("typecode") == 0, F.col("name"))), F.lit("election"))
    shown = codes(spark, d).groupBy("election_id").agg(F.when(presidential, "CANDIDATE").otherwise("REGIONAL").alias("template"), title.alias("title"))
    return shown.select("*", F.lit("PROVINCE").alias("region_type"), F.lit("").alias("region_code"))


@query(VIEWS + """,
own AS (SELECT * FROM candidates WHERE typecode = 3 AND province = 'EUROPE')
SELECT candidate_id, candidate, party, candidate_type FROM own WHERE upper(candidate_type) = 'CONFIRMED' OR NOT EXISTS (SELECT 1 FROM own WHERE upper(candidate_type) = 'CONFIRMED')""")
def election_candidates(spark, d):
    """A province's candidates for an office: the confirmed ones, or all while none is confirmed."""
    own = candidates(spark, d).where("typecode = 3 AND province = 'EUROPE'")
    shown = joins.preferred_or_all(own, ["typecode", "province"], F.upper("candidate_type") == "CONFIRMED")
    return shown.select("candidate_id", "candidate", "party", "candidate_type")


@query(VIEWS + """
SELECT c.candidate_id, c.candidate, c.party, c.district, c.province, coalesce(string_agg(p.ord || ':' || p.title, '|' ORDER BY p.ord), '') AS manifesto, count(p.ord) AS n_pledges
FROM candidates c LEFT JOIN pledges p ON p.candidate_id = c.candidate_id GROUP BY 1, 2, 3, 4, 5""")
def candidate_detail(spark, d):
    """Every candidate with the pledges in their order; none gives an empty list."""
    found = joins.nested(candidates(spark, d), pledges(spark, d), "candidate_id", F.struct("ord", "title"), "items")
    text = F.array_join(F.transform("items", lambda p: F.concat_ws(":", p["ord"], p["title"])), "|")
    return found.select("candidate_id", "candidate", "party", "district", "province", text.alias("manifesto"), F.size("items").cast("bigint").alias("n_pledges"))


@query(VIEWS + """,
support AS (SELECT candidate, max(support) AS percentage FROM candidates WHERE support > 5000 GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ord) AS r FROM pledges),
two AS (SELECT candidate_id, string_agg(title, '|' ORDER BY ord) AS pledges FROM ranked WHERE r <= 2 GROUP BY 1)
SELECT c.candidate_id, c.candidate, s.percentage, coalesce(t.pledges, '') AS pledges FROM candidates c LEFT JOIN support s ON s.candidate = c.candidate LEFT JOIN two t ON t.candidate_id = c.candidate_id""")
def candidate_support(spark, d):
    """Candidates with their support by name (null while not polled) and their first two pledges."""
    own = candidates(spark, d)
    polled = own.where("support > 5000").groupBy("candidate").agg(F.max("support").alias("percentage"))
    two = ordering.top_per(pledges(spark, d), ["candidate_id"], [F.asc("ord")], 2)
    found = joins.nested(own.join(polled, "candidate", "left"), two, "candidate_id", F.struct("ord", "title"), "items")
    return found.select("candidate_id", "candidate", "percentage", F.array_join(F.transform("items", lambda p: p["title"]), "|").alias("pledges"))


@query(VIEWS + """
SELECT 1 AS depth, p.province AS region, coalesce(c.n, 0) AS value FROM (SELECT DISTINCT province FROM districts) p LEFT JOIN (SELECT province, count(*) AS n FROM candidates WHERE typecode = 3 GROUP BY 1) c ON c.province = p.province
UNION ALL SELECT 2, district, n_nationkey % 4 + 1 FROM districts WHERE province = 'ASIA'""")
def election_map(spark, d):
    """Provinces with their candidates (0 where none), and one province's districts with their seats."""
    places = districts(spark, d)
    counts = candidates(spark, d).where("typecode = 3").groupBy("province").agg(F.count("*").alias("n"))
    outer = places.select("province").distinct().join(counts, "province", "left").select(F.lit(1).alias("depth"), F.col("province").alias("region"), F.coalesce("n", F.lit(0)).alias("value"))
    seats = (F.col("c_nationkey") % 4 + 1).cast("bigint")
    return outer.unionByName(places.where("province = 'ASIA'").select(F.lit(2).alias("depth"), F.col("district").alias("region"), seats.alias("value")))


@query(VIEWS + """
SELECT province, coalesce(CAST(typecode AS VARCHAR), 'total') AS office, count(*) AS n FROM candidates WHERE typecode NOT IN (0, 1, 2, 7) GROUP BY GROUPING SETS ((province, typecode), (province))""")
def region_panel(spark, d):
    """Candidates of each province by local office, and their total, in one pass."""
    local = candidates(spark, d).where("typecode NOT IN (0, 1, 2, 7)").select("province", F.col("typecode").cast("string").alias("office"))
    counts = local.groupingSets([["province", "office"], ["province"]], "province", "office").agg(F.count("*").alias("n"))
    return counts.select("province", F.coalesce("office", F.lit("total")).alias("office"), "n")


@query("""
WITH r AS (SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment END AS code, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer)
SELECT request, CASE WHEN coalesce(code, '') <> '' THEN 'gps-suggested' ELSE 'manual-required' END AS state, coalesce(code, '') <> '' AS confirmation_required,
       CASE WHEN coalesce(code, '') <> '' THEN coalesce(name, code) END AS suggested FROM r""")
def region_resolve(spark, d):
    """A region that is given is suggested for confirmation under its name or code; without one the user is asked."""
    code = F.when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), code.alias("code"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    given = F.coalesce(F.col("code"), F.lit("")) != ""
    return asked.select("request", F.when(given, "gps-suggested").otherwise("manual-required").alias("state"), given.alias("confirmation_required"), F.when(given, F.coalesce("name", "code")).alias("suggested"))


@query(VIEWS + """
SELECT c.candidate_id, d.vote_date FROM candidates c JOIN codes d ON d.typecode = c.typecode AND d.election_id = '1998' WHERE c.province = 'ASIA' AND c.typecode = 3""", dates=("vote_date",))
def election_finder(spark, d):
    """Rows by one to four equality keys over both tables."""
    own = candidates(spark, d).where("province = 'ASIA' AND typecode = 3").select("candidate_id", "typecode")
    return own.join(codes(spark, d).where("election_id = '1998'"), "typecode").select("candidate_id", "vote_date")


@query(VIEWS + """,
own AS (SELECT *, row_number() OVER (PARTITION BY province ORDER BY support DESC, candidate_id) AS r FROM candidates)
SELECT province, candidate_id AS winner_id, support, (SELECT count(*) FROM candidates x WHERE x.province = own.province) AS stood FROM own WHERE r = 1""")
def election_winners(spark, d):
    """Each province's winner, with how many stood."""
    best = F.max(F.struct("support", (-F.col("candidate_id")).alias("k"))).alias("x")
    return candidates(spark, d).groupBy("province").agg(best, F.count("*").alias("stood")).select("province", (-F.col("x.k")).alias("winner_id"), "x.support", "stood")
