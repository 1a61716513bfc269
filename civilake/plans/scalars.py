"""Queries on cleaning and extraction: text, numbers, dates, names, titles, JSON, HTML and cross-tab cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.functions import bills as bill_rules
from civilake.functions import dates, polls, text
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.plans.relational import bills
from civilake.session import table

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles


def choice(key: Column, values: list[str | None]) -> Column:
    """One of a few literals by the remainder of a key."""
    out = F.lit(None).cast("string")
    for at, value in enumerate(values):
        out = F.when(key % len(values) == at, F.lit(value)).otherwise(out)
    return out


def choice_sql(key: str, values: list[str | None]) -> str:
    """The same for an oracle."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    arms = " ".join(f"WHEN {at} THEN {v}" for at, v in enumerate(quoted))
    return f"CASE {key} % {len(values)} {arms} END"


def parts(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size")


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, length(line) AS n, CASE WHEN length(line) <= 120 THEN line ELSE rtrim(substring(line, 1, 117)) || '...' END AS brief FROM t""")
def text_clean(spark, d):
    """White space squashed, and a short form of at most 120 characters."""
    line = text.squashed(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(line).cast("bigint").alias("n"), text.shortened(F.col("text")).alias("brief"))


@query(r"""
WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN format('{:,}', p_partkey * 1234) WHEN 1 THEN p_size || '.0' WHEN 2 THEN p_name WHEN 3 THEN ' ' || p_size || ' ' END AS raw FROM part)
SELECT id, CAST(coalesce(TRY_CAST(CASE WHEN regexp_full_match(replace(trim(raw), ',', ''), '-?[0-9]+') THEN replace(trim(raw), ',', '') END AS BIGINT), 0) AS BIGINT) AS n,
       nullif(regexp_replace(trim(raw), '\.0$', ''), '') AS number FROM t""")
def safe_int_cast(spark, d):
    """Numbers with thousands commas, bill numbers with a trailing .0, texts that are none."""
    key, size = F.col("id"), F.col("p_size")
    raw = F.when(key % 5 == 0, F.format_number(key * 1234, 0)).when(key % 5 == 1, F.concat(size, F.lit(".0"))).when(key % 5 == 2, F.col("p_name")).when(key % 5 == 3, F.concat(F.lit(" "), size, F.lit(" ")))
    return parts(spark, d).select("id", text.safe_int(raw).alias("n"), text.bill_number(raw).alias("number"))


@query("""
SELECT o_orderkey AS bill_id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""", dates=("day",))
def multi_date_parse(spark, d):
    """Dates of three notations; anything else is null."""
    when = F.col("propose_date")
    forms = [F.date_format(when, "yyyy-MM-dd"), F.date_format(when, "yyyy.MM.dd"), F.date_format(when, "yyyyMMdd")]
    raw = F.lit("undated")
    for at, form in enumerate(forms):
        raw = F.when(F.col("bill_id") % 4 == at, form).otherwise(raw)
    return bills(spark, d).select("bill_id", dates.multi_date(raw).alias("day"))


@query("""
SELECT o_orderkey AS bill_id, CASE WHEN o_orderkey % 11 = 0 THEN '철회' WHEN o_orderstatus = 'F' THEN '공포' WHEN o_orderstatus = 'P' THEN '본회의심의' WHEN o_totalprice > 100000 THEN '체계자구심사' ELSE '접수' END AS stage FROM orders""")
def stage_derivation(spark, d):
    stage = bill_rules.derived_stage(
        F.col("bill_id") % 11 == 0, ("공포", F.col("stage") == "F"), ("본회의심의", F.col("stage") == "P"), ("체계자구심사", F.col("price") > 100000)
    )
    return bills(spark, d).select("bill_id", stage.alias("stage"))


@query("""
WITH f AS (SELECT o_orderkey AS bill_id, o_orderkey % 2 = 0 AS name, o_orderkey % 7 <> 0 AS dated, o_orderkey % 7 <> 0 OR o_orderstatus = 'F' AS stage, o_orderkey % 3 <> 0 AS summary FROM orders)
SELECT bill_id, CASE WHEN name AND dated AND stage AND summary THEN 'READY' WHEN name OR dated OR stage OR summary THEN 'PARTIAL' ELSE 'PENDING' END AS status FROM f""")
def ingest_status(spark, d):
    """READY with every field, PARTIAL with some, PENDING with none; blank text counts as missing."""
    key, there = F.col("bill_id"), F.col("bill_id") % 7 != 0
    fields = (F.when(key % 2 == 0, "name").otherwise("  "), F.when(there, F.col("propose_date")), F.when(there | (F.col("stage") == "F"), F.col("stage")), F.when(key % 3 == 0, "").otherwise("summary"))
    return bills(spark, d).select("bill_id", bill_rules.ingest_status(*fields).alias("status"))


def listed(values) -> str:
    """A list of texts for an oracle."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def one_of(values, at: Column) -> Column:
    """One of a list of texts by a number from 0."""
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


@query(f"""
WITH n AS (SELECT p_partkey AS id, p_name, {listed(polls.PARTIES)}[1 + p_partkey % {len(polls.PARTIES)}] AS party FROM part),
r AS (SELECT id, CASE id % 3 WHEN 0 THEN substring(party, 1, 2) || ' ' || substring(party, 3) WHEN 1 THEN ' ' || p_name || ' ' ELSE '  ' || party || ' ' END AS raw FROM n)
SELECT id, CASE WHEN list_contains({listed(polls.PARTIES)}, replace(raw, ' ', '')) THEN replace(raw, ' ', '') ELSE trim(raw) END AS party FROM r""")
def party_canonical(spark, d):
    """Parties whatever the spaces in their names; other names as they are, trimmed."""
    key, party = F.col("id"), one_of(polls.PARTIES, F.col("id") % len(polls.PARTIES))
    split = F.concat(F.substring(party, 1, 2), F.lit(" "), F.substring(party, 3, 100))
    raw = F.when(key % 3 == 0, split).when(key % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(F.concat(F.lit("  "), party, F.lit(" ")))
    return parts(spark, d).select("id", polls.party_name(raw).alias("party"))


QUESTIONS = ["정당 지지도", "지지 정당", "후보 적합도", "후보지지도", "누가 가장 적합", "가상 대결", "양자대결", "누구에게 투표", "맞붙는다 면", "직무 평가", "정책"]


@query(f"""
WITH t AS (SELECT p_partkey AS id, replace(p_name || {listed(QUESTIONS)}[1 + p_partkey % 11] || CASE WHEN p_size % 2 = 0 THEN p_brand || {listed(QUESTIONS)}[1 + p_size % 11] ELSE '' END, ' ', '') AS t FROM part)
SELECT id, CASE WHEN regexp_matches(t, '정당지지도|지지정당') THEN 'PARTY_SUPPORT' WHEN regexp_matches(t, '후보적합도|후보지지도|누가가장적합') THEN 'CANDIDATE_FIT' WHEN regexp_matches(t, '가상대결|양자대결|누구에게투표|맞붙는다면') THEN 'MATCHUP' ELSE 'OTHER' END AS kind FROM t""")
def question_classify(spark, d):
    """The first kind whose words a title holds; some titles hold the words of two kinds."""
    more = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_brand"), F.lit(" "), one_of(QUESTIONS, F.col("p_size") % 11))).otherwise("")
    title = F.concat_ws(" ", "p_name", one_of(QUESTIONS, F.col("id") % 11), more)
    return parts(spark, d).select("id", polls.question_kind(title).alias("kind"))


@query(r"""
WITH e AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '전국 ' || p_name WHEN 1 THEN p_brand || ' 전체  ' || p_name WHEN 2 THEN p_brand || ' ' || p_size || '시 ' || p_name WHEN 3 THEN p_brand || ' ' || p_size || '동' WHEN 4 THEN replace(p_name, ' ', '-') ELSE p_brand || '  ' || p_name END AS raw FROM part),
t AS (SELECT id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM e), s AS (SELECT id, t, string_split(t, ' ') AS p, instr(t, ' 전체') AS whole, regexp_matches(coalesce(string_split(t, ' ')[2], ''), '[시군구읍면동리]$') AS suffix FROM t)
SELECT id, CASE WHEN p[1] = '전국' THEN p[1] WHEN whole > 0 THEN substring(t, 1, whole + 2) WHEN suffix THEN p[1] || ' ' || p[2] WHEN len(p) >= 2 THEN p[1] ELSE '' END AS region,
       CASE WHEN p[1] = '전국' THEN array_to_string(p[2:], ' ') WHEN whole > 0 THEN trim(substring(t, whole + 3)) WHEN suffix THEN array_to_string(p[3:], ' ') WHEN len(p) >= 2 THEN array_to_string(p[2:], ' ') ELSE t END AS election FROM s""")
def title_region_split(spark, d):
    """Region and election of list entries: nationwide, of a whole province, of a town, of one word."""
    key, brand, size, name = F.col("id"), F.col("p_brand"), F.col("p_size"), F.col("p_name")
    town = lambda mark, *rest: F.concat(brand, F.lit(" "), size, F.lit(mark), *rest)
    entry = F.when(key % 6 == 0, F.concat(F.lit("전국 "), name)).when(key % 6 == 1, F.concat(brand, F.lit(" 전체  "), name)).when(key % 6 == 2, town("시 ", name)).when(key % 6 == 3, town("동"))
    region, election = polls.title_region(entry.when(key % 6 == 4, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(F.concat(brand, F.lit("  "), name)))
    return parts(spark, d).select("id", region.alias("region"), election.alias("election"))


PEOPLE = ["김철수", "이영희", "박민수", "최유리"]


@query(f"""
SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN {listed(PEOPLE)}[1 + p_size % 4] || '의원 등 ' || p_size || '인' WHEN 1 THEN '정부' WHEN 2 THEN '대안' END AS proposers,
       CASE WHEN p_partkey % 4 = 0 THEN {listed(PEOPLE)}[1 + p_size % 4] ELSE '' END AS members FROM part""")
def regex_extract_names(spark, d):
    """A bill's bare name, the proposers that its name ends with, and the members among them."""
    key = F.col("id")
    inside = F.when(key % 4 == 0, F.concat(one_of(PEOPLE, F.col("p_size") % 4), F.lit("의원 등 "), F.col("p_size"), F.lit("인"))).when(key % 4 == 1, "정부").when(key % 4 == 2, "대안")
    raw = F.concat(F.col("p_name"), F.coalesce(F.concat(F.lit("("), inside, F.lit(")")), F.lit("")))
    return parts(spark, d).select(
        "id", bill_rules.bare_name(raw).alias("name"), bill_rules.proposers_in_name(raw).alias("proposers"), F.array_join(bill_rules.member_names(raw), ",").alias("members")
    )


@query(r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host FROM pages")
def url_params(spark, d):
    host = F.nullif(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", text.url_param(F.col("url"), "page").alias("page"), host.alias("host"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{"k":' || (props->>'$.k') || '}' AS again FROM events""")
def json_roundtrip(spark, d):
    parsed = F.from_json("props", "k bigint")
    return table(spark, d, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.to_json("p").alias("again"))


@query("""
SELECT p_partkey AS id, 1 AS place, p_name AS title FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 3, p_type FROM part WHERE p_size > 30""")
def unpivot_numbered(spark, d):
    """Numbered columns as rows; blank ones are left out."""
    wide = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("t1"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("").alias("t2"), F.when(F.col("p_size") > 30, F.col("p_type")).alias("t3")
    )
    return wide.unpivot("id", ["t1", "t2", "t3"], "place", "title").where("title <> ''").withColumn("place", F.substring("place", 2, 1).cast("int"))


@query("""
WITH t AS (SELECT doc_id, lang, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS in_text, CASE WHEN contains(lower(source), 'the') THEN 1 ELSE 0 END AS in_source FROM documents)
SELECT doc_id, lang, in_text, in_source FROM t WHERE in_text > 0 OR in_source > 0""")
def search_keyword(spark, d):
    """Documents that hold a word in any of several columns, with the hits in each."""
    hits = F.floor((F.length("text") - F.length(F.replace(F.lower("text"), F.lit("the"), F.lit("")))) / 3)
    found = table(spark, d, "documents").select("doc_id", "lang", hits.alias("in_text"), F.lower("source").contains("the").cast("int").alias("in_source"))
    return found.where("in_text > 0 OR in_source > 0")


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""")
def page_summary(spark, d):
    pages = table(spark, d, "pages")
    count = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("bigint")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), count("<a href=").alias("n_links"), count("<p>").alias("n_paragraphs"))


@query("""
WITH v AS (SELECT l_orderkey AS id, list(CASE WHEN l_linenumber % 4 = 3 THEN -l_quantity ELSE l_quantity * 3 END) FILTER (l_returnflag <> 'N') AS x, count(*) AS n FROM lineitem GROUP BY 1),
w AS (SELECT id, coalesce(x, []) AS x, n, CASE WHEN id % 5 = 0 THEN n - 1 WHEN id % 11 = 0 THEN 0 ELSE len(coalesce(x, [])) END AS options FROM v)
SELECT id, concat_ws(',', CASE WHEN options <> len(x) THEN 'count_mismatch' END, CASE WHEN n < 3 THEN 'few_respondents' END, CASE WHEN list_min(x) < 0 THEN 'negative_value' END,
  CASE WHEN options = 0 THEN 'no_options' END, CASE WHEN id % 4 = 0 THEN 'no_title' END, CASE WHEN len(x) = 0 THEN 'no_values' END, CASE WHEN id % 3 = 0 THEN 'number_below_1' END,
  CASE WHEN len(x) > 0 AND (list_sum(x) < 75 OR list_sum(x) > 115) THEN 'sum_out_of_range' END, CASE WHEN list_max(x) > 100 THEN 'value_over_100' END) AS errors FROM w""")
def poll_validation(spark, d):
    """The rules that a question's number, title, options, values and respondents break; each of the nine is broken by some."""
    value = F.when(F.col("l_linenumber") % 4 == 3, -F.col("l_quantity")).otherwise(F.col("l_quantity") * 3)
    grouped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_returnflag") != "N", value)).alias("x"), F.count("*").cast("int").alias("n"))
    key, n = F.col("id"), F.col("n")
    options = F.array_repeat(F.lit("option"), F.when(key % 5 == 0, n - 1).when(key % 11 == 0, 0).otherwise(F.size("x")))
    errors = polls.question_errors(F.when(key % 3 == 0, 0).otherwise(1), F.when(key % 4 == 0, " ").otherwise("title"), options, F.col("x"), F.when(n < 3, 10).otherwise(500))
    return grouped.select("id", F.array_join(errors, ",").alias("errors"))


@query("""
SELECT p_partkey AS id, CAST(p_size + 0.5 AS DOUBLE) AS total, '가,나' AS options, CASE WHEN p_size % 2 = 0 THEN CAST(1000 + p_size AS BIGINT) END AS n FROM part""")
def crosstab_options(spark, d):
    """Options, shares of the total row and sample count from a grid of cells."""
    size = F.col("p_size")
    count = F.when(size % 2 == 0, F.format_string("(%,d)", 1000 + size)).otherwise("없음")
    shares = F.concat(size.cast("string"), F.lit(".5"))
    grid = F.array(F.array(F.lit("구분"), F.lit("사례수"), F.lit("가"), F.lit(" 나 "), F.lit("None")), F.array(F.lit("[ 전 체 ]"), count, shares, F.lit("x"), F.lit("150")))
    total = polls.total_row(grid)
    options = polls.options_from_row(F.get(grid, F.lit(0)), 2)
    return parts(spark, d).select(
        "id", F.get(polls.percentages(total, 2), F.lit(0)).alias("total"), F.array_join(options, ",").alias("options"), polls.sample_count(F.get(total, F.lit(1))).alias("n")
    )


@query("""
WITH n AS (SELECT *, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age FROM events)
SELECT event_id, CASE WHEN age <= 0 THEN 'today' WHEN age <= 7 THEN 'week' WHEN age <= 30 THEN 'month' ELSE 'older' END AS bucket, CASE WHEN age = 0 THEN 'D-Day' WHEN age > 0 THEN 'D+' || age ELSE 'D-' || -age END AS d_day FROM n""")
def date_buckets(spark, d):
    today, day = F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")
    return events(spark, d).select("event_id", dates.date_bucket(day, today).alias("bucket"), dates.days_left(day, today).alias("d_day"))


@query("SELECT event_id, 'type=' || event_type || '&user=' || user_id AS key FROM events")
def cache_keys(spark, d):
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("KEY"), F.lit("secret"), F.lit("type"), F.col("event_type"))
    return events(spark, d).select("event_id", text.cache_key(params).alias("key"))
