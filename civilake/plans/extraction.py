"""Landed answers, pages and texts read back as rows. The pages are written from the fixture's tables, so that SQL on those tables is the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilake.functions import bills as bill_rules
from civilake.functions import dates, polls, text
from civilake.operators import grids, joins
from civilake.plans.recency import events
from civilake.plans.registry import Registry
from civilake.plans.relational import bills
from civilake.plans.scalars import choice, choice_sql, listed, parts
from civilake.session import spread, table
from civilake.sources import envelopes, html, mapped

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles

BILL = "bill_id bigint, stage string, day string"


#: Ids on one landed page, so that their number follows the table's size.
PAGE_SIZE = 400


def envelope_pages(spark: SparkSession, d: str, endpoint: str, rows: DataFrame) -> DataFrame:
    """Answers of a paged endpoint over some bills, PAGE_SIZE ids a page, and one that says there is no more."""
    listed = F.collect_list(F.struct("bill_id", "stage", F.col("propose_date").cast("string").alias("day")))
    total = rows.agg(F.count("*").alias("total"))
    pages = rows.groupBy(F.expr(f"bill_id div {PAGE_SIZE}").alias("page")).agg(listed.alias("row")).join(F.broadcast(total))  # one row
    ok = '{"RESULT":{"CODE":"INFO-000","MESSAGE":"ok"}}'
    body = F.format_string(f'{{"{endpoint}":[{{"head":[{{"list_total_count":%d}},{ok}]}},{{"row":%s}}]}}', "total", F.to_json("row"))
    last = spark.range(1).select(F.lit('{"RESULT":{"CODE":"INFO-200","MESSAGE":"no data"}}').alias("body"))
    return pages.select(body.alias("body")).unionByName(last)


@query("SELECT o_orderkey AS bill_id, o_orderstatus AS stage, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def envelope_scan(spark, d):
    """Every row of a paged answer; the page that says there is no more gives none."""
    return envelopes.envelope_rows(envelope_pages(spark, d, "bills", bills(spark, d)), "bills", BILL)


@query(f"SELECT count(DISTINCT o_orderkey // {PAGE_SIZE}) + 1 AS pages, count(*) AS rows, count(*) AS total, true AS complete FROM orders")
def page_totals(spark, d):
    """Pages landed, the one without rows too, and whether as many rows have landed as the answers say there are."""
    return envelopes.page_totals(envelope_pages(spark, d, "bills", bills(spark, d)), "bills", BILL)


@query("""
SELECT CASE o_orderstatus WHEN 'O' THEN 'receipts' WHEN 'P' THEN 'pending' ELSE 'processed' END AS endpoint, o_orderkey AS bill_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def named_endpoints(spark, d):
    """The named endpoints of bills, each read from its own answers."""
    found = None
    for endpoint, stage in {"receipts": "O", "pending": "P", "processed": "F"}.items():
        pages = envelope_pages(spark, d, endpoint, bills(spark, d).where(F.col("stage") == stage))
        rows = envelopes.envelope_rows(pages, endpoint, BILL).select(F.lit(endpoint).alias("endpoint"), "bill_id", "day")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS party FROM customer WHERE (c_custkey // 50) % 4 <> 0")
def xml_scan(spark, d):
    """Items of XML answers, with and without attributes, their tags as columns; answers of another code give none."""
    rows = table(spark, d, "customer")
    item = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.format_string('<item no="%d" >', "c_custkey")).otherwise("<item>"), F.lit("<huboid>"), "c_custkey", F.lit("</huboid><name>"), "c_name", F.lit("</name><party>"), "c_nationkey", F.lit("</party></item>"))
    page = F.expr("c_custkey div 50")
    grouped = rows.groupBy(page.alias("page")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    code = F.when(F.col("page") % 4 == 0, "INFO-300").otherwise("INFO-000")
    pages = grouped.select(F.concat(F.lit("<response><header><resultCode>"), code, F.lit("</resultCode></header><body><items>"), "items", F.lit("</items></body></response>")).alias("body"))
    found = envelopes.xml_items(pages, "body.items.item", "huboid bigint, name string, party bigint", "response/header/resultCode")
    return found.select(F.col("huboid").alias("id"), "name", "party")


def five_shapes(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages of five endpoints, each with an envelope of its own, and the mappers that read them."""
    def listed(name: str, id_col: str, text_col: str, size: int, extra: str = ""):
        rows = table(spark, d, name).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("name"))
        item = F.format_string('{"ID":%d,"info":{"NAME":"%s"}}', "id", "name")
        xml = F.concat(F.lit("<item"), F.when(F.col("id") % 2 == 0, F.format_string(' seq="%d"', "id")).otherwise(""), F.format_string("><ID>%d</ID><info><NAME>%s</NAME></info></item>", "id", "name"))
        pages = rows.groupBy(F.expr(f"id div {size}").alias("page")).agg(F.array_join(F.collect_list(item), ",").alias("json"), F.array_join(F.collect_list(xml), "").alias("xml"), F.count("*").alias("n"))
        return pages.join(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row

    def page(rows, endpoint, body):
        return rows.select(F.lit(endpoint).alias("endpoint"), body.alias("body"))

    one = F.when(F.col("n") == 1, F.col("json")).otherwise(F.concat(F.lit("["), "json", F.lit("]")))
    pages = page(listed("orders", "o_orderkey", "o_orderpriority", 300), "bills", F.format_string('{"bills":[{"head":[{"list_total_count":%d},{"RESULT":{"CODE":"INFO-000"}}]},{"row":[%s]}]}', "total", "json"))
    pages = pages.unionByName(page(listed("supplier", "s_suppkey", "s_name", 1), "members", F.format_string('{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":%s},"totalCount":%d}}}', one, "total")))
    pages = pages.unionByName(page(listed("customer", "c_custkey", "c_name", 90), "candidates", F.format_string('<response xmlns="urn:x"><header><resultCode>%s</resultCode></header><body><items>%s</items><totalCount>%d</totalCount></body></response>', F.when(F.col("page") % 5 == 4, "99").otherwise("00"), "xml", "total")))
    pages = pages.unionByName(page(listed("part", "p_partkey", "p_name", 200), "reports", F.format_string('{"meta":{"count":%d},"data":[%s]}', "total", "json")))
    pages = pages.unionByName(page(listed("nation", "n_nationkey", "n_name", 10), "notices", F.format_string('{"k%d":[{"head":[]},{"row":[%s]}],"z":1}', "page", "json")))
    nothing = spark.createDataFrame([("bills", '{"RESULT":{"CODE":"INFO-200"}}'), ("bills", "not an answer"), ("unknown", "{}")], "endpoint string, body string")
    fields = {"id": "$.ID", "name": "$.info.NAME"}
    mappers = [
        ("bills", "$.bills[1].row", "$.bills[0].head[0].list_total_count", "$.bills[0].head[1].RESULT.CODE", ["INFO-000"], [], False, False, None, fields),
        ("members", "$.response.body.items.item", "$.response.body.totalCount", "$.response.header.resultCode", ["00"], ["03"], False, False, None, fields),
        ("candidates", "$.body.items.item", "$.body.totalCount", "$.header.resultCode", ["00"], ["03"], True, False, None, fields),
        ("reports", "$.data", "$.meta.count", None, [], [], False, False, None, {"id": "$.ID"}),
        ("notices", None, None, None, [], [], False, True, "[1].row", fields),
    ]
    return pages.unionByName(nothing), spark.createDataFrame(mappers, mapped.MAPPER)


@query("""
SELECT 'bills' AS endpoint, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name FROM orders UNION ALL SELECT 'members', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
UNION ALL SELECT 'candidates', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE (c_custkey // 90) % 5 <> 4 UNION ALL SELECT 'reports', CAST(p_partkey AS VARCHAR), NULL FROM part UNION ALL SELECT 'notices', CAST(n_nationkey AS VARCHAR), n_name FROM nation""")
def mapped_answers(spark, d):
    """Rows of five kinds of answers, JSON and XML, lists and single objects, read by five rows of a mapper table."""
    return mapped.rows(*five_shapes(spark, d), ["id", "name"])


@query("""
WITH c AS (SELECT count(*) AS total, count(DISTINCT c_custkey // 90) AS pages, count(DISTINCT c_custkey // 90) FILTER ((c_custkey // 90) % 5 = 4) AS failed, count(*) FILTER ((c_custkey // 90) % 5 <> 4) AS rows FROM customer)
SELECT 'bills' AS endpoint, count(DISTINCT o_orderkey // 300) + 2 AS pages, 2 AS failed, count(*) AS rows, count(*) AS total, true AS complete FROM orders
UNION ALL SELECT 'members', count(*), 0, count(*), count(*), true FROM supplier UNION ALL SELECT 'candidates', pages, failed, rows, total, rows >= total FROM c
UNION ALL SELECT 'reports', count(DISTINCT p_partkey // 200), 0, count(*), count(*), true FROM part UNION ALL SELECT 'notices', count(DISTINCT n_nationkey // 10), 0, count(*), 0, true FROM nation""")
def mapped_totals(spark, d):
    """Pages, failures and completeness of every endpoint, by the totals that its answers name."""
    return mapped.totals(*five_shapes(spark, d))


@query("SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS k, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events")
def json_walk(spark, d):
    """Values deep inside JSON by a path through objects and lists; a missing step gives null."""
    rows = table(spark, d, "events")
    listed = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.col("event_type").alias("kind")))).otherwise(F.array())
    landed = rows.select("event_id", F.to_json(F.struct(F.from_json("props", "k bigint").alias("props"), listed.alias("items"))).alias("body"))
    return landed.select("event_id", envelopes.json_path(F.col("body"), "props.k").alias("k"), envelopes.json_path(F.col("body"), "items[0].kind").alias("kind"))


@query("SELECT o_orderkey AS bill_id, o_orderpriority AS detail, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 4 = 1")
def point_lookups(spark, d):
    """The detail and lifecycle of wanted bills, looked up together by one join on the key."""
    b = bills(spark, d)
    wanted = b.where("bill_id % 4 = 1").select("bill_id")
    lifecycle = b.where("stage = 'F'").select("bill_id", "price")
    return wanted.join(b.select("bill_id", F.col("kind").alias("detail")), "bill_id").join(lifecycle, "bill_id", "left")


@query("""
SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND o_orderkey % 3 <> 2""", dates=("day",))
def dated_rows(spark, d):
    """Rows whose first parseable date, of several fields, lies in a range; rows without one go."""
    day, key = F.col("propose_date"), F.col("bill_id")
    fields = [F.when(key % 3 == 0, day.cast("string")).otherwise("?"), F.when(key % 3 == 1, F.date_format(day, "yyyy.MM.dd"))]
    found = envelopes.dated_between(bills(spark, d), [dates.multi_date(c) for c in fields], F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return found.select("bill_id", F.col("propose_date").alias("day"))


TARGETS = [(1, "NATION_3", None, None), (2, None, ["BUILDING"], None), (3, "NATION_5", ["MACHINERY", "BUILDING"], ["0001", "0002"]), (4, None, None, ["00007"])]


@query("""
WITH r AS (SELECT c_custkey AS record, n_name AS region, c_mktsegment AS segment, c_name AS pollster FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT record, 1 AS target FROM r WHERE region = 'NATION_3' UNION ALL SELECT record, 2 FROM r WHERE segment = 'BUILDING'
UNION ALL SELECT record, 3 FROM r WHERE region = 'NATION_5' AND segment IN ('MACHINERY', 'BUILDING') AND (contains(pollster, '0001') OR contains(pollster, '0002')) UNION ALL SELECT record, 4 FROM r WHERE contains(pollster, '00007')""")
def target_records(spark, d):
    """Each record with each target that it fits, from one scan; a wish that is null fits everything."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    records = table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("record"), "region", F.array("c_mktsegment").alias("names"), F.col("c_name").alias("pollster"))
    targets = spark.createDataFrame(TARGETS, "target int, want_region string, want_names array<string>, want_pollsters array<string>")
    fits = polls.matches_target(F.col("region"), F.col("names"), F.col("pollster"), F.col("want_region"), F.col("want_names"), F.col("want_pollsters"))
    return envelopes.records_for_targets(records, targets, fits, ("region", "want_region")).select("record", "target")


@query("SELECT c_custkey AS record, 'f' || c_custkey || '.pdf' AS file FROM customer WHERE c_custkey % 10 <> 0")
def ignored_files(spark, d):
    """Files but for those whose names are to be ignored."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("record"), F.when(F.col("c_custkey") % 10 == 0, "skip.pdf").otherwise(F.concat(F.lit("f"), "c_custkey", F.lit(".pdf"))).alias("file"))
    return rows.where(~F.array_contains(F.array(F.lit("skip.pdf"), F.lit("old.pdf")), F.col("file")))


@query("""
SELECT o_orderkey AS place, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS bill_id, CASE WHEN o_orderkey % 9 = 0 THEN 'not json ' || o_orderkey END AS malformed FROM orders WHERE o_orderkey % 9 <> 4
UNION ALL SELECT o_orderkey, 'expected-' || o_orderkey, NULL FROM orders WHERE o_orderkey % 9 = 4""")
def answer_lines(spark, d):
    """Lines of a batch's answers: one that does not parse stays with its text, one without an id takes that expected at its place."""
    key = F.col("bill_id")
    line = F.when(key % 9 == 0, F.concat(F.lit("not json "), key)).when(key % 9 == 4, '{"ok":true}').otherwise(F.to_json(F.struct(key.cast("string").alias("bill_id"))))
    lines = bills(spark, d).select(key.alias("place"), line.alias("value"))
    parsed = lines.select("place", F.from_json("value", "bill_id string, malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}).alias("r")).select("place", "r.*")
    expected = bills(spark, d).where("bill_id % 9 = 4").select(F.col("bill_id").alias("place"), F.concat(F.lit("expected-"), key).alias("bill_id"))
    return envelopes.lines_with_ids(parsed, expected, "place", "bill_id").select("place", "bill_id", "malformed")


@query(r"""
SELECT event_id AS article, 'say "' || event_type || '" & more' AS title, CASE WHEN event_id % 9 = 0 THEN '2024-02-01 00:00:00' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS published,
       CASE WHEN event_type = 'click' THEN 'Clickers' WHEN contains(props, '7') THEN 'Sevens' WHEN event_type = 'view' THEN 'Viewers' END AS party FROM events""")
def news_scan(spark, d):
    """Articles of a news answer: bold tags and escapes taken out of titles, mail-style dates parsed (one that cannot be read is the time of the run), and the first party that title or description names."""
    date = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    landed = table(spark, d, "events").select(
        F.col("event_id").alias("article"), F.concat(F.lit("say &quot;<b>"), "event_type", F.lit("</b>&quot; &amp; more")).alias("title"), "event_type", "props",
        F.when(F.col("event_id") % 18 == 0, "yesterday").when(F.col("event_id") % 9 != 0, date).alias("pub_date"),
    )
    party = polls.party_mentioned(F.col("event_type"), F.col("props"), {"click": "Clickers", "7": "Sevens", "view": "Viewers"})
    when = dates.published(F.col("pub_date"), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return landed.select("article", html.plain(F.col("title"), 300).alias("title"), when.cast("string").alias("published"), party.alias("party"))


@query("""
SELECT page_id, CAST(r AS INTEGER) AS table_no, 0 AS row_no, '[{"header":true,"text":"기관"},{"header":false,"text":"P' || page_id || '"}]' AS cells FROM pages, range(2) t(r)""")
def page_table_pairs(spark, d):
    """Header and data cells of every table row of pages, read by an HTML parser: each page has two tables around its own text."""
    grid = F.concat(F.lit("<table><tr><th> 기관 </th><td>P"), "page_id", F.lit("</td></tr></table>"))
    pages = table(spark, d, "pages").select("page_id", F.concat(grid, F.col("html"), grid).alias("html"))
    return html.table_rows(pages, "page_id", "html").select("page_id", "table_no", "row_no", F.to_json("cells").alias("cells"))


@query("""
SELECT 'R' || c_custkey AS registration, c_mktsegment AS pollster, 'https://example.org/view.do?nttId=' || c_custkey || '&x=1' AS detail_url, CAST(c_custkey AS VARCHAR) AS ntt_id FROM customer WHERE c_custkey % 5 <> 0""")
def list_page(spark, d):
    """List entries from pages of anchors: eight columns each, entries of fewer left out, the address made absolute."""
    span = lambda c: F.concat(F.lit('<span class="col"> '), c, F.lit(" </span>"))
    key = F.col("c_custkey")
    cols = [F.concat(F.lit("R"), key), F.col("c_mktsegment"), *(F.lit(f"c{i}") for i in range(2, 7))]
    eighth = F.when(key % 5 != 0, span(F.lit("c7"))).otherwise("")
    anchor = F.concat(F.lit('<a class="row tr" href="/view.do?nttId='), key, F.lit('&amp;x=1">'), *(span(c) for c in cols), eighth, F.lit("</a>"))
    other = F.lit('<a class="row tr" href="/other.do?id=1"><span class="col">x</span></a>')
    pages = table(spark, d, "customer").groupBy((key % 37).alias("page")).agg(F.concat(F.lit("<div>"), F.array_join(F.collect_list(anchor), ""), other, F.lit("</div>")).alias("html"))
    rows = html.list_entries(pages, "page", "html", "https://example.org")
    return rows.select(F.get("columns", F.lit(0)).alias("registration"), F.get("columns", F.lit(1)).alias("pollster"), "detail_url", text.url_param(F.col("detail_url"), "nttId").alias("ntt_id"))


@query("""
SELECT c_custkey AS survey, c_mktsegment AS pollster, CAST(1000 + c_custkey AS BIGINT) AS completed, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 50 + 0.5 AS DOUBLE) END AS rate, '2024-01-02 9시 0분 ~ 18 시 0 분' AS times, 2 AS methods FROM customer""")
def detail_page(spark, d):
    """The fields of a survey's detail page: header and data cells paired across its tables, numbers and spans read out of them, method groups counted."""
    key = F.col("c_custkey")
    row = lambda label, value: F.concat(F.lit(f"<tr><th>{label}</th><td>"), value, F.lit("</td></tr>"))
    rate = F.when(key % 3 == 0, "unknown").otherwise(F.concat((key % 50).cast("string"), F.lit(".5 % of all")))
    tables = [
        [row("조사기관명", F.col("c_mktsegment")), row("조사일시", F.lit("2024-01-02 9시 0분 ~ 18 시  0 분"))], [row("전체", F.format_number(1000 + key, 0))],
        [row("조사방법", F.lit("phone")), row("접촉률", rate)], [row("조사방법", F.lit("web"))],
    ]
    page = F.concat(*(F.concat(F.lit("<table>"), *rows, F.lit("</table>")) for rows in tables))
    pages = table(spark, d, "customer").select(key.alias("survey"), page.alias("html"))
    fields = html.fields_of(html.table_rows(pages, "survey", "html"), "survey")
    value = lambda label: F.get(F.col("fields")[label], F.lit(0))
    return fields.select(
        "survey", value("조사기관명").alias("pollster"), text.int_in(value("전체")).alias("completed"), text.percent_in(value("접촉률")).alias("rate"),
        F.get(dates.survey_times(value("조사일시")), F.lit(0)).alias("times"), F.size(F.col("fields")["조사방법"]).alias("methods"),
    )


@query(r"""
WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || ', ' || p_brand || ' ,,' || p_type WHEN 1 THEN ' , ' WHEN 2 THEN p_name END AS list, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '제' || p_size || '대 (' || p_partkey || ') ' || p_name END AS numbers FROM part)
SELECT id, coalesce(array_to_string(list_filter(list_transform(string_split(list, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS items, CAST(coalesce(regexp_extract_all(numbers, '[0-9]+')[-1], '22') AS INTEGER) AS units FROM t""")
def text_lists(spark, d):
    """Comma-separated texts as lists, and the last number of a text with its default."""
    key = F.col("id")
    rows = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    items = F.when(key % 4 == 0, F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ,,"), "p_type")).when(key % 4 == 1, " , ").when(key % 4 == 2, F.col("p_name"))
    numbers = F.when(key % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("제"), "p_size", F.lit("대 ("), key, F.lit(") "), "p_name"))
    return rows.select("id", F.array_join(text.text_list(items), "|").alias("items"), text.last_number(numbers, 22).alias("units"))


SUMMARIES = ["제안이유\n\n첫 줄이다\n둘째", "제안이유 및 주요내용", "  ", None]
BRIEFS = ["첫 줄이다", "bill name", "bill name", "bill name"]


@query(f"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'kept' ELSE {choice_sql("p_partkey", BRIEFS)} END AS brief, CASE WHEN p_size > 25 THEN p_brand WHEN p_size > 10 THEN p_type ELSE p_name END AS first FROM part""")
def brief_summaries(spark, d):
    """A bill's brief: what there is, else the first meaningful line, else its name; and the first text of several that is not blank."""
    size = F.col("p_size")
    rows = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    brief = text.brief_summary(choice(F.col("id"), SUMMARIES), F.lit("bill name"), F.when(F.col("id") % 7 == 0, "kept"))
    first = text.first_text(F.when(size > 25, F.col("p_brand")).otherwise("  "), F.when(size > 10, F.col("p_type")), F.col("p_name"))
    return rows.select("id", brief.alias("brief"), first.alias("first"))


@query(r"""
WITH r AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN '(대안)' WHEN 1 THEN '(' || p_brand || ' 등 ' || p_size || '인)' ELSE '' END AS raw FROM part)
SELECT id, regexp_replace(raw, '\(대안\)$', '') AS name FROM r""")
def alternative_names(spark, d):
    """Chairmen's bills without the mark of an alternative; other parentheses stay."""
    key = F.col("id")
    mark = F.when(key % 3 == 0, "(대안)").when(key % 3 == 1, F.concat(F.lit("("), "p_brand", F.lit(" 등 "), "p_size", F.lit("인)"))).otherwise("")
    return parts(spark, d).select("id", bill_rules.without_alternative(F.concat("p_name", mark)).alias("name"))


@query(f"""
WITH t AS (SELECT p_partkey AS id, p_size, CASE p_partkey % 5 WHEN 0 THEN '강원특별자치도' WHEN 1 THEN '전북특별자치도' WHEN 2 THEN '전국' WHEN 3 THEN '' ELSE p_name END AS province, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS who, ' ' || p_brand AS name FROM part)
SELECT id, CASE province WHEN '강원특별자치도' THEN '강원도 전체' WHEN '전북특별자치도' THEN '전라북도 전체' WHEN '전국' THEN '전국' WHEN '' THEN '' ELSE province || ' 전체' END AS region,
       CASE who WHEN 'red ring' THEN 'Red' ELSE coalesce(replace(who, ' ', ''), '') END AS candidate, CASE WHEN p_size = 11 THEN 'Seoul' WHEN trim(name) = 'Brand#2' THEN 'Busan' ELSE trim(name) END AS label,
       CASE WHEN p_size % 13 BETWEEN 1 AND 11 THEN {listed(polls.ELECTION_TYPES.values())}[p_size % 13] ELSE '' END AS election FROM t""")
def poll_labels(spark, d):
    """Regions by province, code or name, candidates by alias, elections by type."""
    key, name = F.col("id"), F.col("p_name")
    province = F.when(key % 5 == 0, "강원특별자치도").when(key % 5 == 1, "전북특별자치도").when(key % 5 == 2, "전국").when(key % 5 == 3, "").otherwise(name)
    label = polls.label_of(F.concat(F.lit(" "), F.col("p_size"), F.lit(" ")), F.concat(F.lit(" "), "p_brand"), {"11": "Seoul"}, {"Brand#2": "Busan"})
    candidate = polls.candidate_name(F.when(key % 4 > 0, name), {"red ring": "Red"})
    return parts(spark, d).select("id", polls.region_label(province).alias("region"), candidate.alias("candidate"), label.alias("label"), polls.election_type_name(F.col("p_size") % 13).alias("election"))


@query(r"""
WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '   ' WHEN 1 THEN p_name || '/' || p_brand || ':' || p_partkey || '?.pdf' WHEN 2 THEN '  ' || p_name || '   ' || p_type || '.pdf ' ELSE p_brand || '.pdf' END AS file FROM part)
SELECT id, CASE WHEN trim(file) = '' THEN 'default.pdf' ELSE trim(regexp_replace(regexp_replace(file, '[\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')) END AS file,
       CASE WHEN id % 3 = 0 THEN 'https://example.org/portal/cmm/fms/FileDown.do?atchFileId=F' || id || '&fileSn=' || id % 7 || '&bbsId=B' || id % 5 || '&bbsKey=' || id * 3 ELSE '' END AS url FROM t""")
def file_names(spark, d):
    """Names safe for file systems, and download addresses behind script calls."""
    key = F.col("id")
    rows = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    name = F.when(key % 4 == 0, "   ").when(key % 4 == 1, F.concat("p_name", F.lit("/"), "p_brand", F.lit(":"), key, F.lit("?.pdf"))).when(key % 4 == 2, F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(".pdf "))).otherwise(F.concat("p_brand", F.lit(".pdf")))
    call = F.when(key % 3 == 0, F.format_string("view('F%d', '%d', 'B%d', '%d')", key, key % 7, key % 5, key * 3)).when(key % 3 == 1, F.format_string("go('%d')", key))
    return rows.select("id", text.safe_filename(name, "default.pdf").alias("file"), text.download_url(call, "https://example.org").alias("url"))


@query(r"""
WITH t AS (SELECT conv_id, turn, '"' || replace(replace(text, '\', '\\'), '"', '\"') || '"' AS quoted, conv_id % 5 AS kind FROM conversations),
o AS (SELECT conv_id, turn, kind, '{"turn": {"n": ' || turn || '}, "answer": ' || quoted || ', "rest": "}{\\"}' AS object FROM t)
SELECT o.conv_id, o.turn, CASE WHEN kind < 3 THEN object END AS found, CASE WHEN length(text) BETWEEN 0 AND 100 THEN CAST(length(text) AS DECIMAL(5,2)) END AS pct,
       CASE WHEN role = 'user' THEN 20 ELSE least(greatest(length(text), 5), 30) END AS size FROM o JOIN conversations c ON c.conv_id = o.conv_id AND c.turn = o.turn""")
def model_answers(spark, d):
    """The first JSON object in a model's answer, a percentage within its range, and a parameter held within its bounds.

    The answers hold the conversations' texts: fenced, between other texts, before a second object, cut off in a string, or cut off before the last brace.
    """
    turns = table(spark, d, "conversations")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    whole = F.concat(F.lit('{"turn": {"n": '), "turn", F.lit('}, "answer": '), quoted, F.lit(', "rest": "}{\\\\"}'))
    cut = F.concat(F.lit('{"turn": {"n": '), "turn", F.lit('}, "answer": '), quoted)
    fenced, talk, twice = F.concat(F.lit("```json\n"), whole, F.lit("\n```")), F.concat(F.lit('As "asked": '), whole, F.lit(" }")), F.concat(whole, whole)
    kind = F.col("conv_id") % 5
    answer = F.when(kind == 0, fenced).when(kind == 1, talk).when(kind == 2, twice).when(kind == 3, F.concat(cut, F.lit(', "rest": "}'))).otherwise(cut)
    n = F.length("text")
    raw = F.when(F.col("role") == "user", "many").otherwise(n.cast("string"))
    return turns.select("conv_id", "turn", text.first_json_object(text.without_fences(answer)).alias("found"), text.in_range(n.cast("string")).alias("pct"), text.clamped(raw, 20, 5, 30).alias("size"))


@query("""
WITH s AS (SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + 2 AS b, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', ts)) AS age, dayofweek(ts) AS dow FROM events)
SELECT event_id, a AS first, CASE WHEN event_id % 2 = 0 THEN b ELSE a END AS last, ['일','월','화','수','목','금','토'][dow + 1] AS weekday,
       CASE WHEN age >= 86400 THEN CAST(floor(age / 86400) AS BIGINT) || ' day(s) ago' WHEN age >= 3600 THEN CAST(floor(age / 3600) AS BIGINT) || ' hour(s) ago' WHEN age >= 60 THEN CAST(floor(age / 60) AS BIGINT) || ' minute(s) ago' ELSE 'just now' END AS ago FROM s""", dates=("first", "last"))
def survey_dates(spark, d):
    """First and last day of a survey's text, the weekday, and how long ago."""
    day = F.to_date("ts")
    written = F.concat(F.lit("조사 "), day, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ~ "), F.date_add(day, 2))).otherwise(""))
    first, last = dates.survey_range(written)
    ago = dates.relative_time(F.date_trunc("second", "ts"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return events(spark, d).select("event_id", first.alias("first"), last.alias("last"), dates.weekday(day).alias("weekday"), ago.alias("ago"))


@query("""
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS top, c_mktsegment AS detail, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT k AS registration, coalesce(top, detail) AS pollster, day AS first, day + 1 AS last, CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k AS BIGINT) END AS sample FROM r""", dates=("first", "last"))
def survey_rows(spark, d):
    """A survey row from a result set: each field from its top level, or else from the detail."""
    segment = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("detail"))
    rows, key = bills(spark, d).join(segment, "user_id"), F.col("bill_id")
    first, last = dates.survey_range(F.concat_ws(" ", "propose_date", F.date_add("propose_date", 1)))
    sample = text.int_in(F.when(key % 4 != 0, F.concat(F.lit("표본 "), F.format_number("bill_id", 0), F.lit("명"))))
    return rows.select(key.alias("registration"), text.first_text(F.when(key % 3 == 0, F.col("kind")).otherwise(" "), F.col("detail")).alias("pollster"), first.alias("first"), last.alias("last"), sample.alias("sample"))


@query("""
WITH a AS (SELECT o_orderkey AS bill_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'bill ' || o_orderkey ELSE 'bill ' || o_orderkey || ' of ' || CAST(o_orderdate AS DATE) END AS name FROM orders),
r AS (SELECT o_orderkey AS bill_id, o_orderstatus AS review FROM orders WHERE o_orderkey % 4 IN (0, 1)),
n AS (SELECT 'review of bill ' || o_orderkey || ' of ' || CAST(o_orderdate AS DATE) || ' as amended' AS name, o_orderpriority AS review FROM orders WHERE o_orderkey % 4 = 2)
SELECT bill_id, true AS by_key, review FROM r UNION ALL SELECT a.bill_id, false, n.review FROM a JOIN n ON n.name = 'review of ' || a.name || ' as amended' WHERE a.bill_id % 4 IN (2, 3)""")
def review_fallback(spark, d):
    """Reviews by bill id; only where none has the id, those whose name holds the bill's."""
    b, key = bills(spark, d), F.col("bill_id")
    dated = F.concat(F.lit("bill "), key, F.lit(" of "), F.col("propose_date"))
    asked = b.select("bill_id", F.when(key % 4 < 2, F.concat(F.lit("bill "), key)).otherwise(dated).alias("name"))
    by_id = b.where("bill_id % 4 < 2").select("bill_id", F.lit("a review").alias("name"), F.col("stage").alias("review"))
    named = b.where("bill_id % 4 = 2").select(F.lit(None).cast("bigint").alias("bill_id"), F.concat(F.lit("review of "), dated, F.lit(" as amended")).alias("name"), F.col("kind").alias("review"))
    return joins.by_key_or_name(asked, by_id.unionByName(named), "bill_id", "name", "review").select("bill_id", "by_key", "review")


@query("""
SELECT o_orderkey AS 의안번호, o_orderstatus AS 상태, o_orderpriority AS 소관위원회, CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE '-' END AS 결과 FROM orders""")
def labelled_rows(spark, d):
    """Rows under the labels that a reader sees; an empty field is a dash."""
    labels = {"bill_id": "의안번호", "stage": "상태", "kind": "소관위원회"}
    result = F.coalesce(F.when(F.col("stage") == "F", "passed"), F.lit("-"))
    return bills(spark, d).select(*(F.col(c).alias(label) for c, label in labels.items()), result.alias("결과"))


@query("""
WITH w AS (SELECT o_orderkey AS grid, unnest(range(1, 3 + o_orderkey % 4)) AS c FROM orders)
SELECT grid, 1 AS "row", CAST(c AS INTEGER) AS "column", CAST(grid % 90 AS VARCHAR) || '.' || c AS text FROM w WHERE grid % 3 <> 1""")
def unmerged_cells(spark, d):
    """Merged cells of tables of two to five columns, narrow or wide, divided by where their numbers stand; merged labels stay as they are."""
    grid = bills(spark, d).select(F.col("bill_id").alias("grid"), (2 + F.col("bill_id") % 4).cast("int").alias("n"), (100.0 * (1 + F.col("bill_id") % 2)).alias("width"))
    each = grid.select("*", F.explode(F.sequence(F.lit(0), "n")).alias("at")).withColumn("x", F.col("at") * F.col("width"))
    cell = lambda row, column, x0, x1: (F.col("grid"), F.lit(row).alias("row"), column.alias("column"), x0.alias("x0"), x1.alias("x1"))
    wide = F.col("width") * 0.9
    cells = each.select(*cell(0, F.col("at"), F.col("x"), F.col("x") + wide)).unionByName(grid.select(*cell(1, F.lit(0), F.lit(0.0), wide)))
    cells = cells.unionByName(grid.select(*cell(1, F.lit(1), F.col("width"), F.col("n") * F.col("width") + wide)))
    number = F.when(F.col("grid") % 3 == 1, "label").otherwise(F.concat(F.col("grid") % 90, F.lit("."), F.col("at")))
    words = each.where("at > 0").select("grid", F.lit(1).alias("row"), (F.col("x") + 0.3 * F.col("width")).alias("w0"), (F.col("x") + 0.5 * F.col("width")).alias("w1"), number.alias("word"))
    cells, words = spread(cells, "grid", of=each), spread(words, "grid", of=each)  # a task for so many cells, however few their bytes
    return grids.unmerged_words(cells, words, "grid", "row", "column", "x0", "x1", "w0", "w1", "word")


@query("""
WITH t AS (SELECT p_partkey AS id, CAST(p_partkey % 100 + 0.5 AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b, p_partkey % 3 AS mode, (p_partkey // 3) % 2 = 0 AS one FROM part)
SELECT id, CASE WHEN one AND mode = 0 THEN '' WHEN NOT one AND mode = 1 THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR) END AS shares, CASE WHEN mode = 0 THEN 'cell' WHEN mode = 1 OR one THEN 'bunched' ELSE 'cell' END AS mode FROM t""")
def crosstab_modes(spark, d):
    """Shares of a total row by a parser's mode: a cell each, bunched in one cell, or whichever the row shows."""
    key = F.col("id")
    mode = F.when(key % 3 == 0, "cell").when(key % 3 == 1, "bunched").otherwise("auto")
    a, b = F.concat(key % 100, F.lit(".5")), F.col("p_size").cast("string")
    begin = (F.lit("전체"), F.format_string("(%d)", 1000 + key))
    row = F.when(F.expr("id div 3") % 2 == 0, F.array(*begin, F.concat_ws(" ", a, b))).otherwise(F.array(*begin, a, b))
    shares, used = polls.shares_of(row, 2, mode)
    return parts(spark, d).select("id", F.array_join(F.transform(shares, lambda x: x.cast("string")), ",").alias("shares"), used.alias("mode"))
