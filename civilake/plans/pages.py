"""Poll reports written page by page from orders and their lines, in six layouts and as bare words, and read back as questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.operators import pages
from civilake.plans.registry import Registry
from civilake.session import spread, table

REGISTRY = Registry()
query, QUERIES, ORACLES = REGISTRY.query, REGISTRY.queries, REGISTRY.oracles

LAYOUTS = [
    ("joined", r"\[표\s*(\d+)\]\s*([^\n]*)", ["전체"], 1, 2, 3, None, 0, "cell", "join", False, True),
    ("bunched", r"Q(\d+)[.]\s*([^\n]*)", ["전체"], 1, 2, 3, None, 0, "bunched", "first", False, False),
    ("ordered", None, ["합계"], 1, 2, 3, None, None, "auto", "each", False, False),
    ("carried", r"【표\s*(\d+)】\s*([^\n]*)", ["전체"], 1, 2, 3, None, 0, "cell", "join", True, False),
    ("two_counts", r"문\s*(\d+)\)\s*([^\n]*)", ["전체"], 1, 1, 2, -1, 1, "cell", "first", False, False),
    ("sums", r"<표(\d+)>\s*([^\n]*)", ["합계"], 1, 2, 3, None, None, "cell", "join", False, True),
]


def polls_of(spark, d: str) -> DataFrame:
    """Orders as questions of their customers' reports, numbered in order: options and shares are the lines, in order."""
    items = table(spark, d, "lineitem")
    lines = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"))
    dealt = spread(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")), "doc", of=items)  # few bytes become many cells; all that follows is told by report
    named = dealt.withColumn("number", F.row_number().over(Window.partitionBy("doc").orderBy("o_orderkey")))
    return named.select(
        "doc", "number", F.transform("lines", lambda x: F.concat(F.lit("part "), x["l_partkey"])).alias("labels"), F.transform("lines", lambda x: x["l_quantity"].cast("string")).alias("shares"),
        (1000 + F.col("o_orderkey") % 500).alias("n"), (1000 + F.col("o_orderkey") % 300).alias("w"),
    )


def report_pages(spark, d: str) -> DataFrame:
    """PAGE rows of all reports; the remainder of a customer's number tells its layout.

    Pages are told apart before anything of them is made, and texts and tables are columns
    of their own, so that Spark makes neither for a query that reads the other alone.
    """
    q = polls_of(spark, d)
    text = lambda *cells: F.array(*(F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells))
    n, w = F.format_string("(%,d)", "n"), F.format_string("(%,d)", "w")
    part = lambda c, k: F.slice(c, F.lit(1), F.lit(4)) if k == 0 else F.slice(c, F.lit(5), F.greatest(F.size(c) - 4, F.lit(0)))
    labels, shares = F.col("labels"), F.col("shares")

    def made(body: Column, *tables: list[Column]) -> tuple[Column, Column]:
        return body, F.array(*(F.array(*rows) for rows in tables)).cast("array<array<array<string>>>")

    def grid(k: int, total: str, extra: tuple[str, str] | None = None) -> list[Column]:
        more = [F.array(F.lit(x)) for x in extra] if extra else [F.array().cast("array<string>")] * 2
        return [F.concat(text("구분", "사례수", "가중"), part(labels, k), more[0]), F.concat(text(total, n, w), part(shares, k), more[1]), text("남성", "(500)", "(490)", "1.0", "2.0")]

    title = F.format_string("about %d", "n")
    head = lambda pattern: F.format_string(pattern, "number", "n")
    other = F.transform(shares, lambda x: F.lit("1.0"))
    layouts = [
        [made(head("[표 %d] about %d\n계속"), grid(0, "▣ 전체 ▣", ("(합)", "80.0"))), made(head("[표 %d] about %d"), grid(1, "▣ 전체 ▣"))],
        [
            made(head("Q%d. about  %d\n"), [F.concat(text("구분", "수", "가중"), labels), text("전 체", n, w, F.array_join(shares, " "))]),
            made(head("Q%d. about again %d"), [F.concat(text("구분", "수", "가중"), labels), text("전체", n, w, F.array_join(other, " "))]),
        ],
        [made(title, [text("x", "y")], [F.concat(text("구분", "수", "가중"), labels), F.when(F.col("number") % 2 == 0, text("합 계", n, w, F.array_join(shares, " "))).otherwise(F.concat(text("합계", n, w), shares))])],
        [made(head("【표 %d】 about %d")), made(F.lit("no heading"), grid(0, "전체")), made(F.lit(""), grid(1, "■ 전체 ■"))],
        [made(head("문 %d) about %d"), [text("a table without options"), F.concat(text("구분", "수"), labels, text("sum")), F.concat(text("전체", F.concat(n, F.lit("\n"), w)), shares, text("99.0"))])],
        [made(head("<표%d> about %d"), [text("", "", "", "few"), F.concat(text("구분", "수", "가중"), F.array(F.lit("①+②")), labels), F.concat(text("합계", n, w), F.array(F.lit("70.5")), shares)])],
    ]
    kind = (F.col("doc") % len(layouts)).cast("int")
    each = q.withColumn("at", F.explode(F.sequence(F.lit(0), F.get(F.array(*(F.lit(len(made_pages) - 1) for made_pages in layouts)), kind))))
    places = [(i, j) for i, made_pages in enumerate(layouts) for j in range(len(made_pages))]
    of_page = lambda part: F.coalesce(*(F.when((kind == i) & (F.col("at") == j), layouts[i][j][part]) for i, j in places))
    layout = F.get(F.array(*(F.lit(name) for name, *_ in LAYOUTS)), kind)
    return each.select("doc", layout.alias("layout"), (F.col("number") * 4 + F.col("at")).cast("int").alias("page"), of_page(0).alias("text"), of_page(1).alias("tables"))


QUESTIONS_SQL = """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
l AS (SELECT l_orderkey AS k, count(*) AS n, list('part ' || l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS options, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS shares FROM lineitem GROUP BY 1),
q AS (SELECT *, doc % 6 AS kind, CASE WHEN doc % 6 IN (0, 3) AND n < 6 THEN least(n, 4) ELSE n END AS used FROM o JOIN l USING (k) WHERE n >= 2 OR doc % 6 IN (0, 5))"""


@query(QUESTIONS_SQL + """
SELECT doc, CAST(CASE WHEN kind = 2 THEN row_number() OVER (PARTITION BY doc ORDER BY number) ELSE number END AS INTEGER) AS number, CASE WHEN kind = 2 THEN '' ELSE 'about ' || (1000 + k % 500) END AS title,
       array_to_string(options[1:used], ',') AS options, array_to_string(list_transform(shares[1:used], lambda x: CAST(x AS DECIMAL(5,1))), ',') AS shares, 1000 + k % 500 AS n_completed, 1000 + k % 300 AS n_weighted FROM q""")
def poll_pages(spark, d):
    """Every question of all reports, read by six rows of a layout table."""
    layouts = spark.createDataFrame(LAYOUTS, pages.LAYOUT)
    found = pages.questions(report_pages(spark, d), layouts)
    return found.select("doc", "number", "title", F.array_join("options", ",").alias("options"), F.array_join(F.transform("shares", lambda x: x.cast("decimal(5,1)").cast("string")), ",").alias("shares"), "n_completed", "n_weighted")


@query("""
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT doc, doc % 6 AS kind, count(*) AS q, count(*) FILTER (n >= 3) AS three FROM o JOIN l USING (k) GROUP BY 1)
SELECT doc, CASE kind WHEN 0 THEN 2 * q WHEN 1 THEN 2 * q WHEN 3 THEN 3 * q ELSE q END AS pages, CASE kind WHEN 0 THEN '[표#]' WHEN 1 THEN 'Q#.' WHEN 3 THEN '【표#】' WHEN 4 THEN '문#)' WHEN 5 THEN '<표#>' END AS style,
       CASE WHEN kind = 2 THEN 0 ELSE q END AS questions, CASE WHEN kind IN (0, 1) THEN q ELSE 0 END AS split_questions, kind <> 2 AS in_order, 'none' AS ratios, '0000' AS respondents, kind = 0 AS goes_on FROM d""")
def document_profile(spark, d):
    """What every report's texts have in common: heading style, how many questions it counts, whether they are split over pages."""
    return pages.document_profiles(report_pages(spark, d))


@query("""
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
l AS (SELECT l_orderkey AS key, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS parts, array_to_string(list(CAST(l_quantity AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_quantity), ' ') AS shares, array_to_string(list('1.0'), ' ') AS others FROM lineitem GROUP BY 1),
k AS (SELECT * FROM (VALUES (0, 0, '[표#]=1'), (0, 1, '[표#]=1'), (1, 0, 'Q#.=1'), (1, 1, 'Q#.=1'), (2, 0, ''), (3, 0, '【표#】=1'), (3, 1, ''), (3, 2, ''), (4, 0, '문#)=1'), (5, 0, '<표#>=1')) k(kind, nth, styles)),
p AS (SELECT *, CASE kind WHEN 0 THEN '▣ 전체 ▣' WHEN 1 THEN CASE nth WHEN 0 THEN '전 체' ELSE '전체' END WHEN 2 THEN CASE number % 2 WHEN 0 THEN '합 계' ELSE '합계' END
    WHEN 3 THEN CASE nth WHEN 0 THEN '' WHEN 1 THEN '전체' ELSE '■ 전체 ■' END WHEN 4 THEN '전체' ELSE '합계' END AS totals, CASE nth WHEN 1 THEN parts[1:4] ELSE parts[5:] END AS shown,
  CASE WHEN kind = 1 OR kind = 2 AND number % 2 = 0 THEN CASE nth WHEN 0 THEN shares ELSE others END END AS bunch FROM o JOIN l USING (key) JOIN k ON kind = doc % 6)
SELECT doc, CAST(number * 4 + nth AS INTEGER) AS page, styles, styles AS questions, totals,
       CASE WHEN kind = 3 AND nth = 0 THEN 'plain_plain' WHEN kind = 0 THEN 'parenthesized_comma,parenthesized_plain,plain_plain'
            WHEN kind = 3 THEN 'parenthesized_comma,parenthesized_plain' || CASE WHEN len(list_filter(shown, lambda x: x BETWEEN 100 AND 9999)) > 0 THEN ',plain_plain' ELSE '' END ELSE 'parenthesized_comma,plain_plain' END AS formats,
       CASE WHEN kind = 3 AND nth = 0 THEN 'none' WHEN regexp_matches(bunch, '([0-9]{1,3}[.][0-9][ ]*){3}') THEN 'bunched' WHEN kind NOT IN (1, 2) OR regexp_matches(coalesce(bunch, shares), '\\b[0-9]{1,3}[.][0-9]\\b') THEN 'cell' ELSE 'none' END AS ratios,
       kind = 0 AND nth = 0 AS goes_on FROM p""")
def page_screening(spark, d):
    """Which headings and question marks every page has, how it names its total rows and writes whole numbers, where its ratios stand, and whether it says that it goes on."""
    return pages.page_markers(report_pages(spark, d))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), q AS (SELECT * FROM l WHERE n >= 2)
SELECT l_orderkey AS page, 0 AS row, CAST(place AS INTEGER) AS column, 'part no. P' || l_partkey AS text FROM q
UNION ALL SELECT l_orderkey, 1, CAST(place AS INTEGER), CAST(CAST(l_quantity AS DECIMAL(5,1)) AS VARCHAR) FROM q
UNION ALL SELECT l_orderkey, 2, CAST(place AS INTEGER), CAST(100 + l_suppkey AS VARCHAR) FROM q
UNION ALL SELECT DISTINCT l_orderkey, 1, 0, '전 체' FROM q UNION ALL SELECT DISTINCT l_orderkey, 2, 0, '남성 그리고 여성' FROM q""")
def word_layout(spark, d):
    """Tables without lines, told by where words stand: labels over three lines, numbers of different widths, a row's name over two lines."""
    items = table(spark, d, "lineitem")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey")))  # one order's lines
    dealt = spread(items.select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", "l_quantity", "l_suppkey"), "page", of=items)  # few bytes become many words
    rows = dealt.groupBy("page").agg(lines.alias("lines")).where("size(lines) >= 2")

    def word(text: Column, x: Column, y: float, width: float) -> Column:
        return F.struct(x.alias("x0"), (x + width).alias("x1"), F.lit(y).alias("y0"), F.lit(y + 8).alias("y1"), text.cast("string").alias("word"))

    def of_line(line: Column, at: Column) -> Column:
        x = 160.0 + 60.0 * at
        return F.array(
            word(F.lit("part"), x - 4, 10.0, 24), word(F.lit("no."), x, 20.0, 18), word(F.concat(F.lit("P"), line["l_partkey"]), x - 6, 30.0, 30),
            word(line["l_quantity"].cast("decimal(5,1)"), x + 2, 50.0, 16), word(100 + line["l_suppkey"], x - 3, 61.0, 22),
        )

    first = F.array(*(word(F.lit(t), F.lit(px), y, 12) for t, px, y in (("전", 10.0, 50.5), ("체", 30.0, 49.5), ("남성", 10.0, 61.0), ("그리고", 30.0, 61.0), ("여성", 12.0, 72.0))))
    words = rows.select("page", F.inline(F.concat(first, F.flatten(F.transform("lines", of_line)))))
    return pages.word_tables(words)


@query("""
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
q AS (SELECT doc, doc % 6 AS kind, n FROM o JOIN l USING (k)),
t AS (SELECT doc, kind, 3 AS r, 3 + least(n, 4) + 1 AS c FROM q WHERE kind = 0 UNION ALL SELECT doc, kind, 3, greatest(3 + greatest(n - 4, 0), 5) FROM q WHERE kind IN (0, 3)
  UNION ALL SELECT doc, kind, 3, greatest(3 + least(n, 4), 5) FROM q WHERE kind = 3
  UNION ALL SELECT doc, kind, 2, greatest(3 + n, 4) FROM q WHERE kind = 1 UNION ALL SELECT doc, kind, 2, greatest(3 + n, 4) FROM q WHERE kind = 1
  UNION ALL SELECT doc, kind, 1, 2 FROM q WHERE kind = 2 UNION ALL SELECT doc, kind, 2, greatest(3 + n, 4) FROM q WHERE kind = 2 UNION ALL SELECT doc, kind, 3, 2 + n + 1 FROM q WHERE kind = 4 UNION ALL SELECT doc, kind, 3, greatest(4 + n, 4) FROM q WHERE kind = 5),
m AS (SELECT doc, r, count(*) AS times FROM t GROUP BY 1, 2), mc AS (SELECT doc, c, count(*) AS times FROM t GROUP BY 1, 2),
p AS (SELECT doc, kind, count(*) AS q FROM q GROUP BY 1, 2)
SELECT doc, CASE kind WHEN 0 THEN 2 * q WHEN 1 THEN 2 * q WHEN 3 THEN 2 * q ELSE q END AS with_tables, CASE kind WHEN 3 THEN q ELSE 0 END AS without_tables,
       (SELECT arg_min(r, (-times, r)) FROM m WHERE m.doc = p.doc) AS rows, (SELECT arg_min(c, (-times, c)) FROM mc WHERE mc.doc = p.doc) AS columns FROM p""")
def table_shapes(spark, d):
    """How large the tables of every report mostly are."""
    return pages.table_shapes(report_pages(spark, d))
