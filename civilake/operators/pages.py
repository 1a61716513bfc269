"""Pages of poll reports as questions: layouts held as rows of a table, questions over several pages, tables from bare word boxes, profiles of documents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.functions import polls
from civilake.functions.text import collapsed, squashed

#: How a pollster's pages are read. ``title``: the pattern of a question's heading, its number in group 1 and its title in group 2; null if questions are told by order alone.
#: ``totals``: first cells of the total row, without spaces, brackets and bullets. Columns count from 0: where both numbers of respondents are (the same column if one cell
#: has both), and where options begin; ``last`` is the column they end before, negative from the end. ``header``: the row of options, null for the first above the total with enough of them.
#: ``mode``: ``cell``, ``bunched`` or ``auto``. ``split``: what several pages of one question are: ``join`` (columns go on), ``first`` (the first alone counts) or ``each`` (all tables are questions).
#: ``carried``: pages without a heading belong to the last one before them. ``sums``: whether columns that sum up others are there to drop.
LAYOUT = (
    "layout string, title string, totals array<string>, n_column int, weighted_column int, first int, last int, header int, mode string, split string, carried boolean, sums boolean"
)
PAGE = "doc bigint, layout string, page int, text string, tables array<array<array<string>>>"


def _between(row: Column, first: Column, last: Column) -> Column:
    """The cells of a row from ``first`` to before ``last`` (null: its end, negative: from its end)."""
    size = F.size(row)
    end = F.when(last.isNull(), size).when(last < 0, size + last).otherwise(F.least(last, size))
    return F.slice(row, first + 1, F.greatest(end - first, F.lit(0)))


def _numbers(cell: Column) -> Column:
    """The whole numbers in a cell, thousands commas allowed."""
    return F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"\d[\d,]*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"))


def _labels(row: Column, first: Column, last: Column) -> Column:
    cells = F.transform(_between(row, first, last), lambda c: squashed(F.coalesce(c, F.lit(""))))
    return F.filter(cells, lambda c: c != "")


def headed(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """Pages with their layout's columns and the ``number`` and ``heading`` of the question they belong to, carried over pages where the layout says so. Pages of unknown layouts are left out."""
    joined = pages.join(F.broadcast(layouts), "layout")  # a row a layout
    part = lambda group: F.when(F.col("title").isNotNull(), F.nullif(F.expr(f"regexp_extract(coalesce(text, ''), title, {group})"), F.lit("")))
    own = F.when(part(1).isNotNull(), F.struct(part(1).try_cast("int").alias("number"), squashed(F.coalesce(part(2), F.lit(""))).alias("heading")))
    told = joined.withColumn("__own", own)
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("carried"), F.last("__own", True).over(before)).otherwise(F.col("__own"))
    return told.withColumn("__known", known).withColumns({"number": F.col("__known.number"), "heading": F.coalesce("__known.heading", F.lit(""))}).drop("__own", "__known")


def _once(value: Column, good=None) -> Column:
    """A value made once a row, and the row left out unless it is ``good``: a filter on a plain column would be moved below it, and make it again."""
    return F.explode(F.array(value) if good is None else F.filter(F.array(value), good))


def tables_read(pages: DataFrame) -> DataFrame:
    """Of headed pages each table that has a total row and at least two shares: its options, shares and numbers of respondents, and its ``place`` among the page's."""
    each = pages.select("*", F.posexplode("tables").alias("place", "table")).where("size(table) >= 2")
    plain = lambda row: F.regexp_replace(F.coalesce(F.get(row, F.lit(0)), F.lit("")), r"[\s\[\]■▣●□◈]", "")
    at = F.get(F.filter(F.transform("table", lambda row, i: F.when(F.array_contains("totals", plain(row)), i)), lambda i: i.isNotNull()), F.lit(0))
    found = each.select("*", _once(at, lambda i: i.isNotNull()).alias("__at")).withColumn("__total", F.get("table", F.col("__at")))
    start, last = F.col("first"), F.col("last")
    single = F.filter(F.transform(_between(F.col("__total"), start, last), lambda c: F.trim(F.coalesce(c, F.lit(""))).try_cast("double")), lambda x: x.isNotNull() & x.between(0, 100))
    bunched = F.when(F.col("mode") != "cell", F.filter(polls.bunched_percentages(F.get("__total", start)), lambda x: x.between(0, 100)))
    found = found.select("*", _once(F.struct(single.alias("single"), bunched.alias("bunched"))).alias("__x"))
    there = F.size("__x.bunched") > 0
    shares = F.when((F.col("mode") == "bunched") & there, F.col("__x.bunched")).when((F.col("mode") == "auto") & (F.size("__x.single") <= 1) & there, F.col("__x.bunched")).otherwise(F.col("__x.single"))
    found = found.select("*", shares.alias("__shares")).where("size(__shares) >= 2")
    above = F.transform(F.slice("table", F.lit(1), F.col("__at")), lambda row: _labels(row, start, last))
    enough = F.get(F.filter(above, lambda labels: F.size(labels) >= F.size("__shares")), F.lit(0))
    options = F.when(F.col("header").isNotNull(), _labels(F.get("table", F.col("header")), start, last)).otherwise(F.coalesce(enough, _labels(F.get("table", F.lit(0)), start, last)))
    found = found.select("*", _once(options).alias("__options")).where(F.col("sums") | (F.size("__options") >= F.size("__shares")))
    kept = F.when(F.col("sums"), polls.without_summaries(F.col("__options"), F.col("__shares"))).otherwise(polls.paired(F.col("__options"), F.col("__shares")))
    n, weighted = _numbers(F.get("__total", F.col("n_column"))), _numbers(F.get("__total", F.col("weighted_column")))
    second = F.when(F.col("weighted_column") == F.col("n_column"), F.get(n, F.lit(1))).otherwise(F.get(weighted, F.lit(0)))
    pairs = F.filter(kept, lambda p: p["option"].isNotNull() & p["pct"].isNotNull())
    read = found.select("*", _once(pairs, lambda p: F.size(p) > 0).alias("pairs"))
    return read.select("doc", "layout", "split", "page", "place", "number", "heading", "pairs", F.get(n, F.lit(0)).alias("n_completed"), second.alias("n_weighted"))


def questions(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """``doc, layout, number, title, options, shares, n_completed, n_weighted``: one row per question of PAGE rows, read as their layouts (LAYOUT rows) say.

    Of a page of a question with a number the first good table counts. ``join`` puts the
    columns of all its pages one after another, with the numbers of respondents of the
    first; ``first`` keeps the first page; ``each`` numbers all tables of a document in
    order. A table without a question is left out, unless the layout tells questions by order.
    """
    read = tables_read(headed(pages, layouts)).where("split = 'each' OR split IS NOT NULL AND number IS NOT NULL")
    read = read.withColumns({"__each": F.col("split") == "each", "number": F.when(F.col("split") != "each", F.col("number"))})
    turn = lambda keys, order: F.row_number().over(Window.partitionBy("doc", "__each", *keys).orderBy(*order))
    tables = read.withColumn("__table", turn(["page", "number"], ["place"])).where("__each OR __table = 1")
    turns = tables.withColumn("__turn", turn(["number"], ["page", "place"])).where("split IN ('join', 'each') OR __turn = 1")
    parts = turns.withColumn("number", F.when(F.col("__each"), F.col("__turn")).otherwise(F.col("number")))
    rows = F.array_sort(F.collect_list(F.struct("page", "place", "pairs", "heading", "n_completed", "n_weighted")))  # the pages of one question
    found = parts.groupBy("doc", "layout", "number").agg(rows.alias("parts"))
    pairs, first = F.flatten(F.transform("parts", lambda p: p["pairs"])), F.get("parts", F.lit(0))
    return found.select(
        "doc", "layout", "number", first["heading"].alias("title"), F.transform(pairs, lambda p: p["option"]).alias("options"), F.transform(pairs, lambda p: p["pct"]).alias("shares"),
        first["n_completed"].alias("n_completed"), first["n_weighted"].alias("n_weighted"),
    )


WORD = "page bigint, x0 double, x1 double, y0 double, y1 double, word string"


def _profile(rows: DataFrame, group: list[str], low: str, high: str, name: str, gap: float) -> DataFrame:
    """``rows`` with the number (from 0) of the stretch along one axis that they lie in: a new one begins after an empty space of more than ``gap``."""
    along = Window.partitionBy(*group).orderBy(low, high)
    reached = F.max(high).over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("__new", F.when(F.col(low) > reached + gap, 1).otherwise(0))
    return opened.withColumn(name, F.sum("__new").over(along.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def word_tables(words: DataFrame, gap_x: float = 2.0, gap_y: float = 0.5) -> DataFrame:
    """``page, row, column, text``: the table that WORD boxes without lines make; row 0 is its header, if there are lines above the body.

    Projected on the vertical axis the words fall into lines. Lines with at least
    two numbers are the body, and their numbers, projected on the horizontal
    axis, give the columns, from 1 on. Words of the body left of them are column 0. Words of the
    lines above the body belong to the column of nearest centre, those left of the
    first column's reach to column 0; a label over several lines is one text, top line first.
    Lines below the body's first one without two numbers go on with the row above them. Pages without a body give none.
    """
    numeric = F.col("word").rlike(r"^\(?\d[\d,]*(\.\d+)?\)?%?$")
    lines = _profile(words, ["page"], "y0", "y1", "__line", gap_y)
    told = lines.where(numeric).withColumn("__n", F.count("*").over(Window.partitionBy("page", "__line"))).where("__n >= 2")
    numbers = _profile(told.select("page", "__line", "x0", "x1"), ["page"], "x0", "x1", "__column", gap_x)
    columns = numbers.groupBy("page", "__column").agg(F.min("x0").alias("low"), F.max("x1").alias("high"), F.collect_set("__line").alias("lines"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__column").alias("column"), "low", "high")))  # a page's columns
    reach = columns.groupBy("page").agg(listed.alias("__columns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("__body"))
    met = lines.join(reach, "page")
    centre = (F.col("x0") + F.col("x1")) / 2
    nearest = F.array_min(F.transform("__columns", lambda c: F.struct(F.abs((c["low"] + c["high"]) / 2 - centre).alias("d"), c["column"].alias("column"))))["column"]
    pitch = F.when(F.size("__columns") > 1, F.get("__columns", F.lit(1))["low"] - F.get("__columns", F.lit(0))["low"]).otherwise(F.lit(float("inf")))
    edge = F.when(F.col("__line") < F.get("__body", F.lit(0)), F.get("__columns", F.lit(0))["low"] - pitch / 2).otherwise(F.get("__columns", F.lit(0))["low"])
    row = F.size(F.filter("__body", lambda line: line <= F.col("__line")))  # lines of the body up to the word's own
    placed = met.select("page", "__line", "x0", "word", row.alias("row"), F.when(centre < edge, 0).otherwise(nearest + 1).cast("int").alias("column"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__line", "x0", "word"))), lambda w: w["word"]), " ")  # one cell's words
    return placed.groupBy("page", "row", "column").agg(text.alias("text"))


def _marks(text: Column) -> Column:
    """The numbered headings that begin lines of a text, each as its ``style`` and ``number``."""
    opening, word, closing = r"[\[【<(（]?", r"[\p{L}]{0,3}", r"번?\s*[\]】>)）.。:]?"
    number = r"(?:\d{1,3}|(?<=\p{L}[ \t]{0,9})\d{4,9}(?=[ \t]*번?\s*[\]】>)）.。:]))"  # of more figures only after a word and before a sign: others are years and counts
    pattern = rf"(?m)^[ \t]*{opening}[ \t]*{word}[ \t]*{number}[ \t]*{closing}(?=\s|\p{{L}}|$)"  # figures are of the number alone
    style = lambda m: collapsed(F.regexp_replace(m, r"\d+", "#"))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(style(m).alias("style"), F.regexp_extract(m, r"\d+", 0).cast("int").alias("number")))
    return F.filter(found, lambda m: m["style"] != "#")


def marker_styles(pages: DataFrame) -> DataFrame:
    """``doc, page, style, number``: the numbered headings that begin lines of a page's text, each by its style: the signs and words around the number, which is ``#``.

    A heading is an opening sign if any, a short word if any, a number of up to
    three figures (of more, if it follows a word and a closing sign follows it), and a closing sign: without a word at least one sign is needed.
    """
    return pages.select("doc", "page", F.inline(_marks(F.coalesce("text", F.lit("")))))


#: Words that, with a number and a closing sign, mark a question wherever they stand (a single Latin letter not at the end of a word), and the names of total rows, spaces in them left out. Bullets are geometric shapes.
QUESTION_WORDS, TOTAL_NAMES = ("SQ", "Q", "표", "문"), ("전체", "합계", "계")
BULLETS = r"\u25A0-\u25FF"


def _questions(text: Column, cells: Column) -> Column:
    """The styles of the numbered question marks of a page, once for every mark.

    A mark is a question word, a number and a closing sign, anywhere; or 번 and a parenthesis
    after a number of one or two figures; or such a number that begins a line, with a parenthesis before a text or a point before one in Hangul or capitals;
    or a question word and a number alone on a line.
    """
    word = "|".join(rf"(?<![\p{{L}}\d_]){w}" if w.isascii() and len(w) == 1 else w for w in QUESTION_WORDS)
    opening, closing = r"[\[【<(（]", r"[\]】>)）.。:]"
    anywhere = rf"(?:{opening}[ \t]*)?(?:{word})\s*\d+\s*번?\s*{closing}|(?<!\d)\d{{1,2}}번\s*\)"
    line = rf"^(?:[ \t]*(?:{word})\s*\d+(?=[ \t]*$)|\s*\d{{1,2}}\s*(?:\)(?=\s+[^\s|])|\.(?=\s+[가-힣A-Z])))"
    needed = reduce(or_, (cells.contains(x) for x in ("번", "\n", *QUESTION_WORDS)))  # cells with none of these hold no mark; patterns cost more than their search
    body = F.when(needed, F.concat(text, F.lit("\n"), cells)).otherwise(text)
    return F.transform(F.regexp_extract_all(body, F.lit(f"(?m){line}|{anywhere}"), F.lit(0)), lambda m: collapsed(F.regexp_replace(m, r"\d+", "#")))


def _totals(body: Column, first: Column) -> Column:
    """The forms in which total rows are named: between two equal bullets or as 전 체 anywhere, else at the beginning of a line; and first cells of rows, without spaces, brackets and bullets."""
    name = f"(?:{'|'.join(r'\s*'.join(n) for n in TOTAL_NAMES)})"
    told = [rf"(?=(([{BULLETS}])\s*{name}\s*\2))", r"(전\s+체)", rf"(?m)^(\s*{name})(?=\s|$)"]  # not one pattern: a choice at every sign takes longer; two names may share a bullet
    alone = F.filter(first, lambda c: F.regexp_replace(c, rf"[\s\[\]{BULLETS}]", "").isin(*TOTAL_NAMES))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in told), alone), squashed))), ",")


def _number_formats(body: Column) -> Column:
    """How the whole numbers of a page are written: with thousands commas or plain (then of three or four figures), in parentheses or not. One parenthesis alone tells neither."""
    figures = {"comma": (r"\d{0,2}(?:,\d{3})++(?!\d|\.\d)", ""), "plain": (r"\d{2,3}(?!\d|[.,]\d)", r"\p{L}_")}  # after the first; and the signs that may not stand beside them
    around = {"parenthesized": lambda n, _: rf"\(\d{n}\)", "plain": lambda n, signs: rf"\d(?<![\d({signs}]\d)(?<!\d[.,]\d){n}(?![){signs}])"}
    return F.concat_ws(",", *(F.when(body.rlike(put(*figures[k])), f"{name}_{k}") for name, put in around.items() for k in figures))


def _ratios(body: Column) -> Column:
    """Where numbers with one decimal stand: three and more in a row, each by itself, or nowhere. Patterns begin with the sign that is told fastest."""
    bunched, single = r"\d\.\d[\s,]*\d{1,3}\.\d[\s,]*\d{1,3}\.\d", r"\.(?<=\b\d{1,3}\.)\d\b"
    return F.when(body.rlike(bunched), "bunched").when(body.rlike(single), "cell").otherwise("none")


def _counted(names: Column) -> Column:
    """Names as ``name=times`` by name."""
    times = lambda name: F.size(names) - F.size(F.array_remove(names, name))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(names)), lambda name: F.concat_ws("=", name, times(name))), ",")


def page_markers(pages: DataFrame) -> DataFrame:
    """``doc, page, styles, questions, totals, formats, ratios, goes_on``: what every page shows of how a report is written.

    Styles are those of the headings that begin lines of its text (``marker_styles``), questions those of the question marks
    anywhere in text and cells, both as ``style=times`` by style. Totals are the forms in which total rows are named, formats those of
    whole numbers. Ratios (numbers with one decimal) are ``bunched`` (three in a row in the text or in one cell), ``cell`` or ``none``.
    A page goes on if it says so, or points to the next page. Pages are read once; nothing is shuffled.
    """
    text, cells, body = F.coalesce("text", F.lit("")), F.col("cells"), F.col("body")
    there = lambda of: F.filter(of, lambda x: x.isNotNull())
    rows = F.coalesce(there(F.flatten(there(F.col("tables")))), F.array().cast("array<array<string>>"))
    read = pages.select("doc", "page", text.alias("text"), _marks(text).alias("marks"), _once(rows).alias("rows"))
    joined = F.concat_ws("|", F.lit(""), F.flatten("rows"))  # by a sign that no number or mark goes on over
    first = there(F.transform("rows", lambda row: F.get(row, F.lit(0))))
    read = read.select("doc", "page", "text", F.col("marks.style").alias("styles"), first.alias("first"), _once(joined).alias("cells"))
    read = read.select("*", _once(F.struct(F.concat("text", F.lit("\n"), cells).alias("body"), _questions(F.col("text"), cells).alias("questions"))).alias("x")).select("doc", "page", "styles", "first", "x.*")
    goes_on = body.contains("계속") | body.contains("다음") & body.rlike(r"다음\s*페이지")
    return read.select(
        "doc", "page", _counted(F.col("styles")).alias("styles"), _counted(F.col("questions")).alias("questions"), _totals(body, F.col("first")).alias("totals"),
        _number_formats(body).alias("formats"), _ratios(body).alias("ratios"), goes_on.alias("goes_on"),
    )


#: The ways in which numbers of a thousand and more are written, in order.
WAYS = ("(0,000", "(0,000)", "(0000", "(0000)", "0,000", "0,000)", "0000", "0000)")


def document_profiles(pages: DataFrame) -> DataFrame:
    """``doc, pages, style, questions, split_questions, in_order, ratios, respondents, goes_on``: what a document's pages have in common.

    Style is the heading style on most pages (of equals the first by name), with
    how many numbers it counts, how many of them head several pages, and whether
    they run from 1 without a gap. Ratios are ``bunched`` (three in a row on a line of most pages
    that have any), ``cell`` or ``none``; respondents tells how numbers of a thousand and more are written.

    Pages are read once. Each gives a row for each of its styles (without a number; the
    first, or one without a style, has what else the page tells) and one for each of its numbers;
    these are grouped by document, style and number, then by document and style, then by document.
    """
    text = F.coalesce("text", F.lit(""))
    ratios = F.transform(F.split(text, r"\n"), lambda line: F.size(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t.rlike(r"^\d{1,3}\.\d$"))))
    most = F.when(text.rlike(r"\d\.\d"), F.array_max(ratios)).otherwise(0)  # on one line; most texts have none, and are not cut into words
    words = F.regexp_extract_all(text, F.lit(r"(?<!\S)[(),\d]{4,}+[\u0085\u2028\u2029]?(?!\S)"), F.lit(0))  # all that the next line can keep
    thousands = F.filter(words, lambda t: F.regexp_replace(t, r"[(),]", "").rlike(r"^\d{4,}$"))
    way = lambda t: F.when(t.startswith("("), 0).otherwise(4) + F.when(t.contains(","), 0).otherwise(2) + F.when(t.endswith(")"), 1).otherwise(0)
    ways = F.aggregate(thousands, F.lit(0), lambda bits, t: bits.bitwiseOR(F.get(F.array(*(F.lit(1 << i) for i in range(len(WAYS)))), way(t))))
    read = pages.select("doc", "page", _marks(text).alias("marks"), most.alias("most"), ways.alias("ways"), text.contains("계속").alias("c"))
    of_page = {"style": "string", "number": "int", "most": "int", "ways": "int", "c": "boolean"}
    fact = lambda **known: F.struct(*(known.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in of_page.items()))
    styles = F.when(F.size("marks") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(F.transform("marks", lambda m: m["style"])))
    own = F.transform(styles, lambda style, i: fact(style=style, **{k: F.when(i == 0, F.col(k)) for k in ("most", "ways", "c")}))
    numbers = F.transform(F.array_distinct("marks"), lambda m: fact(style=m["style"], number=m["number"]))
    facts = read.select("doc", "page", F.inline(F.concat(own, numbers)))
    each = facts.groupBy("doc", "style", "number").agg(
        F.count_distinct("page").alias("n"), F.count("most").alias("pages"), F.count_if(F.col("most") >= 3).alias("b"), F.count_if(F.col("most") > 0).alias("r"), F.bit_or("ways").alias("ways"), F.max("c").alias("c")
    )
    whole = [*(F.sum(k).alias(k) for k in ("pages", "b", "r")), F.bit_or("ways").alias("ways"), F.max("c").alias("c")]
    by_style = each.groupBy("doc", "style").agg(
        F.max(F.when(F.col("number").isNull(), F.col("n"))).alias("on_pages"), F.count("number").alias("questions"), F.count_if(F.col("number").isNotNull() & (F.col("n") > 1)).alias("split_questions"),
        ((F.min("number") == 1) & (F.max("number") == F.count("number"))).alias("in_order"), *whole,
    )
    best = F.struct((-F.col("on_pages")).alias("p"), "style", "questions", "split_questions", "in_order")
    found = by_style.groupBy("doc").agg(F.min(F.when(F.col("style").isNotNull(), best)).alias("m"), *whole)
    kind = F.when(F.col("r") == 0, "none").when(2 * F.col("b") > F.col("r"), "bunched").otherwise("cell")
    respondents = F.array_join(F.filter(F.array(*map(F.lit, WAYS)), lambda _, i: F.getbit("ways", i) == 1), " ")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.select("doc", "pages", F.col("m.style").alias("style"), zero("m.questions").alias("questions"), zero("m.split_questions").alias("split_questions"), F.coalesce("m.in_order", F.lit(False)).alias("in_order"), kind.alias("ratios"), respondents.alias("respondents"), F.col("c").alias("goes_on"))


def table_shapes(pages: DataFrame) -> DataFrame:
    """``doc, with_tables, without_tables, rows, columns``: pages with and without a table, and the most frequent number of rows and of columns of a document's tables (of its widest row; of equals the smaller), 0 without tables."""
    tables = F.coalesce("tables", F.array().cast("array<array<array<string>>>"))
    fact = lambda of, n, there: F.struct(F.lit(of).cast("string").alias("of"), n.cast("int").alias("n"), there.cast("boolean").alias("there"))
    own = F.array(fact(None, F.lit(None), F.size(tables) > 0))  # pages are read once: a row of their own, two for each of their tables
    sizes = F.transform(F.filter(tables, lambda t: F.size(t) > 0), lambda t: F.array(fact("rows", F.size(t), F.lit(None)), fact("columns", F.array_max(F.transform(t, lambda r: F.size(r))), F.lit(None))))
    often = pages.select("doc", F.inline(F.concat(own, F.flatten(sizes)))).groupBy("doc", "of", "n").agg(F.count("*").alias("times"), F.count_if("there").alias("with_tables"), F.count_if(~F.col("there")).alias("without_tables"))
    modes = (F.min_by(F.when(F.col("of") == name, F.col("n")), F.when(F.col("of") == name, F.struct(-F.col("times"), "n"))).alias(name) for name in ("rows", "columns"))
    found = often.groupBy("doc").agg(F.sum("with_tables").alias("with_tables"), F.sum("without_tables").alias("without_tables"), *modes)
    return found.select("doc", "with_tables", "without_tables", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("columns", F.lit(0)).alias("columns"))
