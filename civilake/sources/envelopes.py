"""Landed API answers as rows: paged JSON envelopes, XML items and JSON lines, with their result codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilake.sources import mapped

#: Codes of a successful answer, and of one that is empty on purpose.
SUCCESS, NO_DATA = ("INFO-000", "00"), ("INFO-200", "03")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """``path, body``: each landed answer whole, whatever its size."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def _answers(pages: DataFrame, endpoint: str, row_schema: str, body: str) -> tuple[DataFrame, str]:
    """``code, checked rows, total`` of ``{endpoint: [{head: [...]}, {row: [...]}]}`` answers, and the type of the rows."""
    rows_type = f"array<struct<{_fields(row_schema)}>>"
    part = f"struct<head:array<struct<list_total_count:bigint,RESULT:struct<CODE:string,MESSAGE:string>>>,row:{rows_type}>"
    answer = F.from_json(body, f"struct<`{endpoint}`:array<{part}>,RESULT:struct<CODE:string,MESSAGE:string>,malformed:string>", {"columnNameOfCorruptRecord": "malformed"})
    parsed = pages.select(answer.alias("a"))
    none = F.array().cast(rows_type)
    fail = lambda reason: F.raise_error(F.concat(F.lit(f"{endpoint}: "), reason)).cast(rows_type)
    top, root = F.col("a.RESULT"), F.col(f"a.`{endpoint}`")
    head = F.get(root, F.lit(0))["head"]
    code = F.coalesce(top["CODE"], F.get(head, F.lit(1))["RESULT"]["CODE"])
    said = F.concat(F.lit("the answer's code is "), F.coalesce(code, F.lit("missing")))
    checked = (
        F.when(F.col("a").isNull() | F.col("a.malformed").isNotNull(), fail(F.lit("the answer is no JSON")))
        .when(code.isin(*NO_DATA), none)
        .when(top.isNotNull(), fail(said))
        .when(F.coalesce(F.size(root), F.lit(0)) < 2, none)
        .when(~F.coalesce(code.isin(*SUCCESS), F.lit(False)), fail(said))
        .otherwise(F.coalesce(F.get(root, F.lit(1))["row"], none))
    )
    return parsed.select(checked.alias("rows"), F.get(head, F.lit(0))["list_total_count"].alias("total")), rows_type


def envelope_rows(pages: DataFrame, endpoint: str, row_schema: str, body: str = "body") -> DataFrame:
    """Rows of ``{endpoint: [{head: [{list_total_count}, {RESULT}]}, {row: [...]}]}`` answers.

    A no-data code, an answer without the endpoint and one of less than two parts
    give no rows. Any other code that is not a success, a missing code and a body
    that is no JSON fail the job.
    """
    return _answers(pages, endpoint, row_schema, body)[0].select(F.inline("rows"))


def page_totals(pages: DataFrame, endpoint: str, row_schema: str, body: str = "body") -> DataFrame:
    """One row: answers, rows in them, the largest total they name, and whether that many rows have landed."""
    answers, _ = _answers(pages, endpoint, row_schema, body)
    found = answers.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("rows"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    return found.withColumn("complete", F.col("rows") >= F.col("total"))


def early_stop(pages: DataFrame, page: str, rows: str, first_date: Callable[[Column], Column], start: Column, end: Column, page_size: int) -> DataFrame:
    """Rows of pages listed newest first whose date lies in the range, up to the page where a scan would stop.

    A scan stops at the first page that is short, or whose last dated row is
    older than ``start``; it has still read that page. ``rows`` is the column of
    each page's rows, ``first_date`` a row's first parseable date.
    """
    dates = F.transform(F.col(rows), first_date)
    oldest = F.element_at(F.array_compact(F.concat(F.array(F.lit(None).cast("date")), dates)), -1)
    dated = F.size(F.array_compact(dates)) > 0
    stops = pages.where((F.size(rows) < page_size) | (dated & (oldest < start))).agg(F.min(page).alias("__last"))
    read = pages.join(F.broadcast(stops)).where(F.col("__last").isNull() | (F.col(page) <= F.col("__last")))  # one row
    each = read.select(page, F.explode(rows).alias("__row"))
    return each.where(first_date(F.col("__row")).between(start, end)).select(page, "__row.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in schema.split(",")))


def lines_with_ids(lines: DataFrame, expected: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Parsed lines whose missing key is that expected at their place (``ordinal``, ``key`` of both sides)."""
    wanted = expected.select(ordinal, F.col(key).alias("__key"))
    return lines.join(wanted, ordinal, "left").withColumn(key, F.coalesce(key, "__key")).drop("__key")


def _items(body: Column, path: str) -> Column:
    """The elements at a path below the root of an XML text, one or many, as an array of variants; attributes and name spaces make no difference."""
    found = F.try_variant_get(mapped.value_of(body), f"$.{path}", "variant")
    one = F.when(F.schema_of_variant(found).startswith("OBJECT"), F.array(found))
    return F.coalesce(F.try_variant_get(found, "$", "array<variant>"), one)


def xml_items(pages: DataFrame, path: str, row_schema: str, code_path: str | None = None, body: str = "body") -> DataFrame:
    """One row per element at ``path`` (below the root) of XML answers, its child tags as columns; answers of another code give none."""
    good = F.lit(True)
    if code_path:
        good = F.coalesce(F.xpath_string(body, F.lit(code_path)).isin(*SUCCESS), F.lit(False))
    each = pages.where(good).select(F.explode(_items(F.col(body), path)).alias("x"))
    return each.select(*(mapped.text_at(F.col("x"), F.lit(f"$.{name}")).try_cast(kind).alias(name) for name, kind in (part.split() for part in row_schema.split(","))))


def alternative_edges(pages: DataFrame, parent: str, path: str = "items.exhaust", link: str = "billLink", key: str = "bill_id", body: str = "body") -> DataFrame:
    """``parent, child`` of every element at ``path`` in the XML answers: the child is the id that its link names; elements without one are left out."""
    each = pages.select(F.col(parent).alias("parent"), F.explode(_items(F.col(body), path)).alias("x"))
    child = F.nullif(F.regexp_extract(mapped.text_at(F.col("x"), F.lit(f"$.{link}")), rf"[?&;]{key}=([^&<#]*)", 1), F.lit(""))
    return each.select("parent", child.alias("child")).where("child IS NOT NULL")


def json_path(c: Column, path: str) -> Column:
    """A value inside a JSON text by a path such as ``a.b[0]``, as text; null if any step is missing."""
    return F.get_json_object(c, f"$.{path}")


def result_lines(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """JSON lines; a line that does not parse stays, with its text in ``malformed``."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"{row_schema}, malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    return lines.select(parsed.alias("r")).select("r.*")


def dated_between(rows: DataFrame, date_columns: list[Column], start: Column, end: Column) -> DataFrame:
    """Rows whose first parseable date lies in the range; rows without one are dropped."""
    return rows.where(F.coalesce(*date_columns).between(start, end))


TARGET_CONFIG = "regions array<struct<slug:string,region:string>>, elections array<struct<slug:string,names:array<string>>>, targets array<struct<slug:string,region:string,election:string,pollsters:array<string>>>"


def target_config(pages: DataFrame, body: str = "body") -> DataFrame:
    """``target, want_region, want_names, want_pollsters`` of JSON configurations; a target that names no region or election wants any."""
    read = pages.select(F.from_json(body, TARGET_CONFIG).alias("c"))
    regions = read.select(F.inline("c.regions").alias("region", "want_region"))
    elections = read.select(F.inline("c.elections").alias("election", "want_names"))
    targets = read.select(F.inline("c.targets").alias("target", "region", "election", "want_pollsters"))
    return targets.join(regions, "region", "left").join(elections, "election", "left").select("target", "want_region", "want_names", "want_pollsters")


def records_for_targets(records: DataFrame, targets: DataFrame, fits: Column, region: tuple[str, str] | None = None, max_targets: int = 10_000) -> DataFrame:
    """Each record with each target it fits, from one scan of the records.

    Up to ``max_targets`` targets are broadcast. Of more, those that name a region
    are joined on it (``region`` names the column of each side), and only those
    that name none are broadcast; if even they are more than that, Spark chooses
    how to compare them with every record.
    """
    few = lambda some: some.limit(max_targets + 1).count() <= max_targets
    if few(targets):
        return records.join(F.broadcast(targets), fits)
    if region is None:
        return records.join(targets, fits)
    own, wanted = region
    anywhere = targets.where(F.col(wanted).isNull())
    return records.join(targets, (F.col(own) == F.col(wanted)) & fits).unionByName(records.join(F.broadcast(anywhere) if few(anywhere) else anywhere, fits))


def unseen(landed: DataFrame, seen: DataFrame, key: str, ordinal: str, order: Column | None = None) -> DataFrame:
    """Rows of a resumed collection that are new: keys not collected before, each once, at its first place, with the values of the first row by ``order`` (without one, by place)."""
    rest = [c for c in landed.columns if c not in (key, ordinal)]
    values = F.min_by(F.struct(*rest), F.col(ordinal) if order is None else order) if rest else F.lit(None)
    first = landed.join(seen.select(key), key, "left_anti").groupBy(key).agg(F.min(ordinal).alias(ordinal), values.alias("__x"))
    return first.select(*(F.col(c if c in (key, ordinal) else f"__x.{c}").alias(c) for c in landed.columns))
