"""Landed JSON and XML answers of any envelope, read by a table of mappers: where the rows, the total, the result code and each field are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.session import spread

#: A row for each endpoint. Paths are those of ``variant`` values (``$.a.b[0]``). Of codes, ``ok`` are success and ``empty`` an answer without rows on purpose;
#: without a ``code_path``, or a code where ``lenient``, an answer is a success. ``first_key``: rows are under the answer's first key if ``data_path`` leads nowhere, which then starts below that key (``rest``).
MAPPER = (
    "endpoint string, data_path string, total_path string, code_path string, ok array<string>, empty array<string>, lenient boolean, first_key boolean, rest string, fields map<string,string>"
)


#: A private-use character that stands before every text of an XML value: the reader would take ``007`` for the number 7.
MARK = "\ue000"


def value_of(body: Column) -> Column:
    """A JSON or XML text as a variant, null if it is neither. Of XML, attributes are fields that begin with ``_``, name spaces are dropped, and texts begin with MARK: read them by ``text_at``."""
    given = F.ltrim(body)
    marked = F.regexp_replace(F.when(given.startswith("<"), body), r">(?=\s*[^<\s][^<]*</)", ">" + MARK)
    return F.when(given.startswith("<"), F.from_xml(marked, "variant", {"ignoreNamespace": "true"})).otherwise(F.try_parse_json(body))


def text_at(value: Column, path: Column) -> Column:
    """What stands at a path of a variant, as text; null if nothing does, or if the path is null."""
    return F.replace(F.try_variant_get(value, F.coalesce(path, F.lit("$.__nowhere")), "string"), F.lit(MARK))


def _at(value: Column, path: Column) -> Column:
    return F.try_variant_get(value, F.coalesce(path, F.lit("$.__nowhere")), "variant")


def answers(pages: DataFrame, mappers: DataFrame, body: str = "body") -> DataFrame:
    """``endpoint, status, code, total, items``: each page's rows as an array of variants.

    Status is ``ok``, ``empty`` (its code says so), ``failed`` (another code) or
    ``malformed``; only ``ok`` has items. A single object where a list is expected is a list of one,
    anything else there none. Pages of endpoints without a mapper are left out.
    """
    read = spread(pages).join(F.broadcast(mappers), "endpoint").withColumn("__v", value_of(F.col(body)))
    code = F.when(F.col("code_path").isNotNull(), text_at(F.col("__v"), F.col("code_path")))
    accepted = F.array_contains("ok", code) | F.col("code_path").isNull() | (code.isNull() & F.coalesce("lenient", F.lit(False)))
    status = F.when(F.col("__v").isNull(), "malformed").when(F.coalesce(F.array_contains("empty", code), F.lit(False)), "empty").when(F.coalesce(accepted, F.lit(False)), "ok").otherwise("failed")
    key = F.get(F.json_object_keys(body), F.lit(0))
    below = F.when(F.col("first_key"), F.concat(F.lit('$["'), key, F.lit('"]'), F.coalesce("rest", F.lit(""))))
    data = F.coalesce(_at(F.col("__v"), F.col("data_path")), _at(F.col("__v"), below))
    told = read.withColumns({"status": status, "code": code, "total": text_at(F.col("__v"), F.col("total_path")).try_cast("bigint"), "__data": data})
    kind = F.schema_of_variant("__data")
    one = F.when(kind.startswith("OBJECT"), F.array("__data"))
    items = F.when(F.col("status") == "ok", F.coalesce(F.when(kind.startswith("ARRAY"), F.try_variant_get("__data", "$", "array<variant>")), one)).alias("items")
    return told.select("endpoint", "status", "code", "total", items, "fields")


def rows(pages: DataFrame, mappers: DataFrame, columns: list[str], body: str = "body") -> DataFrame:
    """``endpoint`` and the named columns, as texts, of every item of every good page; a column that an endpoint's mapper does not name is null."""
    each = answers(pages, mappers, body).select("endpoint", "fields", F.explode("items").alias("item"))
    return each.select("endpoint", *(F.when(F.map_contains_key("fields", c), text_at(F.col("item"), F.try_element_at("fields", F.lit(c)))).alias(c) for c in columns))


def totals(pages: DataFrame, mappers: DataFrame, body: str = "body") -> DataFrame:
    """For each endpoint: pages by status, rows landed, the largest total named, and whether that many have landed."""
    said = answers(pages, mappers, body)
    found = said.groupBy("endpoint").agg(
        F.count("*").alias("pages"), F.count_if(F.col("status").isin("failed", "malformed")).alias("failed"),
        F.coalesce(F.sum(F.size(F.coalesce("items", F.array().cast("array<variant>")))), F.lit(0)).alias("rows"), F.coalesce(F.max("total"), F.lit(0)).alias("total"),
    )
    return found.withColumn("complete", F.col("rows") >= F.col("total"))
