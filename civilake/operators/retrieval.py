"""Retrieval by built-in expressions: cosine neighbours, context texts, keyword tags, name-based ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, query: DataFrame, key: str, vector: str, query_vector: str, k: int, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """The ``k`` rows nearest to the one row of ``query`` by cosine; ties go to the smaller key, rows without a score are left out."""
    one = F.broadcast(query.select(query_vector).limit(1))  # one vector
    scored = rows.join(one).select(key, F.round(cosine(F.col(vector), F.col(query_vector)), digits).alias("score")).where("score IS NOT NULL")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), key).limit(k)


def context(rows: DataFrame, score: Column, tie: Column, line: Column, separator: str = "\n\n") -> DataFrame:
    """One text of the lines of a few rows, best score first, and their number."""
    ordered = F.array_sort(F.collect_list(F.struct((-score).alias("s"), tie.alias("t"), line.alias("l"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["l"]), separator).alias("context"), F.count("*").alias("n"))


def first_keyword(rows: DataFrame, field: Column, keywords: list[str]) -> DataFrame:
    """Rows whose field holds any keyword, tagged with the first one held."""
    tag = F.coalesce(*(F.when(field.contains(word), F.lit(word)) for word in keywords))
    return rows.withColumn("keyword", tag).where("keyword IS NOT NULL")


def uuid5(namespace: Column, name: Column) -> Column:
    """The name-based (SHA-1) UUID of a namespace UUID and a name."""
    digest = F.sha1(F.concat(F.unhex(F.translate(namespace, "-", "")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)
    )
