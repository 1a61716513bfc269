"""Substring joins without comparing every pair: the rarest q-gram of each keyword is the join key, and the whole keyword then decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of grams: a keyword is looked up by grams of the largest that it has room for. Long ones are rare however many texts there are.
SIZES = (1, 2, 3, 4, 8, 16, 32)


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, keywords: DataFrame, text: str, keyword: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``text, keyword``: every pair of a distinct text and a distinct keyword that it holds. Null and empty ones are in no pair.

    Texts are cut into grams of those of the ``sizes`` (1 among them) that keywords
    need, kept as hashes. Each keyword is looked up by that one of its grams that
    the fewest texts have; one with a gram that no text has is held by none. No
    side is sent to all tasks, whatever its size.
    """
    texts = texts.select(F.col(text)).where(F.length(text) > 0).distinct()
    keywords = keywords.select(F.col(keyword)).where(F.length(keyword) > 0).distinct()
    sized = F.lit(sizes[0])
    for size in sizes[1:]:
        sized = F.when(F.length(keyword) >= size, size).otherwise(sized)
    needed = sorted(r[0] for r in keywords.select(sized).distinct().collect())  # no more rows than sizes
    if not needed:
        return texts.select(text, F.lit(None).cast("string").alias(keyword)).limit(0)
    hashed = lambda c, size: F.transform(grams(F.col(c), size), lambda gram: F.xxhash64(gram))
    every = F.array_distinct(F.flatten(F.array(*(hashed(text, size) for size in needed))))
    held = texts.select(F.xxhash64(text).alias("__text"), F.explode(every).alias("__gram"))
    counts = held.groupBy("__gram").agg(F.count("*").alias("__texts"))
    own = F.array().cast("array<bigint>")
    for size in needed:
        own = F.when(sized == size, hashed(keyword, size)).otherwise(own)
    wanted = keywords.select(keyword, F.explode(own).alias("__gram")).join(counts.hint("merge"), "__gram", "left")
    rarest = wanted.groupBy(keyword).agg(F.min(F.struct(F.coalesce("__texts", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("__least"))
    keys = rarest.where("__least.n > 0").select(keyword, F.col("__least.gram").alias("__gram"))
    met = held.join(keys.hint("merge"), "__gram").select("__text", keyword).distinct()
    return texts.withColumn("__text", F.xxhash64(text)).join(met.hint("merge"), "__text").where(F.contains(text, keyword)).select(text, keyword)
