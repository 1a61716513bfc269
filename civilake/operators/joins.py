"""Join shapes of the domain: existence flags, nested lists, enrichment, relaxed lookups and key creation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.operators import substrings


def exists_flag(rows: DataFrame, other: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``rows`` with a boolean: whether ``other`` has the keys. Rows are never multiplied."""
    marks = other.select(*keys).distinct().withColumn(flag, F.lit(True))
    return rows.join(marks, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def nested(rows: DataFrame, children: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """``rows`` with a sorted array of each row's child items, empty where it has none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def enriched(rows: DataFrame, better: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on a key unique in ``better``; each named column takes the better value where there is one."""
    right = better.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = rows.join(right, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def relaxed_lookup(rows: DataFrame, table: DataFrame, exact: list[str], relaxed: list[str], value: str, ordinal: str) -> DataFrame:
    """The value of the first table row that matches all ``exact`` columns, or else all ``relaxed`` ones, or null."""

    def first_by(keys: list[str], name: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.min_by(value, ordinal).alias(name))

    found = rows.join(first_by(exact, "__exact"), exact, "left").join(first_by(relaxed, "__relaxed"), relaxed, "left")
    return found.withColumn(value, F.coalesce("__exact", "__relaxed")).select(*rows.columns, value)


def resolve_or_create(names: DataFrame, table: DataFrame, name: str, key: str, parts: int = 64) -> DataFrame:
    """Each distinct name with its key in the table; unknown names get the next keys in name order, flagged ``created``.

    Unknown names are numbered inside ranges between ``parts`` of them, picked by
    hash, and each range begins where the counts of those before it end.
    """
    wanted = names.select(name).where(F.col(name).isNotNull()).distinct()
    known = wanted.join(table.select(name, key), name)
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    fresh = wanted.join(table, name, "left_anti")
    edges = sorted(row[0] for row in fresh.orderBy(F.xxhash64(name), name).limit(parts).collect())
    held = F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge <= F.col(name))) if edges else F.lit(0)
    ranged = fresh.withColumn("__part", held)
    numbered = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(name)))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__size"))  # at most parts + 1 rows
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__part"), before.alias("__before"))
    created = numbered.join(F.broadcast(starts), "__part").join(F.broadcast(top))  # one row
    created = created.select(name, (F.col("__top") + F.col("__before") + F.col("__n")).alias(key), F.lit(True).alias("created"))
    return known.withColumn("created", F.lit(False)).unionByName(created)


def combined_counts(parts: list[DataFrame], key: str) -> DataFrame:
    """Full-outer combination of tables of counts, each with one row a key; a missing count is 0."""
    every = reduce(lambda a, b: a.join(b, key, "full"), parts)
    return every.select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in every.columns if c != key))


def preferred_or_all(rows: DataFrame, group: list[str], preferred: Column) -> DataFrame:
    """Per group the preferred rows if there are any, else all of them."""
    some = F.max(preferred.cast("int")).over(Window.partitionBy(*group)) == 1
    return rows.withColumns({"__some": some, "__own": preferred}).where("__own OR NOT coalesce(__some, false)").drop("__some", "__own")


def first_contained(rows: DataFrame, registry: DataFrame, name: str, keyword: str, ordinal: str, value: str) -> DataFrame:
    """``rows`` with the value of the first registry entry whose keyword the name holds, or null. Empty keywords are held by none."""
    met = substrings.contained(rows, registry, name, keyword).withColumnRenamed(name, "__name")
    found = met.join(registry, keyword).groupBy("__name").agg(F.min_by(value, ordinal).alias(value))
    return rows.join(found, F.col(name) == F.col("__name"), "left").drop("__name")


def classified(rows: DataFrame, rules: DataFrame, key: str, name: str, other: str = "uncovered") -> DataFrame:
    """``rows`` with the ``status`` and ``parser`` of the best rule (``kind, ordinal, name, status, parser``).

    Rules of an equal name come first, by kind; then those where either name holds
    the other, by kind, then in their order. Without any the status is ``other``.
    """
    entries = rules.select("kind", "ordinal", F.col("name").alias("__rule"), "status", "parser")
    names = rows.select(F.col(name).alias("__name")).distinct()
    either = substrings.contained(names, entries, "__name", "__rule").unionByName(substrings.contained(entries, names, "__rule", "__name")).distinct()
    met = either.join(entries, "__rule")
    best = met.groupBy("__name").agg(F.min_by(F.struct("status", "parser"), F.struct(F.col("__name") != F.col("__rule"), "kind", "ordinal")).alias("__best"))
    joined = rows.join(best, F.col(name) == F.col("__name"), "left")
    return joined.select(*rows.columns, F.coalesce("__best.status", F.lit(other)).alias("status"), F.col("__best.parser").alias("parser"))


def by_key_or_name(asked: DataFrame, found: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Each asked row's values: those of its key, or only if there are none those whose name holds the asked name; ``by_key`` tells which. Asked rows without either give none."""
    own = asked.join(found.select(key, value).hint("merge"), key).select(key, name, F.lit(True).alias("by_key"), value)  # all sides may be large: none is sent to all tasks
    rest = asked.join(found.select(key).hint("merge"), key, "left_anti").select(key, F.col(name).alias("__asked"))
    names = found.select(F.col(name).alias("__name"), value)
    held = substrings.contained(names, rest, "__name", "__asked")
    other = rest.join(held.hint("merge"), "__asked").join(names.hint("merge"), "__name").select(key, F.col("__asked").alias(name), F.lit(False).alias("by_key"), value)
    return own.unionByName(other)
