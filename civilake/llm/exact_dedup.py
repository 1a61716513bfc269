"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.llm.sampling import few, unused
from civilake.llm.staging import staged

#: A group of equal texts of more rows gets its decision by a join of its own, so that no task takes a whole large group.
LARGE_GROUP = 500


def _keys(text: Column, prefix_chars: int) -> tuple[Column, Column]:
    return F.octet_length(text), F.xxhash64(F.substring(text, 1, prefix_chars))


def decided(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, hash_all: bool, normalise) -> DataFrame:
    """``id, row, size, prefix, sha, shared`` and each row's decision ``group_size, keep_id, kept``; staged, so ``row`` is fixed."""
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"))
    size, prefix = _keys(F.col("body"), prefix_chars)
    # Lengths alone, then prefixes of texts whose length is shared, then whole texts whose prefix is.
    lengths = staged(rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).where("n > 1").select("size"), "dedup-lengths")
    of_shared_length = rows.withColumn("size", size).join(lengths, "size", "left_semi").select("size", prefix.alias("prefix"))
    keys = of_shared_length.groupBy("size", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("size", "prefix", F.lit(True).alias("shared"))
    keys = staged(keys, "dedup-prefixes")

    sha = F.sha2(F.col("body").cast("binary"), 256)
    if hash_all:  # every hash is wanted anyway, so no text need cross a shuffle
        marked = rows.select("id", size.alias("size"), prefix.alias("prefix"), sha.alias("sha")).join(keys, ["size", "prefix"], "left")
    else:
        marked = rows.select("id", size.alias("size"), prefix.alias("prefix"), "body").join(keys, ["size", "prefix"], "left").withColumn("sha", F.when(F.col("shared"), sha))
    marked = marked.select("id", "size", "prefix", "sha", F.coalesce("shared", F.lit(False)).alias("shared"))
    hashed = staged(marked.withColumn("row", F.monotonically_increasing_id()), "dedup-hashes")

    groups = hashed.where("shared").groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("stays")).where("group_size > 1")
    groups = staged(groups, "dedup-groups")
    large = staged(groups.where(F.col("group_size") > LARGE_GROUP).select("sha", F.struct("group_size", "stays").alias("large")), "dedup-large")
    small = groups.where(F.col("group_size") <= LARGE_GROUP).select("sha", F.struct("group_size", "stays").alias("small"))
    first = hashed.where("shared").join(large, "sha", "left")
    own = ["id", "row", "size", "prefix", "sha", "shared"]
    in_large = first.where("large IS NOT NULL").select(*own, F.col("large").alias("found"))
    in_small = first.where("large IS NULL").join(small, "sha", "left").select(*own, F.col("small").alias("found"))
    alone = hashed.where("NOT shared").select(*own, F.lit(None).cast(in_small.schema["found"].dataType).alias("found"))
    return in_large.unionByName(in_small).unionByName(alone).select(
        *own,
        F.coalesce("found.group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("found.stays.id")).alias("keep_id"),
        F.coalesce(F.col("found.stays.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, hash_all: bool = False, normalise=lambda text: text) -> DataFrame:
    """One row per input row: ``id, group_size, keep_id, kept, text_sha256``.

    First the texts' lengths in octets are counted; then, of texts whose length
    occurs again, hashes of the first ``prefix_chars`` characters; then texts
    whose length and prefix occur again are read in full and hashed (SHA-256) and
    their groups are formed. The keys that survive are joined back; where they
    are few Spark sends them to the rows, else the surviving texts are shuffled once.

    Null text counts as empty. Of equal texts the row with the largest id stays;
    a null id is smaller than any other, and of repeated rows with the same id
    exactly one stays. ``text_sha256`` is null for texts that were never read in
    full, unless ``hash_all``. An empty table gives an empty result. Other
    columns of ``docs`` are not looked at, whatever their names.
    """
    found = decided(docs, id_col, text_col, prefix_chars, hash_all, normalise)
    return found.select("id", "group_size", "keep_id", "kept", F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    Null and empty texts are equal. Rows are found again by a hash of id, length
    and prefix; only those that might have to go are hashed in full and compared
    by id and full hash. Of rows repeated with the same id and text one stays,
    whichever.
    """
    found = decided(docs, id_col, text_col, prefix_chars, False, lambda text: text).where("shared")
    acted = found.groupBy("id", "size", "prefix", "sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    acted = staged(acted, "dedup-acted")
    keys = few(staged(acted.select(F.xxhash64("id", "size", "prefix").alias("key")).distinct(), "dedup-candidates"))
    text = F.coalesce(docs[text_col], F.lit(""))
    same = F.xxhash64(docs[id_col], *_keys(text, prefix_chars)) == keys["key"]
    sha = unused(docs, "__sha")
    candidates = docs.join(keys, same, "left_semi").withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    gone = acted.where("NOT kept").select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    stay = candidates.join(gone, candidates[id_col].eqNullSafe(gone["gone_id"]) & (candidates[sha] == gone["gone_sha"]), "left_anti")
    return docs.join(keys, same, "left_anti").unionByName(stay.dropDuplicates([id_col, sha]).drop(sha))


def op2(docs: DataFrame) -> DataFrame:
    """The rows of query ``op2_exact_dedup``: every document with its group and its text's hash."""
    return refine(docs, hash_all=True).withColumnRenamed("id", "doc_id")
