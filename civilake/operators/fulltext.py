"""Full-text search: an inverted index with positions, kept as sorted Parquet, and boolean queries that read only their words' postings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
POSTING = "word string, field string, id bigint, positions array<int>"
#: So many changed ids reach every task of an update; of more, the postings are shuffled by id.
BROADCAST_IDS = 4_000_000
TERM = re.compile(r'([+-]?)(?:"([^"]*)"|([^\s"]+))')


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def postings(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """POSTING rows: where each word stands in each field of each row, and for each text that is not null one of the word ``""``. Keys must be unique."""
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("t")
    there = rows.select(F.col(key).cast("bigint").alias("id"), texts).where("t.text IS NOT NULL").select("id", "t.field", "t.text")
    made = lambda *values: F.explode(F.array(*values))  # made once: a column that a lambda names would be made again for each of its elements
    placed = F.sort_array(F.transform(words_of(F.col("text")), lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    sorted_ = there.select("id", "field", made(F.concat(F.array(F.struct(F.lit("").alias("word"), F.lit(None).cast("int").alias("at"))), placed)).alias("w"))
    begins = F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (x["word"] != F.get("w", i - 1)["word"]), i)), lambda i: i.isNotNull())
    cut = sorted_.select("id", "field", "w", made(begins).alias("b"))
    end = lambda k: F.coalesce(F.get("b", k + 1), F.size("w"))
    each = F.transform("b", lambda i, k: F.struct(F.get("w", i)["word"].alias("word"), F.array_compact(F.transform(F.slice("w", i + 1, end(k) - i), lambda x: x["at"])).alias("positions")))
    return cut.select("id", "field", F.inline(each)).select("word", "field", "id", "positions")  # one text's places of one word; nothing is shuffled


@dataclass(frozen=True)
class Index:
    """A written index: ``postings`` sorted by word, and ``fields``, the number of texts of each field."""

    postings: DataFrame
    fields: DataFrame


def _written(found: DataFrame, path: str) -> Index:
    """Each task writes its rows' postings as a file sorted by word, and shuffles nothing: in every file those of a word or a prefix are neighbouring small row groups that statistics tell apart, and a word of very many rows lies in all files."""
    found.sortWithinPartitions("word", "field", "id").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/postings")
    back = found.sparkSession.read.schema(POSTING).parquet(f"{path}/postings")
    back.where("word = ''").groupBy("field").agg(F.count("*").alias("rows")).write.parquet(f"{path}/fields")
    return opened(found.sparkSession, path)


def build(rows: DataFrame, key: str, fields: list[str], path: str) -> Index:
    """Write the index of some fields of a table under ``path``."""
    return _written(postings(rows, key, fields), path)


def opened(spark: SparkSession, path: str) -> Index:
    """An index written before."""
    return Index(spark.read.schema(POSTING).parquet(f"{path}/postings"), spark.read.schema("field string, rows bigint").parquet(f"{path}/fields"))


def updated(index: Index, rows: DataFrame, key: str, fields: list[str], path: str) -> Index:
    """The index after ``rows`` are added, or replace those of the same keys, written anew under ``path``; texts of other rows are not read again."""
    changed = rows.select(F.col(key).cast("bigint").alias("id"))
    if changed.count() <= BROADCAST_IDS:
        changed = F.broadcast(changed)
    return _written(index.postings.join(changed, "id", "left_anti").unionByName(postings(rows, key, fields)), path)


@dataclass(frozen=True)
class Term:
    """One part of a query: its words in order, whether the last is a prefix, and whether rows must (+), must not (-) or may have it."""

    words: tuple[str, ...]
    prefix: bool = False
    sign: str = ""


def terms(query: str) -> list[Term]:
    """The parts of a boolean query: ``+must -mustnot may pre* "a phrase"``. Parts without a word are left out; other signs split words."""
    found = []
    for sign, phrase, single in TERM.findall(query):
        words = tuple(re.findall(r"\w+", (phrase or single).lower()))
        if words:
            found.append(Term(words, not phrase and single.endswith("*"), sign))
    return found


def wanted(term: Term) -> Column:
    """Postings that the term needs: equalities and prefixes, which reach the scan."""
    if term.prefix:
        return reduce(or_, [F.col("word") == w for w in term.words[:-1]], F.col("word").startswith(term.words[-1]))
    return F.col("word").isin(*set(term.words))


def times(term: Term) -> Column:
    """How often a row's field has the term, from its postings."""
    word = F.col("word")
    last = word.startswith(term.words[-1]) if term.prefix else word == term.words[-1]
    if len(term.words) == 1:
        return F.coalesce(F.sum(F.when(last, F.size("positions"))), F.lit(0))
    at = lambda match, step: F.transform(F.flatten(F.collect_list(F.when(match, F.col("positions")))), lambda x: x - step)
    starts = at(word == term.words[0], 0)
    for step, w in enumerate(term.words[1:], 1):
        starts = F.array_intersect(starts, at(last if step == len(term.words) - 1 else word == w, step))
    return F.size(starts).cast("bigint")


def scores(index: Index, query: str) -> DataFrame:
    """``id, field, relevance`` of the fields that match: all ``+`` parts, no ``-`` part and at least one other part are there.

    Relevance is the sum over parts of times * log10(1 + rows / rows with the part)^2,
    each field counted on its own. Only postings of the query's words are read,
    and a row's are summed before they are weighed.
    """
    parts = terms(query)
    if not any(t.sign != "-" for t in parts):
        return index.postings.sparkSession.createDataFrame([], "id bigint, field string, relevance double")
    read = index.postings.where(reduce(or_, map(wanted, parts)))
    held = read.groupBy("field", "id").agg(*(times(t).alias(f"t{i}") for i, t in enumerate(parts)))
    counts = held.groupBy("field").agg(*(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(parts))))
    weighed = held.join(F.broadcast(counts.join(index.fields, "field")), "field")  # a row a field
    has = [F.col(f"t{i}") > 0 for i in range(len(parts))]
    some = reduce(or_, [h for h, t in zip(has, parts, strict=True) if t.sign != "-"])
    holds = reduce(and_, [h if t.sign == "+" else ~h for h, t in zip(has, parts, strict=True) if t.sign], some)
    weight = lambda i: F.pow(F.log10(1 + F.try_divide(F.col("rows"), F.col(f"d{i}"))), 2)
    relevance = sum((F.col(f"t{i}") * F.coalesce(weight(i), F.lit(0.0)) for i, t in enumerate(parts) if t.sign != "-"), F.lit(0.0))
    return weighed.where(holds).select("id", "field", relevance.alias("relevance"))


def search(index: Index, query: str, fields: list[str]) -> DataFrame:
    """``id, <field>_rel ...``: rows that match in any of the fields, with each field's relevance, 0 where it does not match."""
    found = scores(index, query)
    return found.groupBy("id").agg(*(F.coalesce(F.max(F.when(F.col("field") == f, F.col("relevance"))), F.lit(0.0)).alias(f"{f}_rel") for f in fields))
