"""Search structures against loops over all rows: the inverted index, the vector cells, substring joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civilake.operators import fulltext, joins, substrings, vectors
from civilake.session import work_path

WORDS = ["tax", "taxes", "law", "bill", "new", "of", "the", "health", "care", "Ärzte", "세금", "a_b"]


def plain_search(rows, query, fields):
    """Every row's relevance by a loop over its words."""
    import math
    import re

    parts = fulltext.terms(query)
    out = {}
    for at, field in enumerate(fields):
        texts = {i: re.findall(r"\w+", t[at].lower()) for i, *t in rows if t[at] is not None}

        def count(words, term):
            fits = lambda w, i: w.startswith(term.words[i]) if term.prefix and i == len(term.words) - 1 else w == term.words[i]
            return sum(all(fits(words[p + i], i) for i in range(len(term.words))) for p in range(len(words) - len(term.words) + 1))

        counts = {i: [count(w, t) for t in parts] for i, w in texts.items()}
        for i, c in counts.items():
            if any((t.sign == "+" and not n) or (t.sign == "-" and n) for t, n in zip(parts, c, strict=True)) or not any(n for t, n in zip(parts, c, strict=True) if t.sign != "-"):
                continue
            hits = [sum(x[k] > 0 for x in counts.values()) for k in range(len(parts))]
            rel = sum(n * math.log10(1 + len(texts) / hits[k]) ** 2 for k, (t, n) in enumerate(zip(parts, c, strict=True)) if t.sign != "-" and n)
            out.setdefault(i, [0.0] * len(fields))[at] = rel
    return {i: [round(r, 9) for r in rels] for i, rels in out.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", "!?"]) if rng.random() < 0.1 else " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(1, 12)))
    return [(i, text(), text()) for i in range(150)]


QUERIES = ["tax*", "+law -bill", '"new law" of', "+health* +care", "-tax", '"of the law"', "세금 ärzte", "nothing", "", '+"the bill" tax -new', "+a_b law*"]


def found(index, query):
    return {r.id: [round(r.title_rel, 9), round(r.body_rel, 9)] for r in fulltext.search(index, query, ["title", "body"]).collect()}


def test_boolean_search(spark, corpus):
    table = spark.createDataFrame(corpus, "bill bigint, title string, body string")
    index = fulltext.build(table, "bill", ["title", "body"], work_path(spark, "index"))
    for query in QUERIES:
        assert found(index, query) == plain_search(corpus, query, ["title", "body"]), query
    rng = random.Random(5)
    fresh = [(i, "new tax law", rng.choice([None, "the bill"])) for i in [*range(140, 160), 3, 5]]
    merged = {i: (i, *t) for i, *t in corpus} | {i: (i, *t) for i, *t in fresh}
    index = fulltext.updated(index, spark.createDataFrame(fresh, "bill bigint, title string, body string"), "bill", ["title", "body"], work_path(spark, "index"))
    for query in QUERIES[:6]:
        assert found(index, query) == plain_search(list(merged.values()), query, ["title", "body"]), query


def test_only_the_words_postings_are_read(spark, corpus, capsys):
    table = spark.createDataFrame(corpus, "bill bigint, title string, body string")
    index = fulltext.build(table, "bill", ["title"], work_path(spark, "index"))
    fulltext.search(index, "+law tax*", ["title"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(word,law)" in plan and "StringStartsWith(word,tax)" in plan


def test_vector_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + rng.normal(size=16) * 0.5).tolist()) for i in range(1200)]
    data += [(5000, [0.0] * 16), (5001, None), (5002, [float("nan")] * 16), (5003, [1.0, 2.0]), (5004, data[7][1]), (5005, data[7][1])]
    schema = "key bigint, v array<float>"
    table = spark.createDataFrame(data, schema)
    index = vectors.build(table, "key", "v", work_path(spark, "cells"), 30)

    def exact(rows, asked, k, threshold=-2.0):
        held = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and len(v) == 16 and np.isfinite(v).all() and np.any(v)}
        out = []
        for q, v in asked:
            score = {i: round(float(w @ v / np.linalg.norm(w) / np.linalg.norm(v)), 6) for i, w in held.items()}
            best = sorted(((i, s) for i, s in score.items() if s >= threshold), key=lambda x: (-x[1], x[0]))[:k]
            out += [(q, rank, i) for rank, (i, _) in enumerate(best, 1)]
        return sorted(out)

    asked = [(q, np.array(data[q][1], np.float32).astype(float)) for q in range(0, 1200, 37)]
    queries = vectors.usable(spark.createDataFrame([data[q] for q, _ in asked], schema), "key", "v")
    got = lambda **options: sorted((r.query, r["rank"], r.id) for r in vectors.search(index, queries, 10, **options).collect())
    assert got() == exact(data, asked, 10)
    assert got(threshold=0.9) == exact(data, asked, 10, 0.9)
    near = {(q, i) for q, _, i in got(probes=6)}
    wanted = {(q, i) for q, _, i in exact(data, asked, 10)}
    assert len(near & wanted) / len(wanted) >= 0.9
    untouched = {r.cell for r in index.members.select("cell").distinct().collect()}
    changes = [(3, data[40][1]), (900, [0.0] * 16), (7000, (-centres[0]).tolist())]
    index = vectors.upsert(index, spark.createDataFrame(changes, schema), "key", "v", work_path(spark, "upsert"))
    after = [(i, v) for i, v in data if i not in (3, 900)] + changes
    assert got() == exact(after, asked, 10)
    assert index.members.count() == 1202 and {r.cell for r in index.members.select("cell").distinct().collect()} <= untouched | set(range(30))
    assert vectors.search(vectors.build(table.limit(0), "key", "v", work_path(spark, "cells")), queries, 3).count() == 0


def test_substring_joins(spark, capsys):
    rng = random.Random(6)
    word = lambda most: "".join(rng.choice("abc한") for _ in range(rng.randrange(0, most)))
    texts, keywords = [word(14) for _ in range(300)] + [None], [word(6) for _ in range(120)] + [None, "a" * 9]
    met = substrings.contained(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(k,) for k in keywords], "k string"), "t", "k")
    wanted = {(t, k) for t in texts if t for k in keywords if k and k in t}
    assert sorted(map(tuple, met.collect())) == sorted(wanted)
    met.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, name string")
    registry = spark.createDataFrame([(i, k, f"p{i}") for i, k in enumerate(keywords)], "ordinal int, keyword string, parser string")
    first = {r.i: r.parser for r in joins.first_contained(rows, registry, "name", "keyword", "ordinal", "parser").collect()}
    assert first == {i: next((f"p{n}" for n, k in enumerate(keywords) if k and t and k in t), None) for i, t in enumerate(texts)}


def test_many_keywords_in_little_time(spark):
    """A hundred thousand keywords on ten thousand names: no pair is compared that shares no rare gram."""
    names = spark.range(10_000).select(F.sha1(F.col("id").cast("string")).alias("name"))
    keywords = spark.range(100_000).select(F.substring(F.sha1((F.col("id") % 20_000).cast("string")), 5, 12).alias("keyword"), F.col("id").alias("ordinal"), F.col("id").alias("value"))
    found = joins.first_contained(names, keywords, "name", "keyword", "ordinal", "value")
    assert found.where("value IS NOT NULL").count() == 10_000


def test_an_index_is_built_without_a_shuffle(spark, corpus, capsys):
    fulltext.postings(spark.createDataFrame(corpus, "bill bigint, title string, body string"), "bill", ["title", "body"]).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_an_update_shuffles_no_postings(spark, corpus, capsys, monkeypatch):
    table = spark.createDataFrame(corpus, "bill bigint, title string, body string")
    index = fulltext.build(table, "bill", ["title"], work_path(spark, "index"))
    monkeypatch.setattr(fulltext, "_written", lambda found, path: found)
    fresh = table.where("bill < 5")
    fulltext.updated(index, fresh, "bill", ["title"], "").explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out
    few = fulltext.updated(index, fresh, "bill", ["title"], "").count()
    monkeypatch.setattr(fulltext, "BROADCAST_IDS", 0)
    assert few == fulltext.updated(index, fresh, "bill", ["title"], "").count() == index.postings.count()
