"""Periodic runs against a loop over all stretches, and the query against a plain version of its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from civilake.llm import queries, runs
from tests.llm.conftest import AWKWARD


def plain_runs(words, least_length=6, least_exponent=4):
    """For every period, the maximal stretches that keep it; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_length, least_exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    rest = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], digest, rest)


@given(st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=400, deadline=None)
def test_runs_equal_a_plain_loop(words):
    assert runs.maximal_runs(np.array(words, np.int64)) == plain_runs(words)
    text = " ".join("abc"[w] for w in words).encode()
    assert runs.runs_of_texts([b"", text, b"x"])[1][1] == plain_runs(words)


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_of_repeated_units(units):
    words = [w for unit, times in units for w in unit * times]
    assert runs.maximal_runs(np.array(words, np.int64)) == plain_runs(words)
    text = " ".join("abcd"[w] for w in words).encode()
    assert runs.runs_of_texts([text])[0][1] == plain_runs(words)


def test_suffix_tree_depths():
    rng = random.Random(3)
    for n in (1, 2, 9, 200):
        words = [rng.randrange(3) for _ in range(n)]
        leaves, place, depth = runs.suffix_tree(np.array(words))
        assert leaves.tolist() == sorted(range(n), key=lambda i: words[i:])
        assert place[leaves].tolist() == list(range(n))
        for i in range(1, n):
            a, b = words[leaves[i - 1] :], words[leaves[i] :]
            assert depth[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_long_periodic_texts():
    """Work follows the length: one word, and a unit of 777, over a million words."""
    assert runs.maximal_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    unit = np.random.default_rng(1).integers(0, 1000, 777)
    words = np.r_[-2, np.tile(unit, 400), -3]
    assert runs.maximal_runs(words) == [(1, 777 * 400, 777)]


def test_query_equals_a_plain_version(spark, awkward, empty):
    rows = [(i, t) for i, t in AWKWARD if t is None or len(t) < 10_000]
    rng = random.Random(5)
    rows += [(100 + i, " ".join(rng.choice("abcdef") + rng.choice(["", " x"]) for _ in range(rng.randrange(1, 150)))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, best int")
    out = runs.op13(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted((plain_row(i, t) for i, t in rows), key=key)
    assert any(r.n_runs for r in out.collect())
    assert runs.op13(empty).count() == 0
    assert queries.QUERIES["op13_runs"]


def test_operator_keeps_columns(spark):
    docs = spark.createDataFrame([("k", "say " + "na " * 8 + "hey", None)], "body string, text string, words string")
    row = runs.periodic_runs(docs, docs.text).first()
    assert (row.body, row.words, row.collapsed) == ("k", None, "say na hey")
    assert [tuple(r) for r in row.runs] == [(1, 8, 1)]
