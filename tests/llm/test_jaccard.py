"""The Jaccard join against a loop over all pairs, and its signatures by property."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from civilake.llm import jaccard
from tests.llm.conftest import AWKWARD, sentence


def plain(rows, words=5, percent=80):
    """``id, n, component`` of each row: sets of word sequences, all pairs, a walk over the links."""
    sets = []
    for _, text in rows:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), doc_id) if x is not None), default=None)
    return sorted(((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows))), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, num string, n int, root int")


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + rng.randrange(0, 2)] = [f"w{rng.randrange(10**6)}"]
    return " ".join(w)


def collection(seed):
    """Near copies of many bases, a large group that drifts, shared passages, copies, short texts."""
    rng, rows = random.Random(seed), []
    passage = sentence(9, 80)
    for b in range(30):
        base = sentence(100 + b, rng.randrange(6, 150))
        for _ in range(rng.randrange(1, 6)):
            rows.append(edited(rng, base, rng.randrange(0, 6)))
    drift = sentence(77, 160)
    for i in range(120):
        rows.append(drift if i % 5 == 0 else edited(rng, drift, rng.randrange(0, 3)))
        drift = edited(rng, drift, 1)
    rows += [f"{passage} {sentence(500 + i, rng.randrange(4, 60))}" for i in range(60)]
    rows += [f"a b c d e {x}" for x in "fghf"] + ["A b C", "a B c", "c b a", "one", "ONE", "one one"]
    rng.shuffle(rows)
    return [(10 + i, t) for i, t in enumerate(rows)]


def test_equals_all_pairs(spark, empty):
    rows = collection(1) + [(i, t) for i, t in AWKWARD if t is None or len(t) < 10_000] + [(11, None), (None, "one")]
    found = jaccard.op12(table(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)
    assert jaccard.op12(empty).count() == 0


def test_other_words_and_thresholds(spark):
    rows = collection(2)[:200]
    for words, percent in ((1, 50), (2, 60), (3, 95), (2, 100)):
        found = jaccard.similar_documents(table(spark, rows), words=words, numerator=percent, denominator=100)
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, words, percent), (words, percent)


def test_long_texts(spark):
    """Whole texts decide: these differ only far from their beginning."""
    base = sentence(1, 20_000)
    rows = [(1, base), (2, base + " " + sentence(2, 3_000)), (3, sentence(3, 20_000)), (4, edited(random.Random(1), base, 300))]
    found = jaccard.op12(table(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([50, 80, 90]))
@settings(max_examples=200, deadline=None)
def test_linked_sets_share_a_signature(n, seed, percent):
    """Whatever the rarity of tokens, and with as many differences as a link allows."""
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 1 << 62, n).astype(np.uint64)
    lost = rng.integers(0, jaccard.missing(n, percent, 100) + 1)
    y = x[rng.permutation(n)[lost:]]
    most = (100 * len(y) - percent * n) // percent  # more tokens that the union can take
    y = np.r_[y, rng.integers(1 << 62, 1 << 63, rng.integers(0, max(0, most) + 1)).astype(np.uint64)]
    assert jaccard.links(n - lost, n, len(y), percent, 100)
    both = np.unique(np.r_[x, y])
    rank = jaccard.rarity(np.exp2(rng.uniform(1, rng.uniform(1, 14), len(both))).astype(int))
    only = ~(np.isin(both, x) & np.isin(both, y))
    rank[only & (rng.random(len(both)) < 0.5)] = 0
    of = lambda s: jaccard.signatures(np.sort(s), rank[np.searchsorted(both, np.sort(s))], percent, 100)
    assert len(np.intersect1d(of(x), of(y)))


def test_forest_over_sides():
    """Every side against every other connects what all pairs connect."""
    rng = random.Random(3)
    base = list(range(100))
    sets = [np.array(sorted({*rng.sample(base, 93), *(rng.randrange(1000, 1060) for _ in range(rng.randrange(0, 9)))}), np.uint64) for _ in range(40)]
    nums = np.arange(40)
    whole = jaccard.forest(nums, sets, np.ones(40, bool), np.zeros(40, bool))
    parts = []
    for i in (0, 1):
        for j in (0, 1):
            at = (nums % 2 == i) | (nums % 2 == j)
            parts += jaccard.forest(nums[at], [sets[k] for k in nums[at]], (nums % 2 == i)[at], np.zeros(at.sum(), bool))

    def classes(edges):
        group = list(range(40))
        for a, b in edges:
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
        return sorted(sorted(i for i in range(40) if group[i] == g) for g in set(group))

    assert classes(parts) == classes(whole)
