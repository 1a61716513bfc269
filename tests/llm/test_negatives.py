"""Hard negatives against a plain loop over all pairs."""

import math
import random

import numpy as np
import pytest

from civilake.llm import negatives


def plain(rows, anchor_every=100, k=5):
    """The contract of ``op11_hard_negatives`` over ``(vec_id, embedding, label)``, in Python integers; rows that repeat an id stand in order of label and vector."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    anchors, out = {}, []
    for row in sorted(kept):
        if row[0] % anchor_every == 0:
            anchors.setdefault(row[0], row)
    for i, label, v in anchors.values():
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in kept if j != i and len(w) == len(v)]
        for ps, p in sorted((s, j) for s, j, other in scored if other == label)[:k]:
            fitting = sorted((s, j) for s, j, other in scored if other != label and 80 * -ps <= 100 * -s <= 100 * -ps)[:k]
            out += [(i, p, rank, j, -ps, -s) for rank, (s, j) in enumerate(fitting, 1)]
    return sorted(out)


def rows_of(spark, rows):
    data = [(i, v, label, "x", 1) for i, v, label in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, dim string, range int")


def test_equals_a_plain_loop(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(900):
        c = rng.choice(centres)
        rows.append((i, [x / 3 + rng.gauss(0, 0.2) for x in c], rng.randrange(10)))
    rows += [(1000 + i, rows[3][1], 4) for i in range(60)]  # a common vector: ties
    rows += [(200, rows[5][1], 2), (200, rows[5][1], 2), (301, rows[5][1], 2), (301, rows[5][1], 2)]  # repeated ids and rows
    rows += [(None, rows[1][1], 1), (1100, None, 1), (1200, [1.0, None], 1), (1300, [float("nan"), 1.0], 1), (1400, [float("inf")], 1), (1500, [0.1] * 12, None), (1600, [], 3)]
    rows += [(1700, [1.0, 2.0], 0), (1701, [1.0, 1.9], 0), (1702, [1.0, 1.8], 1)]  # another dimension
    rows += [(1800, [0.0] * 12, 5)]  # every score is zero
    found = negatives.op11(rows_of(spark, rows))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows)


def test_several_ranges_and_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=9) * np.linspace(1, 0.05, 9)).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    table = rows_of(spark, rows)
    from civilake.llm.topk import quantised

    label = table.label.cast("long")
    vectors = table.select(table.vec_id.alias("id"), label.alias("label"), quantised(table.embedding).alias("v"))
    found = negatives.hard_negatives(vectors, vectors.id % 7 == 3, range_rows=90, anchor_group=16)
    whole = negatives.hard_negatives(vectors, vectors.id % 7 == 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert found.count() > 1000


def test_large_components_are_exact(spark):
    """Scores beyond what doubles hold; one beyond 64 bits is an error."""
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-(1 << 22), 1 << 22) + rng.random() for _ in range(3)], i % 2) for i in range(0, 400, 4)]
    assert sorted(tuple(r) for r in negatives.op11(rows_of(spark, rows)).collect()) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        negatives.op11(rows_of(spark, [(0, [1e15, 1e15], 1), (1, [1e15, 1e15], 1), (2, [1e15, 1.0], 2)])).collect()


def test_empty(spark):
    assert negatives.op11(rows_of(spark, [])).count() == 0
    assert negatives.op11(rows_of(spark, [(100, [1.0], 1)])).count() == 0


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(5)
    values = (rng.normal(size=(3000, 16)) * np.geomspace(100, 1, 16)).astype(np.int64)
    axes, share = negatives.rotation(values.T.astype(float) @ values)
    steps = [2, 4, 8]
    queries, rows = negatives.Rotated(values[:50], axes, steps), negatives.Rotated(values, axes, steps)
    least, most = np.full(50, -np.inf), np.full(50, np.inf)
    q, r = negatives.candidates(queries, rows, steps, share, np.ones((50, 3000), bool), least, most, 5)
    scores = values[:50] @ values.T
    kth = np.sort(scores, axis=1)[:, -5]
    kept = np.zeros(scores.shape, bool)
    kept[q, r] = True
    assert kept[scores >= kth[:, None]].all()
    assert kept.mean() < 0.05
