"""Hard negatives of anchors: partial products of leading principal components discard rows early, integer products decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.llm.staging import staged
from civilake.llm.topk import components, products, quantised

#: Vectors in one block of the index, and in one range: what a task holds while all anchors pass by.
BLOCK, RANGE_ROWS = 4096, 1 << 17
#: Anchors in one group.
ANCHOR_GROUP = 512
PAIRS_AT_ONCE = 1 << 16
#: Shares of the components after which the partial products are bounded.
STEPS = (0.125, 0.25, 0.5)
#: A negative scores at least NUMERATOR / DENOMINATOR of its positive.
NUMERATOR, DENOMINATOR = 4, 5

ITEM = "dim int, range int, kind int, block long, label long, ids binary, labels binary, values binary, floors binary"


def narrow(values: np.ndarray) -> bytes:
    """Rows of 32 bits a component where all fit, else of 64."""
    fits = not values.size or (values.max() < 1 << 31 and values.min() >= -(1 << 31))
    return np.ascontiguousarray(values, "<i4" if fits else "<i8").tobytes()


def blocks_of(vectors: DataFrame, kind: int, most: int) -> DataFrame:
    """ITEM rows of up to ``most`` vectors of one dimension and label, from ``id, label, v``; no range yet."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 1))
            change = np.flatnonzero((dims[1:] != dims[:-1]) | (labels[1:] != labels[:-1])) + 1
            for start, end in zip(np.r_[0, change].tolist(), np.r_[change, len(dims)].tolist(), strict=True):
                for at in range(start, end, most):
                    part = batch.slice(at, min(most, end - at))
                    ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                    values = part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(ids), -1)
                    columns = [int(dims[at])], [0], [kind], [number], [int(labels[at])], [ids.tobytes()], [None], [narrow(values)], [None]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)
                    number += 1

    ranged = vectors.select("id", "label", "v", F.size("v").alias("dim")).repartitionByRange("dim", "label", "id").sortWithinPartitions("dim", "label", "id")
    return ranged.mapInArrow(build, ITEM)


NAMES = [part.split()[0] for part in ITEM.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def rotation(second: np.ndarray) -> tuple[np.ndarray, float]:
    """Orthogonal principal axes, largest first, and how far an inner product can be off in them, as a share of the vectors' lengths.

    The share covers what the computed axes lack in orthogonality and all
    roundings of turning two vectors and of summing their products.
    """
    _, axes = np.linalg.eigh(second)
    axes = np.ascontiguousarray(axes[:, ::-1])
    d = len(axes)
    lack = float(np.linalg.norm(axes @ axes.T - np.eye(d)))
    return axes, lack + (8 * d * np.sqrt(d) + 64) * 2.0**-52


def second_moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the mean outer product of its vectors, each scaled to length 1: a matrix a task and dimension, summed on the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                rows = batch.column(0).filter(pa.array(sizes == d)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1.0)  # of integers: under 1 only at zero
                total[d] = total.get(d, 0) + rows.T @ rows
        for d, matrix in total.items():
            at = np.arange(d * d)
            yield pa.record_batch([pa.array(np.full(d * d, d, np.int32)), pa.array(at), pa.array(matrix.ravel())], names=["dim", "at", "x"])

    sums = vectors.select("v").mapInArrow(count, "dim int, at long, x double").groupBy("dim", "at").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    for row in sums.collect():  # the square of each dimension, whatever the rows
        found.setdefault(row["dim"], np.zeros(row["dim"] ** 2))[row["at"]] = row["x"]
    return {d: (x + x.reshape(d, d).T.ravel()).reshape(d, d) / 2 for d, x in found.items()}


class Rotated:
    """Vectors as integers and along principal axes, with the length of what each step leaves out."""

    def __init__(self, values: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.values = values
        self.turned = values.astype(np.float64) @ axes
        self.length = np.sqrt((values.astype(np.float64) ** 2).sum(1))
        self.rest = [np.sqrt((self.turned[:, s:] ** 2).sum(1)) for s in steps]


def dots(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The inner products of pairs of rows, PAIRS_AT_ONCE at a time."""
    parts = [np.einsum("ij,ij->i", a[q[i : i + PAIRS_AT_ONCE]], b[r[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(q), PAIRS_AT_ONCE)]
    return np.concatenate([np.zeros(0, a.dtype), *parts])


def candidates(queries: Rotated, rows: Rotated, steps: list[int], share: float, wanted: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, row) of ``wanted`` that may score from ``least`` to ``most`` and be among a query's ``k`` best of those.

    After each step the products of the leading components are known; what is
    left is at most the product of both rests, and roundings are within ``share`` of
    both lengths. ``most`` is infinite where scores have no upper limit; only then
    a query's k-th best lower bound raises ``least``, since each such row counts.
    """
    ends = [*steps, queries.turned.shape[1]]
    pairs = None
    for step, end in enumerate(ends):
        start = ends[step - 1] if step else 0
        if pairs is None:
            partial = queries.turned[:, :end] @ rows.turned[:, :end].T
            rest = np.outer(queries.rest[0], rows.rest[0]) if steps else 0.0
            slack = rest + share * np.outer(queries.length, rows.length) * 1.01
            low = np.where(wanted, partial - slack, -np.inf)
            if low.shape[1] >= k:
                kth = np.partition(low, -k, axis=1)[:, -k]
                least = np.maximum(least, np.where(np.isinf(most), kth, -np.inf))
            pairs = np.nonzero(wanted & (partial + slack >= least[:, None]) & (partial - slack <= most[:, None]))
            partial = partial[pairs]
            continue
        q, r = pairs
        if not len(q):
            break
        partial = partial + dots(queries.turned[:, start:end], rows.turned[:, start:end], q, r)
        rest = queries.rest[step][q] * rows.rest[step][r] if step < len(steps) else 0.0
        slack = rest + share * queries.length[q] * rows.length[r] * 1.01
        low = np.where(np.isinf(most[q]), partial - slack, -np.inf)
        top = best_of(q, r, low, k)  # with each step the lower bounds rise, and so may what must be reached
        whole = np.bincount(q[top], minlength=len(least)) == k
        kth = np.full(len(least), np.inf)
        np.minimum.at(kth, q[top], low[top])
        least = np.where(whole, np.maximum(least, kth), least)
        keep = (partial + slack >= least[q]) & (partial - slack <= most[q])
        pairs, partial = (q[keep], r[keep]), partial[keep]
    return pairs


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The integer inner products of pairs of rows; one beyond 64 bits is an error, as in the query's SQL."""
    if not len(q):
        return np.zeros(0, np.int64)
    length = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, rows))
    if length * length * queries.shape[1] < float(1 << 62):
        return dots(queries.astype(np.int64), rows.astype(np.int64), q, r)
    return np.concatenate([products(queries[q[i] : q[i] + 1], rows[r[i] : r[i] + 1])[0] for i in range(len(q))])


def best_of(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each key's ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, keys))
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    rank = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
    return order[rank < k]


def scan(items: DataFrame, axes: dict[int, tuple[np.ndarray, float]], k: int, positives: bool) -> DataFrame:
    """``anchor_id, floor, id, score``: of each range, the rows that may be among an anchor's ``k`` best.

    A task reads a range's blocks first and keeps them; the groups of anchors that
    follow pass by one at a time. ``floor`` is null for positives (same label);
    for negatives (other labels) it is the positive's score that they are for.
    """
    schema = "anchor_id long, floor long, id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                item = batch.slice(i, 1).to_pylist()[0]
                if at != (item["dim"], item["range"]):
                    held, at = [], (item["dim"], item["range"])
                dim = item["dim"]
                turn, share = axes[dim]
                steps = sorted({s for s in (int(dim * x) for x in STEPS) if 0 < s < dim})
                ids = np.frombuffer(item["ids"], "<i8")
                vectors = Rotated(components(item["values"], len(ids), dim), turn, steps)
                if item["kind"] == 0:
                    held.append((ids, item["label"], vectors))
                    continue
                labels = np.frombuffer(item["labels"], "<i8")
                best = GroupBest(ids, k) if positives else GroupBest(ids, k, np.frombuffer(item["floors"], "<i8").reshape(len(ids), -1))
                for row_ids, label, rows in held:
                    part = np.flatnonzero((labels == label) == positives)
                    if len(part):
                        best.meet(part, vectors, row_ids, rows, steps, share)
                yield best.batch()

    return items.repartition("dim", "range").sortWithinPartitions("dim", "range", "kind").mapInArrow(run, schema)


#: Marks places without a positive.
NONE = -(1 << 63)


class GroupBest:
    """The best rows so far of a group of anchors: for each anchor, or for each of its positives' scores (``floors``, NONE where there are fewer)."""

    def __init__(self, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.k, self.floors = ids, k, floors
        self.keys, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        if floors is None:
            self.least, self.most = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
        else:
            self.low = np.array([[-((-NUMERATOR * f) // DENOMINATOR) for f in row] for row in floors.tolist()], np.int64).reshape(floors.shape)
            there = floors != NONE
            as_float = lambda x, none: np.where(there, np.where(there, x, 0).astype(np.float64), none)
            # As doubles these may round, so the range is wider by more than that.
            low, high = as_float(self.low, np.inf).min(1, initial=np.inf), as_float(floors, -np.inf).max(1, initial=-np.inf)
            self.least, self.most = low - np.abs(low) * 2.0**-50, high + np.abs(high) * 2.0**-50

    def meet(self, part: np.ndarray, anchors: Rotated, row_ids: np.ndarray, rows: Rotated, steps: list[int], share: float) -> None:
        """Add what a block has for the anchors at ``part``."""
        some = object.__new__(Rotated)
        some.values, some.turned, some.length = anchors.values[part], anchors.turned[part], anchors.length[part]
        some.rest = [x[part] for x in anchors.rest]
        wanted = self.ids[part, None] != row_ids[None, :]
        q, r = candidates(some, rows, steps, share, wanted, self.least[part], self.most[part], self.k)
        scores = exact(some.values, rows.values, q, r)
        q, found = part[q], row_ids[r]
        if self.floors is None:
            keys = q
        else:
            width = self.floors.shape[1]
            limit, low = self.floors[q], self.low[q]
            fits = (limit != NONE) & (scores[:, None] <= limit) & (low <= scores[:, None])
            pair, place = np.nonzero(fits)
            keys, found, scores = q[pair] * width + place, found[pair], scores[pair]
        keys, found, scores = np.r_[self.keys, keys], np.r_[self.found, found], np.r_[self.scores, scores]
        kept = best_of(keys, found, scores, self.k)
        self.keys, self.found, self.scores = keys[kept], found[kept], scores[kept]
        if self.floors is None:
            last = np.bincount(self.keys, minlength=len(self.ids)) == self.k
            kth = np.full(len(self.ids), np.inf)
            np.minimum.at(kth, self.keys, self.scores.astype(np.float64))
            kth = np.where(last, kth, 0)
            self.least = np.where(last, np.maximum(self.least, kth - np.abs(kth) * 2.0**-50), self.least)

    def batch(self) -> pa.RecordBatch:
        if self.floors is None:
            anchors, floors = self.ids[self.keys], pa.nulls(len(self.keys), pa.int64())
        else:
            anchors, floors = self.ids[self.keys // self.floors.shape[1]], pa.array(self.floors.ravel()[self.keys])
        return pa.record_batch([pa.array(anchors), floors, pa.array(self.found), pa.array(self.scores)], names=["anchor_id", "floor", "id", "score"])


def grouped(anchors: DataFrame, groups: int) -> DataFrame:
    """ITEM rows of groups of anchors (``id, label, v, floors``) of one dimension, dealt by hash; no range yet."""

    def pack(key, rows):
        ids, labels = (rows[c].to_numpy().astype("<i8") for c in ("id", "label"))
        values = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(ids), -1)
        floors = rows["floors"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        columns = [key[0].as_py()], [0], [1], [key[1].as_py()], [None], [ids.tobytes()], [labels.tobytes()], [narrow(values)], [floors.tobytes()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)

    dealt = anchors.withColumn("dim", F.size("v")).withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)))
    return dealt.select("dim", "grp", "id", "label", "v", "floors").groupBy("dim", "grp").applyInArrow(pack, ITEM)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, range_rows: int = RANGE_ROWS, anchor_group: int = ANCHOR_GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and positive, its best negatives.

    ``vectors`` has ``id long, label long, v array<bigint>``. An anchor's positives
    are its highest-scoring other rows of its label, its negatives for a positive
    the highest-scoring rows of other labels that score at most the positive's
    score and at least NUMERATOR / DENOMINATOR of it. Scores are integer inner
    products, ties go to the smaller id. Rows with a null id or label, or a null
    or empty vector, take no part; vectors of different dimensions have no product,
    so each dimension stands alone. Of rows repeated with an anchor's id the one
    of the smallest label and vector is the anchor, none of them is its positive
    or negative; other repeated rows count once each. Fewer rows than asked for
    give fewer; an empty table gives none.

    The principal axes come from all vectors (a matrix of moments a task). All
    blocks of a range lie in one task, and the anchors, in groups, stream past it;
    so an anchor is sent once a range, and a vector once. A hot label is
    many blocks like any other.
    """
    usable = vectors.where("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").select("id", F.col("label").cast("bigint").alias("label"), F.col("v").cast("array<bigint>").alias("v"), is_anchor.alias("anchor"))
    usable = staged(usable, "negatives-vectors")
    axes = {d: rotation(m) for d, m in second_moments(usable).items()}
    n = usable.count()
    ranges = max(1, -(-n // range_rows), min(-(-n // BLOCK), usable.sparkSession.sparkContext.defaultParallelism))  # a task for each core, of whole blocks
    index = blocks_of(usable, 0, BLOCK).withColumn("range", F.pmod(F.xxhash64("block"), F.lit(ranges)).cast("int"))
    index = staged(index, "negatives-index")

    first = Window.partitionBy("id").orderBy("label", "v")
    anchors = usable.where("anchor").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place", "anchor")
    anchors = staged(anchors, "negatives-anchors")
    groups = max(1, -(-anchors.count() // anchor_group))

    def met(asked: DataFrame, k: int, same: bool) -> DataFrame:
        everywhere = grouped(asked, groups).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
        return scan(index.unionByName(everywhere), axes, k, same)

    nothing = F.array().cast("array<bigint>")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id", "copy")
    near = met(anchors.withColumn("floors", nothing), positives, True).withColumn("copy", F.monotonically_increasing_id())
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = staged(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "negatives-positives")

    scores = near.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("s"))  # at most ``positives`` of an anchor
    full = F.concat("s", F.array_repeat(F.lit(NONE), F.lit(positives) - F.size("s")))
    asked = anchors.join(scores.withColumnRenamed("anchor_id", "id"), "id").withColumn("floors", full).drop("s")
    far = met(asked, negatives, False).withColumn("copy", F.monotonically_increasing_id())
    rank = Window.partitionBy("anchor_id", "floor").orderBy(F.desc("score"), "id", "copy")
    far = far.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
    far = far.select("anchor_id", F.col("floor").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(embeddings: DataFrame) -> DataFrame:
    """The rows of query ``op11_hard_negatives``."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    vectors = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), label.alias("label"), quantised(F.col("embedding")).alias("v"))
    return hard_negatives(vectors, F.col("id") % 100 == 0)
