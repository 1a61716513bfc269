"""Exact top-k inner product search by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilake.llm.sampling import few
from civilake.llm.staging import staged

#: Vectors in one block: one row of the index, with its own maxima and forward index.
BLOCK = 256
#: Consecutive blocks whose bounds, or scores, one task takes for one group of queries.
BLOCKS_PER_RANGE = 64
#: Queries in one group.
QUERY_GROUP = 512
#: Blocks of best summed bound that a group of queries is scored against first, to find k-th scores.
FIRST_BLOCKS = 2
#: Below any score; its negative still fits in 64 bits.
NO_SCORE = -(1 << 63) + 1
#: Integers up to here are exact as doubles.
EXACT = float(1 << 53)

INDEX = "dim int, block long, ids binary, values binary, top array<bigint>, low array<bigint>"


def quantised(vector: Column, scale: int = 256) -> Column:
    """Each component as floor(scale * x), or null if the vector or any component is null or not finite.

    A finite component that does not fit in 64 bits after scaling is an error, as in the query's SQL.
    """
    scaled = lambda x: x.cast("double") * scale
    usable = vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    wide = F.raise_error(F.lit("a component does not fit in 64 bits after scaling")).cast("bigint")
    return F.when(usable, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < float(1 << 63), F.floor(scaled(x)).cast("bigint")).otherwise(wide)))


def block_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """INDEX rows over ``id long, v array<bigint>``: consecutive id ranges of about ``block`` vectors of one dimension.

    ``values`` is the block's forward index, one row of components for each id,
    of 32 bits where all of the block fit and else of 64; ``top`` and ``low`` are its largest and smallest value of each component
    (the term maxima of the positive and the negative side).
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]]).tolist() if len(dims) else []
            for start, end in zip(starts, [*starts[1:], len(dims)], strict=True):
                for at in range(start, end, block):
                    part = batch.slice(at, min(block, end - at))
                    ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                    values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(ids), -1)
                    top, low = values.max(0), values.min(0)
                    narrow = top.max() < 1 << 31 and low.min() >= -(1 << 31)
                    yield pa.record_batch(
                        [pa.array([int(dims[at])], pa.int32()), pa.array([number]), pa.array([ids.tobytes()], pa.binary()),
                         pa.array([values.astype("<i4" if narrow else "<i8").tobytes()], pa.binary()),
                         pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))],
                        names=["dim", "block", "ids", "values", "top", "low"],
                    )
                    number += 1

    ranged = vectors.select("id", "v", F.size("v").alias("dim")).repartitionByRange("dim", "id").sortWithinPartitions("dim", "id")
    return ranged.mapInArrow(build, INDEX)


def components(data: bytes, rows: int, dim: int) -> np.ndarray:
    """Rows of 32 or 64 bits a component, as ``block_index`` writes them."""
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * dim else "<i8").reshape(rows, dim)


def bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No vector of a block scores over this: each query component times the block's extreme of its sign, summed.

    Where doubles may round, the bound is widened by more than all roundings together.
    """
    q, top, low = (x.astype(np.float64) for x in (queries, top, low))
    reach = np.abs(q) @ np.maximum(np.abs(top), np.abs(low)).T
    slack = np.where(reach < EXACT / 2, 0, reach * (q.shape[1] + 4) * 2.0**-50)
    return np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T + slack


def products(queries: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows; one beyond 64 bits is an error, as in the query's SQL."""
    q, v = queries.astype(np.float64), values.astype(np.float64)
    reach = float((np.abs(q) @ np.abs(v).max(0)).max())  # no sum of products nor any part of one is larger
    if reach < EXACT / 2:
        return (q @ v.T).astype(np.int64)
    if reach < float(1 << 62):
        return queries.astype(np.int64) @ values.astype(np.int64).T
    found = queries.astype(object) @ values.astype(object).T
    if max(found.max(), -found.min()) >= -NO_SCORE:
        raise OverflowError("an inner product does not fit in 64 bits")
    return found.astype(np.int64)


class Best:
    """The k best (score, id) of each of a group's queries so far; ties go to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int, kth: np.ndarray):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), NO_SCORE)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.given = kth

    def kth(self) -> np.ndarray:
        """What a block's bound must reach for it to matter: a tie may still win by its id."""
        return np.maximum(self.scores[:, -1], self.given)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.query_ids[rows, None], NO_SCORE, scores)
        all_scores = np.hstack([self.scores[rows], scores])
        all_ids = np.hstack([self.ids[rows], np.broadcast_to(ids, scores.shape)])
        if all_scores.shape[1] > 4 * self.k:
            cut = np.partition(all_scores, -self.k, axis=1)[:, -self.k]
            width = int((all_scores >= cut[:, None]).sum(1).max())
            part = np.argpartition(-all_scores, min(width, all_scores.shape[1]) - 1, axis=1)[:, :width]
            all_scores, all_ids = np.take_along_axis(all_scores, part, 1), np.take_along_axis(all_ids, part, 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


def search_blocks(query_ids, queries, kth, blocks: list[tuple[np.ndarray, np.ndarray]], top, low, k: int) -> Best:
    """Score blocks in order of falling bound, for each query until the bound is below its k-th score."""
    best = Best(query_ids, k, kth)
    bound = bounds(queries, top, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(query_ids))
    for step in range(len(blocks)):
        turn = order[live, step]
        live = live[bound[live, turn] >= best.kth()[live]]
        if not len(live):
            break
        turn = order[live, step]
        for b in np.unique(turn):
            rows = live[turn == b]
            ids, values = blocks[b]
            best.take(rows, ids, products(queries[rows], values))
    return best


def group_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's query ids, vectors and k-th scores known so far."""
    ids = np.frombuffer(table["query_ids"][0].as_py(), "<i8")
    queries = components(table["queries"][0].as_py(), len(ids), table["dim"][0].as_py())
    known = {row["query_id"]: row["score"] for row in table["known"][0].as_py() or ()}
    return ids, queries, np.array([known.get(i, NO_SCORE) for i in ids.tolist()], np.int64)


def bounded(index: DataFrame, groups: DataFrame, first: bool) -> DataFrame:
    """``dim, grp, block, reach``: the blocks a group has to meet, told by their term maxima alone.

    With ``first``, of each range the block of the largest bound summed over the
    group's queries; else all whose bound reaches some query's k-th score. Only
    term maxima and queries are shuffled: a hundredth of the vectors for each group.
    """

    def run(key, left, right):
        _, queries, kth = group_of(right)
        reach = bounds(queries, np.array(left["top"].to_pylist()), np.array(left["low"].to_pylist()))
        total = reach.sum(0)
        wanted = np.array([int(total.argmax())]) if first else np.flatnonzero((reach >= kth[:, None]).any(0))
        own = [pa.array(np.full(len(wanted), right[name][0].as_py(), np.int32)) for name in ("dim", "grp")]
        return pa.table([*own, left["block"].take(pa.array(wanted)), total[wanted]], names=["dim", "grp", "block", "reach"])

    # One short row for each group and each range: thousandths of the vectors, and broadcast only while they are few.
    met = few(groups.select(F.col("dim").alias("__dim"), F.col("grp").alias("__grp")))
    meets = few(index.select(F.col("dim").alias("__dim"), F.col("range").alias("__range")).distinct())
    left = index.select("dim", "range", "block", "top", "low").join(met, F.col("dim") == F.col("__dim")).drop("__dim")
    right = groups.join(meets, F.col("dim") == F.col("__dim")).drop("__dim")
    return left.groupBy("dim", "range", "__grp").cogroup(right.groupBy("dim", "__range", "grp")).applyInArrow(run, "dim int, grp int, block long, reach double")


def scored(index: DataFrame, groups: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Each query's k best in the blocks its group is paired with: ``dim, grp, query_id, vec_id, score``, a task for each group and range."""
    schema = pa.schema([("dim", pa.int32()), ("grp", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, left, right):
        blocks, dim = [], right["dim"][0].as_py()
        for ids, values in zip(left["ids"].to_pylist(), left["values"].to_pylist(), strict=True):
            ids = np.frombuffer(ids, "<i8")
            blocks.append((ids, components(values, len(ids), dim)))
        query_ids, queries, kth = group_of(right)
        best = search_blocks(query_ids, queries, kth, blocks, np.array(left["top"].to_pylist()), np.array(left["low"].to_pylist()), k)
        row, column = np.nonzero(best.scores > NO_SCORE)
        own = [np.full(len(row), right[name][0].as_py(), np.int32) for name in ("dim", "grp")]
        return pa.table([*own, best.query_ids[row], best.ids[row, column], best.scores[row, column]], schema=schema)

    left = index.join(pairs.select("dim", "block", "grp"), ["dim", "block"])
    right = groups.join(pairs.select("dim", "grp", F.expr(f"block div {BLOCKS_PER_RANGE}").alias("range")).distinct(), ["dim", "grp"])
    return left.groupBy("dim", "grp", "range").cogroup(right.groupBy("dim", "grp", "range")).applyInArrow(run, "dim int, grp int, query_id long, vec_id long, score long")


def top_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked from 1."""
    order = Window.partitionBy("dim", "grp", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, query_group: int = QUERY_GROUP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query with all other vectors.

    ``vectors`` has ``id long`` and ``v``, an array of integers. Rows with a null
    id or ``v`` or an empty ``v`` take no part; vectors of different dimensions
    have no product, so each dimension is searched on its own. Ties
    go to the smaller id; fewer than k candidates give fewer rows, an empty table
    none. Rows repeated with one id are one query and each a candidate of others,
    but never of their own id.

    Blocks of consecutive ids are ordered by the sum of their term maxima. A
    group of queries first scores the few blocks of best bound, which gives its
    queries a k-th score; then only blocks whose bound reaches one of those scores
    are sent to the group and scored in order of bound, each query stopping where
    the bound falls below its k-th score.
    """
    usable = vectors.where("id IS NOT NULL AND size(v) > 0").withColumn("v", F.col("v").cast("array<bigint>"))
    index = staged(block_index(usable, block), "topk-index").withColumn("range", F.expr(f"block div {BLOCKS_PER_RANGE}"))

    asked = usable.where(is_query).dropDuplicates(["id"]).select("id", "v", F.size("v").alias("dim"))
    sizes = asked.groupBy("dim").agg(F.count("*").alias("n"))

    def group(key, rows):
        ids = rows["id"].to_numpy().astype("<i8")
        values = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        values = values.astype("<i4") if len(values) and values.max() < 1 << 31 and values.min() >= -(1 << 31) else values
        own = [pa.array([k.as_py()], pa.int32()) for k in key]
        return pa.table([*own, pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dim", "grp", "query_ids", "queries"])

    dealt = asked.join(F.broadcast(sizes), "dim").withColumn("grp", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / query_group)).cast("int"))  # a row for each dimension
    groups = dealt.select("dim", "grp", "id", "v").groupBy("dim", "grp").applyInArrow(group, "dim int, grp int, query_ids binary, queries binary")
    unknown = F.lit(None).cast("array<struct<query_id:bigint,score:bigint>>")
    groups = staged(groups.withColumn("known", unknown), "topk-queries")

    nearest = Window.partitionBy("dim", "grp").orderBy(F.desc("reach"), "block")
    seeds = staged(bounded(index, groups, True).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= FIRST_BLOCKS), "topk-seeds")
    first = top_of(scored(index, groups, seeds, k), k).where(F.col("rank") == k)
    known = first.groupBy("dim", "grp").agg(F.collect_list(F.struct("query_id", "score")).alias("known"))  # at most a group's queries
    groups = staged(groups.drop("known").join(known, ["dim", "grp"], "left"), "topk-known")
    pairs = staged(bounded(index, groups, False), "topk-pairs")
    return top_of(scored(index, groups, pairs, k), k).select("query_id", "rank", "vec_id", "score")


def op10(embeddings: DataFrame) -> DataFrame:
    """The rows of query ``op10_top_k``."""
    vectors = embeddings.select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("id") % 50 == 0)
