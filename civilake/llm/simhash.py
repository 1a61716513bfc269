"""SimHash near-duplicates: fingerprints, and all links within a Hamming radius by generalised pigeonhole."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilake.llm.components import connected
from civilake.llm.sampling import few
from civilake.llm.staging import staged

BITS = 64
#: Numbers of partitions that the planner compares.
PARTITION_COUNTS = (2, 3, 4, 5)
#: What one shuffled signature costs, in verified candidate pairs: about 3.5 microseconds a row
#: (made, shuffled, sorted, read) against 8 nanoseconds a comparison, as measured.
ROW_COST = 400.0
#: A bucket of more rows is dealt anew by further bits; what is still larger, by pairs of blocks in separate tasks.
BUCKET_ROWS = 50_000
#: Buckets up to this size are compared pair by pair, all buckets at once.
SMALL_BUCKET = 32
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 if it has no word.

    A-Z are lower-cased; words end at ASCII white space; a shingle is its words
    joined by one space, hashed by XXH64 over UTF-8. Fewer words than a shingle
    make one shingle of them all. A bit is set if it is set in over half of the hashes.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    k = min(words_per_shingle, len(words))
    hash_one = xxhash.xxh64_intdigest
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashes = np.fromiter((hash_one(line[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """``id, fp``: every row's fingerprint as a signed long. Whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, "id long, fp long")


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint as one small number, the first named lowest."""
    out = np.zeros(len(fps), np.uint64)
    for at, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
    return out


def bit_correlations(fps: DataFrame) -> np.ndarray:
    """|phi| of every pair of bits over all fingerprints: 64 x 64 counts leave each task, and their sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            at = np.arange(BITS * BITS + 1)
            yield pa.record_batch([pa.array(at), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["at", "n"])

    found = fps.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    values = np.zeros(BITS * BITS + 1)
    for at, n in found.collect():  # 4,097 rows whatever the input
        values[at] = n
    n = max(values[-1], 1)
    both = values[:-1].reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.where(spread > 0, np.abs(both - np.outer(p, p)) / spread, 1.0)
    return phi


def correlated_groups(phi: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, as even as can be: each takes the free bit most correlated with what it holds."""
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [max(sorted(free), key=lambda b: phi[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: phi[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def collisions(fps: DataFrame, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], int]:
    """For each plan and partition, the ordered pairs of fingerprints that agree on all its bits, counted over all of them."""
    parts = [(m, i, bits) for m, groups in plans.items() for i, bits in enumerate(groups)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for number, (_, _, bits) in enumerate(parts):
                code = gather(values, bits) | np.uint64(number << 40)
                yield pa.record_batch([pa.array(code.view(np.int64))], names=["code"])

    counts = fps.select("fp").mapInArrow(keys, "code long").groupBy("code").agg(F.count("*").alias("n"))
    sums = counts.groupBy(F.shiftright("code", 40).alias("part")).agg(F.sum(F.col("n") * F.col("n") - F.col("n")).alias("pairs"))
    found = {row["part"]: row["pairs"] for row in sums.collect()}  # a row for each partition of each plan
    return {(m, i): found.get(number, 0) for number, (m, i, _) in enumerate(parts)}


def thresholds(n: int, widths: list[int], pairs: list[int], radius: int) -> tuple[float, list[int]]:
    """Per-partition thresholds that sum to ``radius - m + 1``, of least estimated cost, by dynamic programming.

    A partition at -1 is not probed. At t it costs its signatures (all keys
    within t bits, half of them by symmetry) and its candidates, estimated from
    the counted exact collisions times the number of keys within reach.
    """
    m, total = len(widths), radius - len(widths) + 1

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        reach = sum(comb(widths[i], k) for k in range(t + 1))
        background = n * n * reach / 2.0 ** widths[i]
        return ROW_COST * n * (1 + (reach - 1) / 2) + max(pairs[i] * (1 + t), 0) + background

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for got, (spent, chosen) in best.items():
            for t in range(-1, radius + 1):
                if comb(widths[i], max(t, 0)) > 1 << 16:
                    break
                now = (spent + cost(i, t), [*chosen, t])
                if got + t not in step or now < step[got + t]:
                    step[got + t] = now
        best = step
    return best[total]


def plan(fps: DataFrame, n: int, radius: int) -> list[tuple[list[int], int]]:
    """The partitions (bits, threshold) to probe, chosen from statistics over all fingerprints."""
    phi = bit_correlations(fps)
    plans = {m: correlated_groups(phi, m) for m in PARTITION_COUNTS if m <= radius + 1}
    pairs = collisions(fps, plans)
    costs = {
        m: thresholds(n, [len(g) for g in groups], [pairs[m, i] for i in range(m)], radius) for m, groups in plans.items()
    }
    m = min(costs, key=lambda k: costs[k][0])
    return [(bits, t) for bits, t in zip(plans[m], costs[m][1], strict=True) if t >= 0]


def signatures(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``code, fp``: each fingerprint under its own key and, where the threshold is over 0, under half of the keys near it.

    Of two fingerprints whose keys differ by a mask, the one with a 0 at the
    mask's lowest bit goes to the other's key, so each such pair meets once.
    """
    masks = [
        [(np.uint64(sum(1 << b for b in flips)), np.uint64(flips[0])) for k in range(1, t + 1) for flips in combinations(range(len(bits)), k)]
        for bits, t in parts
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for number, (bits, _) in enumerate(parts):
                key, top = gather(values, bits), np.uint64(number << 40)
                yield pa.record_batch([pa.array((key | top).view(np.int64)), pa.array(values.view(np.int64))], names=["code", "fp"])
                for mask, low in masks[number]:
                    own = (key >> low) & np.uint64(1) == 0
                    near = (key[own] ^ mask) | top
                    yield pa.record_batch([pa.array(near.view(np.int64)), pa.array(values[own].view(np.int64))], names=["code", "fp"])

    return fps.select("fp").mapInArrow(run, "code long, fp long")


def link_sorted(codes: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, in each run of equal codes, all fingerprints within the radius of one another.

    Small buckets give every link. A larger one gives a spanning forest: each
    fingerprint reached is compared with those not reached yet, and only with
    them, so a dense bucket costs little more than its size.
    """
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(codes)])
    size = np.repeat(sizes, sizes)
    left, right = [], []
    for d in range(1, min(SMALL_BUCKET, int(sizes.max(initial=0)))):
        a, b = fps[:-d], fps[d:]
        near = (codes[:-d] == codes[d:]) & (size[:-d] <= SMALL_BUCKET) & (np.bitwise_count(a ^ b) <= radius)
        left.append(a[near])
        right.append(b[near])
    for at in np.flatnonzero(sizes > SMALL_BUCKET):
        rest = np.unique(fps[starts[at] : starts[at] + sizes[at]])
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                one = todo.pop()
                hit = np.bitwise_count(rest ^ one) <= radius
                if hit.any():
                    found = rest[hit]
                    left.append(np.full(len(found), one))
                    right.append(found)
                    todo.extend(found)
                    rest = rest[~hit]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def link_buckets(signed: DataFrame, radius: int, most: int | None) -> DataFrame:
    """``a, b`` links within buckets, or ``code, a`` rows (b null) of buckets over ``most`` rows, which are left for later."""

    def batch_of(code, a, b) -> pa.RecordBatch:
        return pa.record_batch([code, a, b], schema=pa.schema([("code", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

    def links(codes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = link_sorted(codes, fps, radius)
        return batch_of(pa.nulls(len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)))

    def later(codes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return batch_of(pa.array(codes), pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, fps, skipped = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            codes = np.concatenate([codes, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(codes):
                continue
            if skipped is not None:
                n = int(np.searchsorted(codes, skipped, "right"))
                yield later(codes[:n], fps[:n])
                codes, fps = codes[n:], fps[n:]
                if not len(codes):
                    continue
                skipped = None
            n = int(np.searchsorted(codes, codes[-1], "left"))
            if n:
                yield links(codes[:n], fps[:n])
                codes, fps = codes[n:], fps[n:]
            if most is not None and len(codes) > most:
                skipped = codes[0]
                yield later(codes, fps)
                codes, fps = codes[:0], fps[:0]
        if len(codes):
            yield links(codes, fps)

    return signed.repartition("code").sortWithinPartitions("code").mapInArrow(run, "code long, a long, b long")


def radius_links(fps: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of distinct fingerprints within the radius; none is lost."""
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    found = staged(link_buckets(signatures(fps, plan(fps, n, radius)), radius, bucket_rows), "simhash-links")
    links = found.where("b IS NOT NULL").select("a", "b")
    large = found.where("b IS NULL").select("code", F.col("a").alias("fp"))
    if large.isEmpty():
        return links
    # Two fingerprints within the radius agree on all bits of one of radius + 1 groups; so a large bucket falls into far smaller ones.
    finer = staged(link_buckets(finer_codes(large, radius), radius, bucket_rows), "simhash-finer")
    links = links.unionByName(finer.where("b IS NOT NULL").select("a", "b"))
    large = finer.where("b IS NULL").select("code", F.col("a").alias("fp"))
    counts = large.groupBy("code").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("blocks"))
    if counts.isEmpty():
        return links
    block = large.join(counts, "code").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    block = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = block.select(F.xxhash64("code", F.least("own", "other"), F.greatest("own", "other")).alias("code"), "fp")
    return links.unionByName(link_buckets(pairs, radius, None).select("a", "b"))


def finer_codes(large: DataFrame, radius: int) -> DataFrame:
    """``code, fp``: each fingerprint of a bucket under the bucket's code joined with each of ``radius + 1`` interleaved groups of its bits."""
    masks = [sum(1 << b for b in range(i, BITS, radius + 1)) for i in range(radius + 1)]
    signed = [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]
    codes = F.array(*(F.xxhash64("code", F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(signed)))
    return large.select(F.explode(codes).alias("code"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """``id, fp, component``: one row per input row; component is the smallest id reachable over links of at most ``radius`` bits.

    Equal fingerprints are one node, so copies are never paired. Texts without a
    word share fingerprint 0 and are linked like any other. Null ids do not count
    as smallest; a component of null ids alone has a null component. Repeated
    rows give repeated rows, an empty table gives none.
    """
    rows = staged(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash-rows")
    fps = staged(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-fps")
    roots = connected(radius_links(fps, radius)).withColumnRenamed("node", "fp")
    named = staged(fps.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("size"))
    several = named.join(lowest.where("size > 1"), "root").select("fp", "component")
    alone = lowest.where("size = 1").select(F.col("root").alias("fp"), "component")
    return rows.join(several.unionByName(alone), "fp", "left").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with only the row of the smallest id of each near-duplicate group; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    dropped = few(staged(found.where("id <> component").select(F.col("id").alias("__drop")).distinct(), "simhash-dropped"))
    return docs.join(dropped, docs[id_col] == dropped["__drop"], "left_anti")


def op5(docs: DataFrame) -> DataFrame:
    """The rows of query ``op5_simhash``."""
    found = near_duplicates(docs, radius=4, words_per_shingle=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
