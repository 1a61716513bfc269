"""Periodic runs of words: branching tandem repeats by smaller-half leaf lists of a suffix tree, rotated and merged into maximal runs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.llm.sampling import unused
from civilake.llm.tokens import small_runs

#: A run counts if it is at least so long, and holds its period at least so often.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words of a stretch's start that must recur in it: every run has a pair of suffixes that agree on more words than these.
SEED_WORDS = 4
#: Leaves that are checked, and bytes of text that are read, at once.
LEAVES_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 1 << 22
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word as the place of its first equal in the text."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def recurring(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``[low, high)`` that can hold runs, each within one of the texts that begin at ``starts``.

    A run of period q and length over 4q (or of 6 words, q = 1) is covered by
    sequences of SEED_WORDS words that occur in it twice. So words outside of such
    sequences are cut away, and again within each stretch that is left, until
    nothing more goes. No run is lost or shortened: of equal sequences both are
    kept, and hash collisions only keep more.
    """
    low, high = starts[:-1], starts[1:]
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    size = -1
    while True:
        wide = high - low >= LEAST_LENGTH
        low, high = low[wide], high[wide]
        now = int((high - low).sum())
        if now == size or not now:
            return low, high
        size = now
        lengths = high - low - SEED_WORDS + 1
        first = np.cumsum(lengths) - lengths
        own = np.repeat(np.arange(len(low)), lengths)
        at = np.arange(int(lengths.sum())) - first[own] + low[own]
        key = own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(SEED_WORDS):
            key = (key ^ mixed[at + i]) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, own = at[twice], own[twice]
        if not len(at):
            return at, at
        gap = np.flatnonzero((at[1:] > at[:-1] + SEED_WORDS) | (own[1:] != own[:-1])) + 1
        low, high = at[np.r_[0, gap]], at[np.r_[gap - 1, len(at) - 1]] + SEED_WORDS


def suffix_tree(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of one text as its leaves in order, each suffix's place among them, and the depth at which neighbours part.

    Suffixes are ordered by prefix doubling; the ranks of every doubling tell how
    many words two neighbouring suffixes share. ``depth[i]`` is that of leaves
    i - 1 and i; an inner node is a range of leaves that share its depth.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1  # 0 is the end, before all words
    levels, step = [rank], 1
    while step < n and rank.max() < n:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, ranked[1:] != ranked[:-1]])
        levels.append(rank)
        step *= 2
    leaves = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[leaves] = np.arange(n)
    a, b, depth = leaves[:-1].copy(), leaves[1:].copy(), np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        # Two suffixes shorter than 2^level are told apart by their ends, so equal ranks are equal words.
        same = (a < n) & (b < n)
        same[same] = levels[level][a[same]] == levels[level][b[same]]
        same &= np.maximum(a, b) + (1 << level) <= n
        depth[1:][same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return leaves, place, depth


def inner_nodes(depth: list[int], deepest: int, fewest: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """``low, high, depth, cuts`` of the inner nodes of at least ``fewest`` leaves and at most ``deepest`` words: leaves [low, high), children parted at the cuts."""
    stack: list[tuple[int, int, list[int]]] = []  # low, depth, cuts
    for i in range(1, len(depth) + 1):
        d = depth[i] if i < len(depth) else 0
        low = i - 1
        while stack and stack[-1][1] > d:
            low, own, cuts = stack.pop()
            if own <= deepest and i - low >= fewest:
                yield low, i, own, cuts
        if stack and stack[-1][1] == d:
            stack[-1][2].append(i)
        elif d:
            stack.append((low, d, [i]))


def branching_repeats(words: np.ndarray, copies: int = 2) -> list[tuple[int, int]]:
    """``(start, period)`` of the tandem repeats ``ww`` not followed by w's first word, at nodes that can be w of a run of ``copies`` periods.

    Every leaf of a node but those of its largest child is checked in both
    directions: whether the suffix one depth on, or back, is of the node too.
    So a leaf is checked only where its child is at most half of its node.
    """
    n = len(words)
    leaves, place, depth = suffix_tree(words)
    node, ranges = [], []
    for low, high, own, cuts in inner_nodes(depth.tolist(), n // copies, copies):
        edges = [low, *cuts, high]
        largest = max(range(len(edges) - 1), key=lambda i: edges[i + 1] - edges[i])
        for i in range(len(edges) - 1):
            if i != largest:
                node.append((low, high, own))
                ranges.append((edges[i], edges[i + 1]))
    if not node:
        return []
    node, ranges = np.array(node, np.int64), np.array(ranges, np.int64)
    sizes = ranges[:, 1] - ranges[:, 0]
    followed = np.append(words, -1)
    found = []
    for start, end in small_runs(sizes.tolist(), LEAVES_AT_ONCE):
        size = sizes[start:end]
        own = np.repeat(np.arange(start, end), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + ranges[own, 0]
        low, high, d = node[own].T
        leaf = leaves[at]
        for first in (leaf, leaf - d):
            second = first + d
            other = second if first is leaf else first
            inside = (other >= 0) & (other < n)
            there = place[np.where(inside, other, 0)]
            hit = inside & (low <= there) & (there < high)
            i, p = first[hit], d[hit]
            branch = followed[i + p] != followed[i + 2 * p]
            found.append(np.stack([i[branch], p[branch]], axis=1))
    return [(int(i), int(p)) for i, p in np.unique(np.concatenate(found), axis=0)]


def rotated(words: np.ndarray, start: int, period: int) -> int:
    """How far a tandem repeat can be rotated to the left."""
    moved, width = 0, 64
    while start > moved:
        width = min(width, start - moved)
        at = start - moved - width
        differ = np.flatnonzero(words[at : at + width] != words[at + period : at + period + width])
        if len(differ):
            return moved + width - 1 - int(differ[-1])
        moved, width = moved + width, width * 2
    return moved


def maximal_runs(words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one text, by start, then period.

    Each run ends with one branching repeat of its period. Shorter periods come
    first; a repeat whose period is a multiple of a run's that it lies in is that
    run again.
    """
    ending: dict[int, list[tuple[int, int]]] = {}
    for i, p in sorted(branching_repeats(words, max(2, least_exponent)), key=lambda x: x[1]):
        known = ending.setdefault(i + 2 * p, [])
        if not any(p % period == 0 and start <= i for start, period in known):
            known.append((i - rotated(words, i, p), p))
    runs = ((start, end - start, p) for end, known in ending.items() for start, p in known)
    return sorted((r for r in runs if r[1] >= max(least_length, least_exponent * r[2])), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words and runs of each of some texts, whose recurring stretches are found together."""
    words = [text.split() for text in texts]  # of bytes: at ASCII white space only
    numbers = [word_numbers(w) for w in words]
    starts = np.cumsum([0, *map(len, words)])
    joined = np.concatenate([np.zeros(0, np.int64), *numbers])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    low, high = recurring(joined, starts)
    texts_of = np.searchsorted(starts, low, "right") - 1
    for a, b, text in zip(low.tolist(), high.tolist(), texts_of.tolist(), strict=True):
        offset = a - int(starts[text])
        found[text].extend((offset + start, length, period) for start, length, period in maximal_runs(joined[a:b]))
    return list(zip(words, found, strict=True))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist())


def periodic_runs(docs: DataFrame, text: Column, runs: str = "runs", without: str = "collapsed") -> DataFrame:
    """``docs`` with two more columns: the text's maximal periodic runs, and its words without what the runs repeat.

    Words end at ASCII white space and are numbered from 0. A run is a stretch
    of smallest period q whose words q apart are equal, of at least
    max(LEAST_LENGTH, LEAST_EXPONENT * q) words, that no neighbouring word extends;
    ``runs`` lists them by start, then period. A null text counts as empty; an
    empty one has no runs. Every row stands for itself, so repeated rows, ties
    and null ids need no rule, nothing is shuffled, and a lost task is only run
    again. Clashing names are an error: choose others.
    """
    if {runs.lower(), without.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {runs} or {without} already")
    body = unused(docs, "body")
    given = docs.withColumn(body, F.coalesce(text, F.lit("")).cast("binary"))
    schema = docs.select("*", F.lit(None).cast(RUN).alias(runs), F.lit(b"").alias(without)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, end in small_runs(pc.binary_length(texts).to_pylist(), BYTES_AT_ONCE):
                found = runs_of_texts(texts.slice(start, end - start).to_pylist())
                lists = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in found]
                own = [batch.column(i).slice(start, end - start) for i in range(batch.num_columns - 1)]
                yield pa.record_batch([*own, pa.array(lists, kind), pa.array([collapsed(w, r) for w, r in found], pa.binary())], names=schema.names)

    return given.mapInArrow(run, schema).withColumn(without, F.col(without).cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of query ``op13_runs``: in a tenth of the documents, told by their id, the end becomes periodic. A null id leaves the text alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", words.alias("words")).withColumn("n", F.size("words")).withColumn("a", (g % F.nullif("n", F.lit(0))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    unit = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))
    joined = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(unit), F.lit(1), left)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, joined).otherwise(F.col("text")).alias("text"))


def op13(docs: DataFrame) -> DataFrame:
    """The rows of query ``op13_runs``: what the operator found, as digests."""
    found = periodic_runs(planted(docs), F.col("text")).drop("text")

    def better(x: Column, y: Column) -> Column:
        """-1 if x comes first: the greater length/period, then the smaller start, then the smaller period."""
        left, right = x["length"].cast("decimal(38,0)") * y["period"], y["length"].cast("decimal(38,0)") * x["period"]
        return F.when(left > right, -1).when(left < right, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(F.signum(x["period"] - y["period"]).cast("int"))

    best = F.get(F.array_sort("runs", better), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
