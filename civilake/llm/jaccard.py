"""Jaccard joins of word n-gram sets: prefixes in order of rarity, indexed by combinations of tokens where those are frequent, then exact sizes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilake.llm.components import connected
from civilake.llm.sampling import few
from civilake.llm.staging import staged

#: Links: DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Tokens in so many sets are indexed alone, by pairs, and, beyond, by triples.
SINGLES, PAIRS = 8, 512
MOST_TOGETHER = 3
#: A set of 2^band to 2^(band + 1) tokens deals its frequent tokens to 2^band / CELL_SHARE cells; only tokens of one cell are combined.
CELL_SHARE = 8
#: Tokens that one bucket of the counts, one block of sets, and one side of an exact comparison hold.
BUCKET_TOKENS, BLOCK_TOKENS, SIDE_TOKENS = 1 << 22, 1 << 20, 1 << 21
#: So many sets' numbers, ids and hashes (some 120 bytes each) are sent to all texts; of more, both sides are shuffled.
SENT_ROWS = 1 << 20
#: Words whose hashes a worker keeps.
CACHED_WORDS = 1 << 19

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, more: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of a hash and one more number."""
    h = (h ^ more) * MIX
    return h ^ (h >> np.uint64(29))


def missing(n, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
    """How many tokens of a set of n can at most be lacking in a set that links with it."""
    return n - (numerator * n + denominator - 1) // denominator


class Shingles:
    """The set of a text's word n-grams as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """A-Z are lower-cased, words end at ASCII white space; fewer words than ``words`` make one shingle, none an empty set."""
        import xxhash

        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        found = np.full(n, k, np.uint64)
        for i in range(k):
            found = mixed(found, hashes[i : i + n])
        return np.unique(found)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, hash, body``: what tells rows apart without their sets. A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("body"))


def described(texts: DataFrame, words: int) -> DataFrame:
    """``id, hash, n, k1, k2``: each row's set by its size and two checksums over all its tokens (128 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(2)):
                tokens = shingles(text.as_py())
                sums = np.array([len(tokens), tokens.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(tokens, np.uint64(7)), initial=0)], np.uint64)
                out[i] = sums.view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, out.T)], names=["id", "hash", "n", "k1", "k2"])

    return texts.mapInArrow(run, "id long, hash long, n long, k1 long, k2 long")


def with_numbers(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``num, body``: the texts of the sets in ``chosen`` (``num, at``, where ``at`` is the id and hash of a row that has the set). A row repeated as a whole comes repeatedly."""
    wanted = few(chosen.select("num", F.col("at.id").alias("__id"), F.col("at.hash").alias("__hash")), SENT_ROWS)
    return texts.join(wanted, texts["id"].eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).select("num", "body")


def shared_counts(numbered: DataFrame, words: int, buckets: int) -> DataFrame:
    """``num, shared``: how many tokens of each set some other set has too (or, rarely, seems to have: keys are 32 bits in each bucket).

    A task sends each token of some million once, and its set's number only if no
    other of these sets has it; so a token that very many sets share is no hot key.
    A bucket's counts go on in as many parts of the sets as there are buckets.
    """
    schema = "bucket int, keys binary, nums binary, runs binary, known binary, own binary, counts binary"
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int32(), *[pa.binary()] * 6]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, nums, sets, size = Shingles(words), [], [], 0
        for batch in batches:
            for num, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nums.append(num)
                sets.append(shingles(text.as_py()))
                size += len(sets[-1])
                if size >= BLOCK_TOKENS:
                    yield send(np.array(nums), sets)
                    nums, sets, size = [], [], 0
        if sets:
            yield send(np.array(nums), sets)

    def send(nums: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        first = np.r_[True, tokens[1:] != tokens[:-1]]
        several = ~(first & np.r_[first[1:], True])
        counts = np.bincount(owner[several], minlength=len(sets))
        rows = [[int(nums[0] % buckets), b"", b"", b"", b"", nums[counts > 0].astype("<i8").tobytes(), counts[counts > 0].astype("<u4").tobytes()]]
        bucket_of = lambda t: ((t >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        known = tokens[several & first]
        alone, owner = tokens[~several], owner[~several]
        edges, known_edges = (np.searchsorted(bucket_of(t), np.arange(buckets + 1)) for t in (alone, known))
        for b in range(buckets):
            at = slice(edges[b], edges[b + 1])
            by_owner = np.argsort(owner[at], kind="stable")
            own, runs = np.unique(owner[at], return_counts=True)
            parts = alone[at][by_owner].astype("<u4"), nums[own].astype("<i8"), runs.astype("<u4"), known[known_edges[b] : known_edges[b + 1]].astype("<u4")
            rows.append([b, *(x.tobytes() for x in parts), b"", b""])
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def count(key, rows):
        joined = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind)
        keys, known = joined("keys", "<u4"), joined("known", "<u4")
        ranked = np.sort(np.concatenate([keys, known, known]))
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        at = np.searchsorted(twice, keys)
        shared = at < len(twice)
        shared[shared] = twice[at[shared]] == keys[shared]
        nums, counts = np.unique(np.repeat(joined("nums", "<i8"), joined("runs", "<u4"))[shared], return_counts=True)
        nums, counts = np.r_[nums, joined("own", "<i8")].astype("<i8"), np.r_[counts, joined("counts", "<u4")].astype("<u4")
        parts = [(p, nums[nums % buckets == p].tobytes(), counts[nums % buckets == p].tobytes()) for p in range(buckets)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "nums", "counts"])

    def add(key, rows):
        nums, counts = (np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in (("nums", "<i8"), ("counts", "<u4")))
        nums, of = np.unique(nums, return_inverse=True)
        return pa.table([pa.array(nums, pa.int64()), pa.array(np.bincount(of, counts, len(nums)).astype(np.int64))], names=["num", "shared"])

    sent = numbered.mapInArrow(spread, schema)
    return sent.groupBy("bucket").applyInArrow(count, "part int, nums binary, counts binary").groupBy("part").applyInArrow(add, "num long, shared long")


def token_sets(numbered: DataFrame, words: int) -> DataFrame:
    """``num, n, tokens``: the sets themselves, eight bytes a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(text.as_py()) for text in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["num", "n", "tokens"])

    return numbered.mapInArrow(run, "num long, n long, tokens binary").dropDuplicates(["num"])


def rarity(counts: np.ndarray) -> np.ndarray:
    """A rank by number of sets, coarse enough for one byte; 0 if there is one set."""
    return np.minimum(255, np.floor(4 * np.log2(counts))).astype(np.uint8)


def together(rank: np.ndarray) -> np.ndarray:
    """How many tokens of this rarity make one signature."""
    return 1 + (rank > rarity(np.array([SINGLES]))[0]).astype(np.int64) + (rank > rarity(np.array([PAIRS]))[0])


def scheme(band: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[int, int]:
    """Cells, and the most tokens that a signature may combine, for the sets that meet in a band.

    Of a cell's tokens k - 1 give nothing, so a set's whole prefix must still
    yield one more than what can be missing: the smallest set in the band decides.
    """
    cells = max(1, (1 << band) // CELL_SHARE)
    smallest = -(-(1 << band) * numerator // denominator)
    most = MOST_TOGETHER
    while most > 1 and smallest - cells * most * (most - 1) // 2 < missing(smallest, numerator, denominator) + 1:
        most -= 1
    return cells, most


def signatures(tokens: np.ndarray, rank: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> np.ndarray:
    """The signatures of a set: two sets that link have one in common.

    Tokens stand in order of rarity. A token indexed alone yields one; a cell of
    tokens indexed k together yields one for each beyond the first k - 1. The
    prefix ends where it has yielded one more than the tokens that can be missing
    in a linked set, so whichever are missing, k tokens of one cell are left in
    both prefixes. Tokens of no other set yield, but need no signature. A set
    takes part in the bands of all sizes that larger partners can have.
    """
    n = len(tokens)
    if missing(n, numerator, denominator) < int((rank == 0).sum()):
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, rank))
    tokens, rank = tokens[order], rank[order]
    found = [np.zeros(0, np.uint64)]
    for band in range(n.bit_length() - 1, (n * denominator // numerator).bit_length()):
        cells, most = scheme(band, numerator, denominator)
        size = np.minimum(together(rank), most)
        cell = np.where(size > 1, (mixed(tokens, np.uint64(11)) % np.uint64(cells)).astype(np.int64), 0)
        group = size * cells + cell
        by_group = np.argsort(group, kind="stable")
        ranked = group[by_group]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        turn = np.empty(n, np.int64)
        turn[by_group] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        end = int(np.searchsorted(np.cumsum(turn >= size - 1), missing(n, numerator, denominator) + 1)) + 1
        used = np.flatnonzero(rank[:end] > 0)
        alone = tokens[used[size[used] == 1]]
        found.append(mixed(mixed(alone, np.uint64(1)), np.uint64(band)))
        used = used[size[used] > 1]
        used = used[np.lexsort((tokens[used], group[used]))]
        held, starts, counts = np.unique(group[used], return_index=True, return_counts=True)
        for m in np.unique(counts).tolist():
            for k in range(2, min(m, most) + 1):
                own = starts[(counts == m) & (held // cells == k)]
                if not len(own):
                    continue
                sets = tokens[used[own[:, None] + np.arange(m)]][:, np.array(list(combinations(range(m), k)))].reshape(-1, k)
                h = np.full(len(sets), k, np.uint64)
                for i in range(k):
                    h = mixed(h, sets[:, i])
                found.append(mixed(h, np.uint64(band)))
    return np.unique(np.concatenate(found))


def candidate_stars(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``a, b``: for each signature, every set that has it with the one of smallest number; so sets that share one are connected.

    Exact counts of sets for each token are summed over blocks of about a million
    tokens; a block sends a token once, and gets its rarity back once. Of the sets
    of a block that share a signature only the first goes on to the other blocks.
    """
    n = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-n // BLOCK_TOKENS))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("num"), F.lit(blocks)).cast("int"))
    bucket_of = lambda t: ((t >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    array = lambda rows, name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind)

    def send(key, rows):
        tokens, counts = np.unique(array(rows, "tokens", "<u8"), return_counts=True)
        edges = np.searchsorted(bucket_of(tokens), np.arange(blocks + 1))
        parts = [(b, key[0].as_py(), tokens[x:y].tobytes(), counts[x:y].astype("<u4").tobytes()) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
        columns = zip(*parts, strict=True) if parts else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "tokens", "counts"])

    def total(key, rows):
        tokens, of = np.unique(array(rows, "tokens", "<u8"), return_inverse=True)
        rank = rarity(np.bincount(of, array(rows, "counts", "<u4"), len(tokens)))[of]
        parts, at = [], 0
        for block, own in zip(rows["block"].to_pylist(), rows["tokens"].to_pylist(), strict=True):
            own = np.frombuffer(own, "<u8")
            r = rank[at : at + len(own)]
            parts.append((block, own[r > 0].tobytes(), r[r > 0].tobytes()))
            at += len(own)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "tokens", "ranks"])

    def sign(key, left, right):
        known, ranks = array(right, "tokens", "<u8"), array(right, "ranks", np.uint8)
        order = np.argsort(known)
        known, ranks = np.r_[known[order], np.uint64(0)], np.r_[ranks[order], np.uint8(0)]
        sigs, nums = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for num, tokens in zip(left["num"].to_pylist(), left["tokens"].to_pylist(), strict=True):
            tokens = np.frombuffer(tokens, "<u8")
            at = np.searchsorted(known[:-1], tokens)
            found = signatures(tokens, np.where(known[at] == tokens, ranks[at], 0), numerator, denominator)
            sigs.append(found)
            nums.append(np.full(len(found), num))
        sigs, nums = np.concatenate(sigs), np.concatenate(nums)
        order = np.lexsort((nums, sigs))
        sigs, nums = sigs[order], nums[order]
        first = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, np.int64)
        lowest = np.repeat(nums[first], np.diff(np.r_[first, len(sigs)]))
        near = np.unique(np.stack([nums, lowest], axis=1)[nums != lowest], axis=0)
        sig = pa.chunked_array([pa.array(sigs[first].view(np.int64)), pa.nulls(len(near), pa.int64())])
        return pa.table([sig, pa.array(np.r_[nums[first], near[:, 0]]), pa.array(np.r_[np.full(len(first), -1), near[:, 1]])], names=["sig", "a", "b"])

    sent = dealt.select("block", "tokens").groupBy("block").applyInArrow(send, "bucket int, block int, tokens binary, counts binary")
    ranked = sent.groupBy("bucket").applyInArrow(total, "block int, tokens binary, ranks binary")
    signed = dealt.groupBy("block").cogroup(ranked.groupBy("block")).applyInArrow(sign, "sig long, a long, b long")
    signed = staged(signed, "jaccard-signatures")
    across = signed.where("sig IS NOT NULL").select("sig", "a")
    lowest = across.groupBy("sig").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b <> last").select("sig", "b")
    far = across.join(lowest, "sig").where("a <> b").select("a", "b")
    return far.unionByName(signed.where("sig IS NULL").select("a", "b")).distinct()


def links(common, a, b, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
    """Whether two sets of sizes a and b with so many tokens in common link."""
    return denominator * common >= numerator * (a + b - common)


def with_first(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``root, num, n, linked``: whether each set links with the first set of its candidate group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, first in zip(batch.column(3), batch.column(4), strict=True):
                own, first = np.frombuffer(own.as_py(), "<u8"), np.frombuffer(first.as_py(), "<u8")
                found.append(links(len(np.intersect1d(own, first, assume_unique=True)), len(own), len(first), numerator, denominator))
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(found, pa.bool_())], names=["root", "num", "n", "linked"])

    first = members.where("num = root").select("root", F.col("tokens").alias("first"))
    return members.select("root", "num", "n", "tokens").join(first, "root").mapInArrow(run, "root long, num long, n long, linked boolean")


def forest(nums: np.ndarray, sets: list[np.ndarray], asking: np.ndarray, joined: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> list[tuple[int, int]]:
    """Links that connect what the links between sets at ``asking`` and all sets connect; those at ``joined`` are connected already.

    The sets' tokens are one inverted list, so one set's sizes in common with all
    others are one count. Nothing more is asked once all are connected.
    """
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array(list(map(len, sets)))
    group, out = np.arange(len(sets)), []
    if joined.any():
        group[joined] = np.flatnonzero(joined)[0]
    for u in np.flatnonzero(asking).tolist():
        low, high = np.searchsorted(tokens, sets[u], "left"), np.searchsorted(tokens, sets[u], "right")
        length = high - low
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low, length)
        common = np.bincount(owner[at], minlength=len(sets))
        hit = links(common, sizes[u], sizes, numerator, denominator) & (group != group[u])
        met, first = np.unique(group[hit], return_index=True)
        out.extend((int(nums[u]), int(nums[v])) for v in np.flatnonzero(hit)[first].tolist())
        group[np.isin(group, met)] = group[u]
        if (group == group[u]).all():
            break
    return out


def remaining_links(members: DataFrame, known: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``a, b``: links of the sets that do not link with the first of their candidate group, to all of the group, as far as they connect more.

    A group's tokens are dealt to sides of about SIDE_TOKENS, and each side of such
    sets meets each other side in a task of its own; those that link with the
    first are never compared among themselves.
    """
    sides = known.groupBy("root").agg(*(F.ceil(F.sum(F.when(c, F.col("n"))) / SIDE_TOKENS).cast("int").alias(name) for c, name in ((~F.col("linked"), "asking"), (F.col("linked"), "linked_sides"))))
    dealt = known.join(sides.where("asking > 0"), "root").join(members.select("num", "tokens"), "num")
    side = F.pmod(F.xxhash64("num"), F.when(F.col("linked"), F.col("linked_sides")).otherwise(F.col("asking"))).cast("int")
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    others = F.filter(F.sequence(F.lit(0), F.col("asking") - 1), lambda j: j != F.col("side"))
    asking = F.transform(others, lambda j: pair(F.least(j, F.col("side")), F.greatest(j, F.col("side"))))
    with_linked = F.transform(F.sequence(F.lit(1), F.col("linked_sides")), lambda j: pair(F.col("side"), -j))  # the first set at least
    linked = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: pair(i, -1 - F.col("side")))
    cells = F.when(F.col("linked"), linked).otherwise(F.concat(asking, with_linked))
    met = dealt.withColumn("side", side).withColumn("cell", F.explode(cells)).select("root", "cell.i", "cell.j", "num", "linked", "side", "tokens")

    def run(key, rows):
        i = key[1].as_py()
        linked, side = (rows[c].to_numpy() for c in ("linked", "side"))
        nums, sets = rows["num"].to_numpy(), [np.frombuffer(x, "<u8") for x in rows["tokens"].to_pylist()]
        found = forest(nums, sets, ~linked & (side == i), linked, numerator, denominator)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``id, n, component``: one row per input row, its set's size and the smallest id reachable over links.

    Two rows link if their sets of distinct ``words``-word shingles have a Jaccard
    similarity of at least numerator / denominator (no more than 1). Rows without a word have an
    empty set, link with nothing and are their own component. Equal sets are one
    node, so copies are never paired. Null ids do not count as smallest; a
    component of null ids alone has a null component. Repeated rows give repeated
    rows, an empty table none. Whole texts are read, and no set, token or partner
    is capped. Shingles are told apart by 64-bit hashes.

    A set with more tokens of its own than may be missing in a partner ends
    there: all its prefix is unshared. The others are indexed by their signatures;
    sets that share one form candidate groups, in which exact sizes decide: first of
    all with the group's first set, then of those that do not link with it.
    """
    if not 0 < numerator <= denominator:
        raise ValueError("a similarity from 0, exclusive, to 1")
    texts = texts_of(docs, id_col, text_col)
    rows = staged(described(texts, words), "jaccard-rows")
    keys = ["k1", "k2", "n"]
    sets = rows.where("n > 0").groupBy(*keys).agg(F.min("id").alias("low"), F.max(F.struct("id", "hash")).alias("at"))
    sets = staged(sets.withColumn("num", F.monotonically_increasing_id()), "jaccard-numbers")
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(with_numbers(texts, sets), words, max(1, -(-tokens // BUCKET_TOKENS)))
    open_sets = sets.join(shared, "num").where(f"n - shared <= n - ({numerator} * n + {denominator - 1}) div {denominator}")
    open_sets = staged(open_sets.select("num", "at"), "jaccard-open")
    found = staged(token_sets(with_numbers(texts, open_sets), words), "jaccard-sets")
    groups = staged(connected(candidate_stars(found, numerator, denominator)), "jaccard-groups")
    members = found.join(groups.withColumnRenamed("node", "num"), "num")
    known = staged(with_first(members, numerator, denominator), "jaccard-first")
    linked = known.where("linked AND num <> root").select(F.col("root").alias("a"), F.col("num").alias("b"))
    roots = connected(linked.unionByName(remaining_links(found, known, numerator, denominator)))
    named = staged(sets.join(roots.withColumnRenamed("node", "num"), "num", "left").select(*keys, "low", F.coalesce("root", "num").alias("root")), "jaccard-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    named = staged(named.join(lowest, "root").select(*keys, "component"), "jaccard-components")
    return rows.join(named, keys, "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def op12(docs: DataFrame) -> DataFrame:
    """The rows of query ``op12_jaccard``."""
    found = similar_documents(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
