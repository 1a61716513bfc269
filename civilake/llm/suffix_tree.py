"""A probabilistic suffix tree over words: variable-length contexts, smoothed next-symbol distributions, scores of whole texts.

The tree is grown branch by branch. A branch is the part of the tree below one
last word; each training and scored position goes, with the words before it, to
the task of its branch, which counts the branch's contexts, tests them, keeps
those that diverge and answers every position from its longest kept context. A
hot last word would make one branch too large for a task; contexts made of hot
words alone are therefore counted first by grouped sums, a level at a time, and
their branches begin at the first word that is not hot.

Blocks of documents travel as compressed arrays, so what is shuffled and staged
stays within a few bytes a token.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilake.llm.langid import held_out
from civilake.llm.staging import bucketed, staged
from civilake.llm.tokens import small_runs

#: Text bytes of one block of documents; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: A transition takes part in the tree if it occurs so often in training documents, whatever the corpus.
LEAST_COUNT = 2
#: Longest context, in words. Each more sends about 1.7 bytes a token.
DEPTH = 3
#: A context is kept if its distribution gains so many nats a transition over its suffix's, on the training tokens.
LEAST_GAIN = 4.0
#: What a transition's count is discounted by; the sum of the discounts goes to the shorter context.
DISCOUNT = 0.75
#: A word that occurs more often begins no branch: this bounds the largest branch, and so a task's memory.
HOT_WORD = 1 << 22
#: Positions, and distinct words of blocks, that one task is meant to take.
WINDOWS_PER_PART, WORDS_PER_PART = 1 << 21, 1 << 19
#: Positions whose branches a task tests at a time (one branch at least).
WINDOWS_AT_ONCE = 1 << 19
#: The end of a text, as a symbol; no word is empty.
END = b""

ROW = "block long, part int, kind string, data binary, n long"
_ROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("n", pa.int64())])
COUNTED = f"{ROW}, total long, types long, once long, twice long, hot long"
_COUNTED = pa.schema([*_ROW, *((name, pa.int64()) for name in ("total", "types", "once", "twice", "hot"))])


def zipped(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one compressed message; non-negative integers take the least width, and bytes of one rank stand together."""
    head, body = [len(arrays)], []
    for values in arrays:
        if values.dtype.kind in "iu" and (not len(values) or values.min() >= 0):
            top = int(values.max()) if len(values) else 0
            values = values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        elif values.dtype == bool:
            values = values.view(np.uint8)
        planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if values.itemsize > 1 else values
        data = pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(values) else b""
        head += ["uif".index(values.dtype.kind) << 8 | values.itemsize, len(values), len(data)]
        body.append(data)
    return np.array(head, "<i8").tobytes() + b"".join(body)


def unzipped(message: bytes) -> list[np.ndarray]:
    """The arrays that ``zipped`` put into a message."""
    n = int(np.frombuffer(message, "<i8", 1)[0])
    heads, at, out = np.frombuffer(message, "<i8", 3 * n, 8).reshape(n, 3).tolist(), 8 + 24 * n, []
    for kind, length, size in heads:
        dtype = np.dtype(f"<{'uif'[kind >> 8]}{kind & 255}")
        planes = np.frombuffer(pa.Codec("zstd").decompress(message[at : at + size], length * dtype.itemsize), np.uint8) if length else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, length).T).reshape(-1).view(dtype))
        at += size
    return out


def batch(rows: list[tuple], schema: pa.Schema = _ROW) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tokens_of(text: str | None) -> list[bytes]:
    """A text's tokens: its words with A-Z in lower case, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def encode_blocks(docs: DataFrame, id_col: str, text_col: str, held_col: str) -> DataFrame:
    """Two rows for each block of documents: ``text`` (ids, held-out flags, lengths, word numbers) and ``words`` (its distinct words and their counts).

    Words are numbered by their checksums, so those that one counting task needs are a run of numbers.
    """

    def rows(block: int, ids: list, held: list[bool], texts: list) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        parts = []
        for text in texts:
            words = tokens_of(text)
            for word in set(words).difference(numbers):
                numbers[word] = len(numbers)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        order = np.argsort(np.fromiter(map(zlib.crc32, numbers), np.int64, len(numbers)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths, stream = np.array([len(part) for part in parts]), rank[np.concatenate(parts)]
        known, held = np.array([i is not None for i in ids], bool), np.array(held, bool)
        found = list(numbers)
        found = [found[i] for i in order]
        text = zipped(np.array([i or 0 for i in ids], "<i8"), known, held, lengths, stream)
        taught = np.bincount(stream[~np.repeat(held, lengths)], minlength=len(found))
        words = zipped(np.frombuffer(b"".join(found), np.uint8), np.array([len(w) for w in found]), taught, np.bincount(stream, minlength=len(found)))
        return batch([(block, 0, "text", text, len(stream)), (block, 0, "words", words, len(found))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for found in batches:
            for at in range(0, found.num_rows, 256):
                part = found.slice(at, 256).to_pydict()
                for doc_id, text, out in zip(part["id"], part["body"], part["held"], strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    held.append(out)
                    size += len(text or "") + 64
                    if size >= BLOCK_BYTES:
                        yield rows(block, ids, held, texts)
                        block, ids, held, texts, size = block + 1, [], [], [], 0
        if ids:
            yield rows(block, ids, held, texts)

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), F.col(held_col).alias("held"))
    return wanted.mapInArrow(run, ROW)


def count_words(blocks: DataFrame, parts: int, hot_word: int) -> DataFrame:
    """COUNTED rows: for each block and counting task, its words' training counts, symbols and hot flags, in the order of their numbers.

    A symbol is a positive number of a word that occurs LEAST_COUNT times in
    training (0: it does not), the commoner the smaller. The sums over the task's
    distinct words stand in the first of its rows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for block, data in zip(found.column(0).to_pylist(), found.column(1), strict=True):
                text, lengths, taught, every = unzipped(data.as_py())
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                raw = text.tobytes()
                bounds = ends.tolist()
                part = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)), np.int64, len(lengths)) * parts >> 32
                edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
                rows = []
                for low, high in zip(edges, edges[1:], strict=False):
                    rows.append((block, int(part[low]), "words", zipped(text[ends[low] : ends[high]], lengths[low:high], taught[low:high], every[low:high]), high - low))
                yield batch(rows)

    def count(table: pa.Table) -> pa.Table:
        part, arrays, taught, every = table["part"][0].as_py(), [], [], []
        order = np.argsort(table["block"].to_numpy(), kind="stable").tolist()
        for at in order:
            text, lengths, own, both = unzipped(table["data"][at].as_py())
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
            arrays.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())]))
            taught.append(own)
            every.append(both)
        sizes = [len(a) for a in arrays]
        code = pa.concat_arrays(arrays).dictionary_encode().indices.to_numpy().astype(np.int64)
        c = np.bincount(code, np.concatenate(taught)).astype(np.int64)
        hot = (np.bincount(code, np.concatenate(every)) > hot_word) & (c >= LEAST_COUNT)
        rank = np.empty(len(c), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
        symbol = np.where(c >= LEAST_COUNT, 1 + rank * parts + part, 0)
        sums = (int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum()), int(hot.sum()))
        rows, low = [], 0
        for at, n in zip(order, sizes, strict=True):
            own = code[low : low + n]
            rows.append((table["block"][at].as_py(), part, "counts", zipped(c[own], symbol[own], hot[own]), n, *(sums if not low else (0,) * 5)))
            low += n
        return pa.Table.from_batches([batch(rows, _COUNTED)])

    asked = blocks.where("kind = 'words'").select("block", "data").mapInArrow(split, ROW)
    return asked.groupBy("part").applyInArrow(count, COUNTED)


class Root:
    """The empty context: absolute discounting over all words, the discounted mass for any word not seen in training."""

    def __init__(self, total: int, types: int, once: int, twice: int):
        self.total, self.types = total, types
        discount = once / (once + 2 * twice) if once else 0.5
        self.discount = min(max(discount, 0.05), 0.95)

    def log10(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words with these training counts."""
        if not self.total:
            return np.zeros(len(counts))
        seen = np.maximum(counts - self.discount, 1 - self.discount) / self.total
        return np.log10(np.where(counts > 0, seen, self.discount * self.types / self.total))

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10((c + 1) / (N + V + 1))."""
        return np.log10((counts + 1) / (self.total + self.types + 1))


def joined(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """64-bit keys of contexts followed by a symbol (or preceded by one)."""
    x = context.astype(np.uint64) + symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def divergence(context: np.ndarray, n: np.ndarray, symbol: np.ndarray, shorter: np.ndarray, contexts: int, least_gain: float) -> tuple[np.ndarray, ...]:
    """Per transition whether it is in the tree and its log10 probability; per context log10 of its rest, whether it is kept, whether to extend it.

    ``context`` is each transition's context, from 0; ``n`` its training count;
    ``shorter`` its log10 probability after the context without the oldest word.
    Counts are discounted and the rest of the mass goes to the shorter context's
    distribution. A context is kept if the log-likelihood of its tokens gains at
    least ``least_gain`` nats for each transition over the shorter one, which is
    their number times the divergence of the two distributions. A context whose
    next symbol is always the same is not extended: no extension could gain more.
    """
    inside = (symbol > 0) & (n >= LEAST_COUNT)
    weight = np.where(inside, n, 0)
    total, seen, k = np.bincount(context, n, contexts), np.bincount(context, weight, contexts), np.bincount(context, inside, contexts)
    left = np.bincount(context, np.where(inside, 10.0**shorter, 0), contexts)
    safe = np.maximum(total, 1)
    rest = np.clip(1 - (seen - DISCOUNT * k) / safe, 1e-9, 1) / np.clip(1 - left, 1e-9, 1)
    own = np.log10(np.maximum(n - DISCOUNT, 0.25) / safe[context])
    gain = np.bincount(context, weight * (own - shorter) * math.log(10), contexts) + (total - seen) * np.log(rest)
    kept = (k > 0) & (gain >= least_gain * k)
    return inside, own, np.log10(rest), kept, (k > 0) & ~((k == 1) & (seen == total))


def branch_gains(words: list[np.ndarray], symbol: np.ndarray, first: np.ndarray, taught: np.ndarray, shorter: np.ndarray, least_gain: float) -> np.ndarray:
    """What the tree adds to each position's log10 probability, for positions that hold all of some branches.

    ``words[d]`` is the symbol of the word d + 1 before the position (0: none, the
    context ends); ``first`` the depth at which its branch begins, ``shorter`` its
    log10 probability from the contexts above that.
    """
    now, node, live = shorter.astype(np.float64), np.zeros(len(symbol), np.int64), np.arange(len(symbol))
    width = np.int64(max([int(symbol.max(initial=0)), *(int(w.max(initial=0)) for w in words)]) + 1)
    for depth, before in enumerate(words, 1):
        has = before[live] > 0
        live, node = live[has], node[has]
        if not len(live):
            break
        node = numbered(node, before[live], width)
        at = np.flatnonzero(first[live] <= depth)
        own, s = live[at], symbol[live[at]]
        contexts, context = np.unique(node[at], return_inverse=True)
        pair, pair_first = numbered(context, s, width, True)
        n = np.bincount(pair, taught[own])
        of_pair = context[pair_first]
        inside, log10, rest, kept, extend = divergence(of_pair, n, s[pair_first], now[own[pair_first]], len(contexts), least_gain)
        found = kept[context]
        now[own[found]] = np.where(inside[pair[found]], log10[pair[found]], now[own[found]] + rest[context[found]])
        stays = np.ones(len(live), bool)
        stays[at] = extend[context]
        live, node = live[stays], node[stays]
    return now - shorter


def numbered(left: np.ndarray, right: np.ndarray, width: np.int64, where: bool = False):
    """Numbers from 0 of the distinct pairs (and where each first occurs)."""
    if int(left.max(initial=0)) < (1 << 62) // int(width):
        key = left.astype(np.int64)
        key *= width
        key += right.astype(np.int64)
    else:
        right = np.unique(right, return_inverse=True)[1]
        key = left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right
    if where:
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        return number, first
    return np.unique(key, return_inverse=True)[1]


class Block:
    """A block put together again: its text, its words' counts, and what is known of contexts made of hot words."""

    def __init__(self, text: pa.Table, answers: pa.Table, root: Root, depth: int):
        self.root, self.depth = root, depth
        kinds: dict[str, dict[int, list[np.ndarray]]] = {}
        for table in (text, answers):
            for part, kind, data in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["data"], strict=True):
                kinds.setdefault(kind, {})[part] = unzipped(data.as_py())
        self.kinds = kinds
        self.ids, self.known, self.held, lengths, self.stream = kinds["text"][0]
        self.counts, symbols, hot = (np.concatenate(parts) for parts in zip(*(kinds["counts"][p] for p in sorted(kinds["counts"])), strict=True))
        self.lengths = lengths.astype(np.int64)
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        self.place = np.arange(len(self.stream)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.symbol = symbols[self.stream].astype(np.int64)
        self.taught = ~self.held.astype(bool)[self.doc]
        self.now = root.log10(self.counts.astype(np.int64))[self.stream]
        hot = hot.astype(bool)[self.stream]
        self.run = np.zeros(len(hot), np.int64)  # hot words just before a token
        if hot.any():
            cold = np.maximum.accumulate(np.where(~hot, np.arange(len(hot)), -1))
            run = np.minimum(np.arange(len(hot)) - cold, self.place + 1)
            self.run[1:] = run[:-1]
            self.run[self.place == 0] = 0
        self.live = np.ones(len(hot), bool)
        for level in range(1, 1 + len(kinds.get("hot", {}))):
            self._apply(level, *kinds["hot"][level])

    def _context(self, at: np.ndarray, depth: int) -> np.ndarray:
        context = np.zeros(len(at), np.uint64)
        for back in range(1, depth + 1):
            context = joined(context, self.symbol[at - back])
        return context

    def hot_pairs(self, level: int) -> tuple[np.ndarray, ...]:
        """Places whose ``level`` words before are all hot and whose context may be extended so far, the number of each one's (context, symbol), and where each number first occurs."""
        at = np.flatnonzero((self.run >= level) & self.live)
        context = self._context(at, level)
        _, first, number = np.unique(joined(context, self.symbol[at]), return_index=True, return_inverse=True)
        return at, number, first, context

    def _apply(self, level: int, number: np.ndarray, own: np.ndarray, rest: np.ndarray, extend: np.ndarray) -> None:
        at, pair, first, _ = self.hot_pairs(level)
        values = [np.full(len(first), np.nan), np.zeros(len(first)), np.zeros(len(first), bool)]
        for into, found in zip(values, (own, rest, extend), strict=True):
            into[number] = found
        self.now[at] = np.where(np.isnan(values[0][pair]), self.now[at] + values[1][pair], values[0][pair])
        self.live[at] = values[2][pair]

    def windows(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The positions that have a branch, ordered by its task, last word and symbol; the depth where it begins; the task."""
        first = self.run + 1
        at = np.flatnonzero((self.place >= first) & (first <= self.depth) & self.live)
        at = at[self.symbol[at - first[at]] > 0]
        key = np.zeros(len(at), np.uint64)
        for back in range(1, int(first[at].max(initial=0)) + 1):
            key = np.where(first[at] >= back, joined(key, self.symbol[at - back]), key)
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.symbol[at], self.symbol[at - 1], part))
        return at[order], first[at[order]], part[order]

    def chunks(self, block: int, parts: int) -> pa.RecordBatch:
        """ROWs of kind ``windows``, one for each task that has a branch of the block's positions."""
        at, first, part = self.windows(parts)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist() if len(at) else []
        rows = []
        for low, high in zip(edges, edges[1:], strict=False):
            own, depth = at[low:high], first[low:high]
            before = [np.where(self.place[own] >= back, self.symbol[np.maximum(own - back, 0)], 0) for back in range(1, self.depth + 1)]
            symbol = self.symbol[own]
            distinct, where = np.unique(symbol, return_index=True)
            deeper = depth > 1
            data = zipped(*before, symbol, self.taught[own], distinct, self.counts[self.stream[own[where]]], depth, self.now[own[deeper]].astype("<f4"))
            rows.append((block, int(part[low]), "windows", data, high - low))
        return batch(rows)

    def scores(self, total: int, parts: int) -> pa.RecordBatch:
        """A row for each document, with what the branches answered added to its tokens."""
        now = self.now.copy()
        answers = self.kinds.get("gains", {})
        if answers:
            at, _, _ = self.windows(parts)
            now[at] += np.concatenate([answers[p][0] for p in sorted(answers)])
        counts, n = self.counts.astype(np.int64), len(self.lengths)
        sums = [np.bincount(self.doc, values, n) for values in ((counts > 0)[self.stream], self.root.base(counts)[self.stream], now)]
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        ids = pa.array(self.ids.astype("<i8"), mask=~self.known.astype(bool))
        return pa.record_batch([ids, pa.array(self.held.astype(bool)), self.lengths, sums[0].astype(np.int64), np.full(n, total, np.int64), sums[1], sums[2]], names=names)


def short(values: np.ndarray) -> np.ndarray:
    """32-bit floats rounded to 16 significant bits (to a hundred-thousandth of their size), so that their last byte costs nothing."""
    return ((values.view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view("<f4")


def grown(windows: DataFrame, root: Root, depth: int, least_gain: float) -> DataFrame:
    """ROWs of kind ``gains``: for each chunk of positions, what the tree adds to their log10 probabilities, in their order."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["block"].to_numpy(), kind="stable").tolist()
        columns: list[list[np.ndarray]] = [[] for _ in range(depth + 4)]
        for at in order:
            *found, taught, distinct, counts, first, deeper = unzipped(table["data"][at].as_py())
            shorter = root.log10(counts.astype(np.int64))[np.searchsorted(distinct, found[depth])].astype(np.float32)
            shorter[first > 1] = deeper
            for into, values in zip(columns, (*found, taught, first, shorter), strict=True):
                into.append(values)
        sizes, joint = [len(part) for part in columns[0]], []
        for at in range(len(columns)):
            joint.append(np.concatenate(columns[at]))
            columns[at] = []
        *before, symbol, taught, first, shorter = joint
        del joint
        by_word = np.argsort(before[0], kind="stable").astype(np.uint32 if len(symbol) < 1 << 32 else np.uint64)
        words = before[0][by_word]
        edges, gains = np.flatnonzero(np.r_[True, words[1:] != words[:-1], True]), np.empty(len(symbol), "<f4")
        del words
        for low, high in small_runs(np.diff(edges).tolist(), WINDOWS_AT_ONCE):  # whole branches
            own = by_word[edges[low] : edges[high]]
            gains[own] = branch_gains([w[own] for w in before], symbol[own], first[own], taught[own].astype(bool), shorter[own], least_gain)
        parts = np.split(short(gains), np.cumsum(sizes)[:-1])
        rows = [(table["block"][at].as_py(), table["part"][at].as_py(), "gains", zipped(part), len(part)) for at, part in zip(order, parts, strict=True)]
        return pa.Table.from_batches([batch(rows)])

    return windows.groupBy("part").applyInArrow(run, ROW)


def hot_level(text: DataFrame, answers: DataFrame, root: Root, depth: int, level: int, least_gain: float) -> DataFrame:
    """ROWs of kind ``hot`` (part: the level): the tests of contexts of ``level`` hot words, for each block's (context, symbol) pairs.

    Blocks count their own pairs first, so a hot context costs a row for each
    block and symbol at most, and each of its symbols may be summed in another task.
    """

    def pairs_of(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, right, root, depth)
        at, number, first, context = block.hot_pairs(level)
        n = np.bincount(number, block.taught[at], len(first)).astype(np.int64)
        some = np.full(len(first), left["block"][0].as_py())
        return pa.table([some, np.arange(len(first)), context[first].view(np.int64), block.symbol[at[first]], n, block.now[at[first]]],
                        names=["block", "number", "context", "symbol", "n", "shorter"])

    pairs = staged(text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(pairs_of, "block long, number long, context long, symbol long, n long, shorter double"), "tree-hot-pairs")
    counted = pairs.groupBy("context", "symbol").agg(F.sum("n").alias("n"), F.min("shorter").alias("shorter"))
    counted = counted.withColumn("inside", (F.col("symbol") > 0) & (F.col("n") >= LEAST_COUNT))
    inside = lambda x: F.coalesce(F.sum(F.when(F.col("inside"), x)), F.lit(0.0))
    contexts = counted.groupBy("context").agg(
        F.sum("n").alias("total"), inside(F.col("n")).alias("seen"), F.count_if("inside").alias("k"), inside(F.pow(F.lit(10.0), "shorter")).alias("left"),
        inside(F.col("n") * (F.log(F.col("n") - DISCOUNT) - F.col("shorter") * math.log(10))).alias("gain"),
    ).where("k > 0")
    clipped = lambda x: F.least(F.greatest(1 - x, F.lit(1e-9)), F.lit(1.0))
    contexts = contexts.withColumn("rest", clipped((F.col("seen") - DISCOUNT * F.col("k")) / F.col("total")) / clipped(F.col("left")))
    gain = F.col("gain") - F.col("seen") * F.log(F.col("total").cast("double")) + (F.col("total") - F.col("seen")) * F.log("rest")
    contexts = contexts.select(
        "context", "total", F.log10("rest").alias("rest"), (gain >= least_gain * F.col("k")).alias("kept"), (~((F.col("k") == 1) & (F.col("seen") == F.col("total")))).alias("extend")
    )
    own = F.when(F.col("kept") & F.col("inside"), F.log10((F.col("n") - DISCOUNT) / F.col("total")))
    tested = counted.join(contexts, "context").select("context", "symbol", own.alias("own"), F.when(F.col("kept"), F.col("rest")).otherwise(0.0).alias("rest"), "extend")
    told = pairs.select("block", "number", "context", "symbol").join(tested, ["context", "symbol"]).select("block", "number", "own", "rest", "extend")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        own = table["own"].to_numpy()
        data = zipped(table["number"].to_numpy(), own.astype("<f8"), table["rest"].to_numpy(), table["extend"].to_numpy())
        return pa.Table.from_batches([batch([(table["block"][0].as_py(), level, "hot", data, table.num_rows)])])

    return told.groupBy("block").applyInArrow(pack, ROW)


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_col: str = "held_out",
    depth: int = DEPTH,
    least_gain: float = LEAST_GAIN,
    hot_word: int = HOT_WORD,
    windows_per_part: int = WINDOWS_PER_PART,
) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, learnt from rows not held out.

    Every word, context and transition of the training rows is counted; no
    vocabulary is held in one place, and a few sums are all that reaches the driver.

    Null text is an empty text: its end alone. A null id stays null; a null
    held-out flag counts as not held out. Repeated rows are learnt from and scored
    as often as they occur; other columns are not looked at. If nothing is left to
    learn from, every probability is 1. An empty table gives no rows.
    """
    rows = docs.withColumn(held_col, F.coalesce(F.col(held_col), F.lit(False)))
    blocks = bucketed(encode_blocks(rows, id_col, text_col, held_col), "tree-blocks", "block")
    sizes = {row["kind"]: row["n"] for row in blocks.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two rows
    counts = staged(count_words(blocks, max(1, -(-sizes.get("words", 0) // WORDS_PER_PART)), hot_word), "tree-counts")
    total, types, once, twice, hot = (x or 0 for x in counts.agg(*(F.sum(c) for c in ("total", "types", "once", "twice", "hot"))).first())
    root = Root(total, types, once, twice)
    parts = max(1, -(-sizes.get("text", 0) // windows_per_part))
    text, answers = blocks.where("kind = 'text'"), counts.select(_ROW.names)
    for level in range(1, depth + 1) if hot else ():
        tested = staged(hot_level(text, answers, root, depth, level, least_gain), "tree-hot")
        if tested.isEmpty():
            break
        answers = answers.unionByName(tested)

    def chunks(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Block(left, right, root, depth).chunks(left["block"][0].as_py(), parts)])

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Block(left, right, root, depth).scores(total, parts)])

    if total:
        windows = text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(chunks, ROW)
        answers = answers.unionByName(grown(windows, root, depth, least_gain))
    scored = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(final, scored)


def op1(docs: DataFrame, **options) -> DataFrame:
    """The rows of query ``op1_suffix_tree``."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    return scores(marked, **options).withColumnRenamed("id", "doc_id")
