"""Packing token sequences into fixed windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilake.llm.staging import staged
from civilake.llm.tokens import CACHE_BYTES, END_ID, encoder, small_runs

#: Remainders packed together in one task's group; the only under-full windows are the last of each group.
GROUP_PIECES = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def fullest(counts: Counter[int], capacity: int) -> list[int]:
    """The multiset of lengths, holding the longest one left, whose sum is closest to the capacity.

    Subset sums live in one integer's bits. Each copy of a length, longest
    first, adds one layer ``reach | reach << length``; the search stops at the
    first layer that reaches the capacity. The chosen sum is traced back through
    the layers.
    """
    longest = max(counts)
    room = capacity - longest
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    layers: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        for _ in range(min(counts[length] - (length == longest), room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            layers.append((length, reach))
            reach = grown
            if reach & goal:
                break
        if reach & goal:
            break
    best = reach.bit_length() - 1
    chosen = [longest]
    for length, before in reversed(layers):
        if not before >> best & 1:
            chosen.append(length)
            best -= length
    return chosen


def windows(lengths: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Multisets of lengths and how often each is used, covering all lengths."""
    counts = Counter(lengths)
    while counts:
        chosen = fullest(counts, capacity)
        used = Counter(chosen)
        times = min(counts[length] // n for length, n in used.items())
        for length, n in used.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        yield chosen, times


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Every document's ids (and the end id) cut every ``capacity`` ids: PIECES columns, no ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path, cache_bytes)
        end = end_id.to_bytes(tokens.width, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for start, stop in small_runs(pc.binary_length(texts).fill_null(0).to_pylist()):
                for doc_id, found in zip(ids[start:stop], tokens.encode(texts[start:stop].to_pylist()), strict=True):
                    all_ids = np.frombuffer(found + end, f"<u{tokens.width}").astype("<u4")
                    for at in range(0, len(all_ids), capacity):
                        piece = all_ids[at : at + capacity]
                        rows.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(all_ids)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECES)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_PIECES)
        tokens.rest()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: PIECES columns, ``sequence_id`` and ``offset``.

    A document is cut every ``capacity`` ids; whole windows stand alone. The
    remainders are dealt evenly, by a hash of their row, to groups of about
    ``group_pieces`` and each group is packed by minimum bin slack, so padding is
    left only in a group's last windows. A group's size is bounded whatever the
    input, and no length, source or document draws pieces to one group.

    Null text is an empty text, which is the end id alone. Null ids and repeated
    rows are packed like any other row. An empty table gives no rows.
    """
    pieces = staged(
        token_pieces(docs, tokenizer_path, capacity, id_col, text_col, cache_bytes=cache_bytes).withColumn("row", F.monotonically_increasing_id()),
        "packing-pieces",
    )
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        order = np.lexsort((group["row"].to_numpy(), lengths))
        free = {int(n): list(part[::-1]) for n, part in zip(*_runs(lengths[order], order), strict=True)}
        sequence, offset, rows = np.empty(len(group), "i8"), np.empty(len(group), "i8"), group["row"].to_numpy()
        for chosen, times in windows(lengths.tolist(), capacity):
            for _ in range(times):
                members = [free[n].pop() for n in chosen]
                sequence[members] = rows[members].min()
                offset[members] = np.cumsum([0, *chosen[:-1]])
        return group.drop(columns=["group"]).assign(sequence_id=sequence, offset=offset)

    schema = f"{PIECES}, row long, sequence_id long, offset long"
    packed = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInPandas(fill, schema)
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole).drop("row")


def _runs(values: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of a sorted array, and the items that stand beside each."""
    distinct, first = np.unique(values, return_index=True)
    return distinct, np.split(items, first[1:])


def op6(docs: DataFrame, tokenizer_path: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """The rows of query ``op6_packing``: windows of 2048 ids. ``cache_bytes`` bounds a worker's cache of encoded chunks."""
    return pack(docs, tokenizer_path, 2048, cache_bytes=cache_bytes)
