"""Exact and near duplicates, tokens, records and packing against brute force on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from civilake.llm import components, exact_dedup, packing, queries, records, simhash, tokens
from civilake.llm.staging import fresh_path
from tests.llm.conftest import AWKWARD, sentence


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_equals_library(library):
    texts = [t or "" for _, t in AWKWARD] + ["don't it's x's.", "a..b", "ΑΣ. Σ,", "É,é. ª º µ ß ẞ ﬁ", "é KK", "x,. y.! (z)", "UPPER lower,"]
    found = list(tokens.ChunkEncoder(queries.tokenizer_path(), limit=5).encode(texts))
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_get_whole_texts(tmp_path):
    """One that keeps white space is not encoded by chunks, whatever its file is called."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i for i, c in enumerate(sorted({chr(i) for i in range(33, 127)} | {"\u0120", "\u010a"}))}
    other = Tokenizer(models.BPE(letters | {"ab": len(letters), "\u0120a": len(letters) + 1}, [("a", "b"), ("\u0120", "a")]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "other.json"))
    encoder = tokens.ChunkEncoder(str(tmp_path / "other.json"))
    assert not encoder.by_chunks and tokens.ChunkEncoder(queries.tokenizer_path()).by_chunks
    for text, ids in zip(["ab ab a", " a", "", None], encoder.encode(["ab ab a", " a", "", None]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == other.encode(text or "", add_special_tokens=False).ids


def test_exact_dedup_matches_grouping(awkward):
    rows = exact_dedup.op2(awkward).collect()
    assert len(rows) == len(AWKWARD)
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for row in rows:
        ids = groups[row.text_sha256]
        assert row.group_size == len(ids)
        assert row.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(row.text_sha256 for row in rows if row.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}


@pytest.mark.parametrize("large", [1, 500])
def test_exact_dedup_reads_only_survivors(awkward, large, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", large)
    found = exact_dedup.refine(awkward, prefix_chars=1)
    assert dict(found.groupBy("group_size").count().collect()) == {1: 9, 3: 6}
    texts = [t or "" for _, t in AWKWARD]
    keys = Counter((len(t.encode()), t[:1]) for t in texts)
    assert found.where("text_sha256 IS NOT NULL").count() == sum(keys[len(t.encode()), t[:1]] > 1 for t in texts)


def test_without_copies_takes_null_and_empty_as_one(spark):
    rows = [(1, None, "x"), (1, "", "y"), (2, "a", "z"), (2, "b", "z"), (None, "a", "w"), (3, "prefix one", "q"), (4, "prefix two", "q")]
    out = exact_dedup.without_copies(spark.createDataFrame(rows, "doc_id long, text string, size string"), prefix_chars=3)
    assert out.columns == ["doc_id", "text", "size"]
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, ""), (2, "a"), (2, "b"), (3, "prefix one"), (4, "prefix two")]


def test_without_copies_keeps_columns(awkward):
    out = exact_dedup.without_copies(awkward)
    assert out.columns == awkward.columns
    assert out.count() == len({t or "" for _, t in AWKWARD})


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 9), (7, 3), (100, 90), (90, 80), (80, 70), (70, 60), (-5, -4)]
    found = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 100: 60, 90: 60, 80: 60, 70: 60, 60: 60, -5: -5, -4: -5}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(fps: dict[int, int], radius: int) -> dict[int, int]:
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(fps, 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("bucket_rows", [10, simhash.BUCKET_ROWS])
def test_radius_links_lose_nothing(spark, bucket_rows):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = set(rng.integers(0, 1 << 63, 400, dtype=np.uint64).tolist())
    for centre in centres[:8]:  # dense clusters: many fingerprints in few buckets
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            values.add(int(centre) ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = dict(components.connected(simhash.radius_links(fps, 4, bucket_rows)).collect())
    expected = brute_components({v: v % (1 << 64) for v in sorted(signed)}, 4)
    assert {v: roots.get(v, v) for v in signed} == expected


def test_simhash_rows(awkward, empty, spark):
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit("añ b"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("añ b".encode(), 42)
    rows = simhash.op5(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {row.doc_id: row for row in rows if row.doc_id is not None}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == "0" * 16
    assert by_id[3].component_id == 1 and by_id[6].component_id == 4
    text = sentence(3, 30)
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == bits
    assert simhash.op5(empty).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {None, 1, 4, 10}


def test_thresholds_sum():
    cost, chosen = simhash.thresholds(10**6, [22, 21, 21], [10, 10**9, 10], 4)
    assert sum(chosen) == 4 - 3 + 1 and chosen[1] == min(chosen) and cost > 0


def test_records_round_trip(awkward, spark, library):
    manifest = records.write_records(awkward, queries.tokenizer_path(), fresh_path(spark, "test-records"))
    rows = records.read_records(manifest).orderBy("start").collect()
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (doc_id, _) in zip(rows, order, strict=True):
        assert (row.doc_id, row.start) == (doc_id, start)
        start += row.n_tokens
    lengths = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in AWKWARD)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == lengths
    for shard in manifest.collect():
        picked = records.read_at(shard.index_path, list(range(shard.records))[::-1])
        assert sum(len(ids) for _, ids in picked) == shard.ids
    assert records.read_records(records.write_records(awkward.limit(0), queries.tokenizer_path(), fresh_path(spark, "none"))).count() == 0


def test_corrupt_record_is_noticed():
    data = bytearray(records.frame(7, b"\x01\x00\x02\x00", 2))
    assert records.unframe(memoryview(data), 0)[1].tolist() == [1, 2]
    for at in (0, len(data) - 6):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bad), 0)


def test_packing_covers_every_id_once(awkward, empty, library):
    rows = packing.pack(awkward, queries.tokenizer_path(), 64, group_pieces=8).collect()
    sequences, pieces = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    expected = Counter()
    for i, t in AWKWARD:
        expected[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert pieces == expected
    by_id = {(r.doc_id, r.start): r for r in rows}
    ids = np.array([*library.encode(AWKWARD[12][1], add_special_tokens=False).ids, 1], "<u4")
    for (doc_id, start), r in by_id.items():
        if doc_id == 10:
            assert r.ids_crc32 == zlib.crc32(ids[start : start + r.length].tobytes())
    assert packing.pack(empty, queries.tokenizer_path(), 64).count() == 0


def test_fullest_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        chosen = packing.fullest(Counter(lengths), 48)
        assert max(lengths) in chosen and not Counter(chosen) - Counter(lengths) and sum(chosen) <= 48
        longest = max(lengths)
        rest = lengths.copy()
        rest.remove(longest)
        sums = {longest + sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n)}
        assert sum(chosen) == max(s for s in sums if s <= 48)
