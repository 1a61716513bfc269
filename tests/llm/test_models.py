"""Scoring, labelling, language, mixing, pseudonyms, search and the pipeline against brute force and held-out rows."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from civilake.llm import langid, mixing, pii, queries, suffix_tree, topk, toxicity
from tests.llm.conftest import AWKWARD

DATA = "/root/testdata/sf0.001"


def words_of(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_score_is_brute_force(awkward, empty):
    rows = suffix_tree.op1(awkward).collect()
    held = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in AWKWARD if not held(i) for w in words_of(t))
    total, types = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in AWKWARD:
        words = words_of(t)
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        expected[(i, held(i), len(words), sum(counts[w] > 0 for w in words), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == expected
    assert all(r.score < 0 for r in rows)
    assert suffix_tree.op1(empty).count() == 0


def brute_tree(texts, held, depth, least_gain):
    """log10 probability of every text from a tree kept in dictionaries, and the kept contexts with their next-symbol distributions."""
    counts = Counter(w for i, t in texts.items() if not held(i) for w in t)
    root = suffix_tree.Root(sum(counts.values()), len(counts), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    log10 = lambda w: float(root.log10(np.array([counts[w]]))[0])
    symbols = {w for w, c in counts.items() if c >= suffix_tree.LEAST_COUNT}
    kept, ends = {}, set()

    def after(context, word):
        """log10 of a word after the longest kept suffix of a context (oldest word first)."""
        found = log10(word)
        for n in range(1, len(context) + 1):
            suffix = context[-n:]
            if suffix in kept:
                own, rest = kept[suffix]
                found = own[word] if word in own else found + rest
            if suffix not in open_contexts:
                break
        return found

    open_contexts = set()
    for d in range(1, depth + 1):
        seen = {}
        for i, t in texts.items():
            for at in range(d, len(t)) if not held(i) else ():
                context = tuple(t[at - d : at])
                if symbols.issuperset(context) and (d == 1 or context[1:] in open_contexts):
                    seen.setdefault(context, Counter())[t[at]] += 1
        fresh = {}
        for context, nexts in seen.items():
            inside = {w: n for w, n in nexts.items() if w in symbols and n >= suffix_tree.LEAST_COUNT}
            total = sum(nexts.values())
            if not inside:
                continue
            shorter = {w: after(context[1:], w) for w in inside}
            own = {w: math.log10((n - suffix_tree.DISCOUNT) / total) for w, n in inside.items()}
            clip = lambda x: min(max(x, 1e-9), 1.0)
            rest = math.log10(clip(1 - sum(10**x for x in own.values())) / clip(1 - sum(10**x for x in shorter.values())))
            gain = sum(n * (own[w] - shorter[w]) for w, n in inside.items()) * math.log(10) + (total - sum(inside.values())) * rest * math.log(10)
            if gain >= least_gain * len(inside):
                fresh[context] = (own, rest)
            if not (len(inside) == 1 and sum(inside.values()) == total):
                ends.add(context)
        kept.update(fresh)
        open_contexts |= ends
    scores = {i: sum(after(tuple(t[max(0, at - depth) : at]), w) for at, w in enumerate(t)) for i, t in texts.items()}
    return scores, kept, root, log10


def corpus(n=300):
    """Texts of a small vocabulary with two very common words, repeated passages, rare words and copies."""
    rng = random.Random(5)
    common, passage = ["the", "of"], "one two three four five six seven the of the of end".split()
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.4 else rng.choice("abcdefgh") + rng.choice("uvw") for _ in range(rng.randrange(40))]
        if i % 7 == 0:
            words[5:5] = passage
        if i % 11 == 0:
            words.append(f"Rare{i}")
        rows.append((i, " ".join(words)))
    return rows + [(n + i, rows[3][1]) for i in range(20)]


@pytest.mark.parametrize("options", [{}, {"hot_word": 60, "windows_per_part": 500}, {"depth": 2, "hot_word": 10, "windows_per_part": 100, "least_gain": 1.0}])
def test_score_is_brute_force(spark, options, monkeypatch):
    """Scores are those of a tree kept in dictionaries, whatever words are hot and however many tasks there are."""
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    rows = corpus()
    found = suffix_tree.op1(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    wanted, kept, _, _ = brute_tree({i: words_of(t) for i, t in rows}, held, options.get("depth", suffix_tree.DEPTH), options.get("least_gain", suffix_tree.LEAST_GAIN))
    assert len(found) == len(rows) and max(map(len, kept)) > 1
    for row in found:
        assert row.score == pytest.approx(wanted[row.doc_id], abs=1e-3), row.doc_id


def test_next_words_sum_to_one():
    """After any kept context the probabilities of all training words and the unknown word make at most one."""
    texts = {i: words_of(t) for i, t in corpus()}
    _, kept, root, log10 = brute_tree(texts, lambda i: False, 2, 1.0)
    vocabulary = {w for t in texts.values() for w in t}
    for (word,) in [c for c in kept if len(c) == 1]:
        own, rest = kept[word,]
        total = sum(10 ** (own[w] if w in own else log10(w) + rest) for w in vocabulary) + 10 ** (rest + math.log10(root.discount * root.types / root.total))
        assert total == pytest.approx(1.0, abs=1e-6)


def test_arrays_survive_the_message():
    for values in ([], [0, 255], [0, 256], [70000, 3], [1 << 40, 2], [-5, 7]):
        assert suffix_tree.unzipped(suffix_tree.zipped(np.array(values, np.int64), np.array([0.5, np.nan])))[0].tolist() == values


def test_repetition_scores_higher_than_base(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 30) for i in range(60)]
    found = suffix_tree.op1(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert found and all(r.score > r.base_score for r in found)


def test_toxicity_learns_from_labels(spark, awkward, empty):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[7], words[20] = "moron", rng.choice(["grobfink", "slurpel"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.op3(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert found and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert sum(r.predicted == r.toxic for r in found) >= 0.97 * len(found)
    assert toxicity.op3(awkward, labels).count() == len(AWKWARD)
    assert toxicity.op3(empty, labels.limit(0)).count() == 0


def test_lexicon_is_mined_from_all_labelled_texts(spark):
    """Texts that only share a vocabulary are no copies, near copies are, and the lexicon is not bounded by the sample."""
    rng = random.Random(4)
    shared = [f"vocabulary{i}" for i in range(40)]
    rows = []
    for i in range(400):
        words = [*rng.sample(shared, 40), *(f"w{rng.randrange(60)}" for _ in range(20))]
        rows.append((i, " ".join([*words, "slurpel"] if i % 4 == 0 else words)))
    copied = " ".join(f"c{i}" for i in range(300)) + " grobfink"
    rows += [(i, f"{copied} {i}") for i in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i >= 400)) for i, _ in rows], "doc_id long, toxic int")
    _, lexicon, _, _ = toxicity.fit(docs, labels, toxic_rows=5, clean_rows=15)
    assert "slurpel" in lexicon and "grobfink" not in lexicon


def test_language_on_held_out_rows(spark, awkward, empty):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    found = langid.op9(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    rows = langid.op9(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert langid.op9(empty).count() == 0
    kept = langid.accepted(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 7})


def test_mixing_meets_targets(spark, awkward, empty):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    found = mixing.op4(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in found)
    tokens = Counter()
    for r in found:
        tokens[r.domain] += r.rate * r.n_tokens
    for domain, share in mixing.TARGETS.items():
        assert tokens[domain] / sum(tokens.values()) == pytest.approx(share, abs=0.03)
    assert mixing.op4(awkward).count() == len(AWKWARD)
    assert mixing.op4(empty).count() == 0
    assert mixing.mixed(awkward, awkward).columns == awkward.columns


def test_pseudonyms_keep_formats_and_links(spark):
    text = "card 4111 1111 1111 1111, ssn 078-05-1120, ip 192.168.0.1, born 1970-02-28, mail jo.doe@example.com, again 4111111111111111; not 4111 1111 1111 1112"
    rows = [(1, text, "x"), (2, "4111-1111-1111-1111", "y"), (3, None, "z"), (4, "", "z"), (None, "no data", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = pii.pseudonymised(docs, b"key")
    assert out.columns[-1] == "found"
    by_id = {r.doc_id: r for r in out.collect()}
    kinds = Counter(f.kind for f in by_id[1].found)
    assert kinds == {"card": 2, "ssn": 1, "ip": 1, "date": 1, "email": 1}
    cards = ["".join(c for c in f.pseudonym if c.isdigit()) for i in (1, 2) for f in by_id[i].found if f.kind == "card"]
    assert len(set(cards)) == 1 and pii.luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert "4111 1111 1111 1112" in by_id[1].text and "4111 1111 1111 1111" not in by_id[1].text
    assert by_id[3].text is None and by_id[4].text == "" and by_id[None].text == "no data"
    back = pii.pseudonymised(out.select("doc_id", "text"), b"key", undo=True)
    assert {r.doc_id: r.text for r in back.collect()}[1] == text


def test_feistel_is_a_permutation():
    feistel = pii.Feistel(b"k")
    for size in (1, 2, 7, 100, 1000):
        image = [feistel.permute(i, size, "t") for i in range(size)]
        assert sorted(image) == list(range(size)) and [feistel.permute(x, size, "t", True) for x in image] == list(range(size))


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 8)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1150, [float("inf")] * 8), (700, vectors[0].tolist())]
    found = topk.op10(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    usable = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:700] + rows[-1:]}
    expected = []
    for q in (i for i in usable if i % 50 == 0):
        ranked = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:5]
        expected += [(q, at, i, -score) for at, (score, i) in enumerate(ranked, 1)]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == sorted(expected)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.op10(few).collect()] == [(0, 1, 1, 131072)]
    assert topk.op10(few.limit(0)).count() == 0


def test_top_k_of_large_components_and_mixed_dimensions(spark):
    """Finite vectors of any size and dimension are searched, in exact integers."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(i, (rng.normal(size=6) * 3e5).round(2).tolist()) for i in range(300, 360)]
    rows += [(i, (rng.normal(size=6) * 2e6).round(2).tolist()) for i in range(360, 410)]
    rows += [(i, rng.normal(size=3).round(2).tolist()) for i in range(410, 470)]
    found = topk.op10(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    usable = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    expected = []
    for q in (i for i in usable if i % 50 == 0):
        products = {i: sum(a * b for a, b in zip(usable[q], v, strict=True)) for i, v in usable.items() if i != q and len(v) == len(usable[q])}
        ranked = sorted((-score, i) for i, score in products.items())[:5]
        expected += [(q, at, i, -score) for at, (score, i) in enumerate(ranked, 1)]
    assert max(abs(e[3]) for e in expected) > 1 << 53
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == expected
    with pytest.raises(Exception, match="64 bits"):
        topk.op10(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_pipeline_stages(spark):
    docs = queries.documents(spark, DATA)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns
        rows = after.count()
        assert 0 < rows <= kept.count(), name
        kept = after
    texts = [r.text for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    totals = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert len(totals) == len(texts) and all(r.n == r["all"] for r in totals)
