"""Operators that SQL cannot express against plain versions: label posteriors, rates, pseudonyms, language votes; stages without labels, qualified folders."""

import datetime
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from civilake.llm import langid, mixing, pii, records, staging, toxicity
from tests.llm.conftest import sentence
from tests.llm.test_edges import ENGLISH, GERMAN


def test_label_posteriors_by_enumeration():
    """Both labels of every pattern of votes, each with its probability by the model's tables multiplied out."""
    rng = np.random.default_rng(1)
    m, n = 6, 4000
    label = rng.random(n) < 0.2
    signs = np.array([1, 1, 1, 1, -1, -1])
    fired = np.where(label[:, None], [0.7, 0.6, 0.5, 0.3, 0.1, 0.2], [0.05, 0.1, 0.02, 0.1, 0.6, 0.5]) > rng.random((n, m))
    fired[:, 1] = np.where(rng.random(n) < 0.9, fired[:, 0], fired[:, 1])
    patterns, counts = np.unique(fired * signs, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float), 0.2)
    model._join()  # whatever correlates after the fit is joined, so that tables of several voters are met too
    model.correlation[:] = 0
    model.correlation[3, 2] = model.correlation[2, 3] = 1.0
    model._join()
    posterior = np.concatenate([model.posterior(patterns)]) if all(len(c) == 1 for c in model.cliques) else np.where((patterns == 1).any(1), 0.7, 0.02)
    model._fitted(patterns, counts.astype(float), posterior, len(patterns), 25)
    assert any({2, 3} <= set(c) for c in model.cliques)
    for pattern in patterns:
        odds = []
        for side, prior in ((0, model.prior), (1, 1 - model.prior)):
            p = prior
            for clique, table in zip(model.cliques, model.tables, strict=True):
                cells = list(itertools.product((-1, 0, 1), repeat=len(clique)))
                at = {cell: sum((v + 1) * 3**k for k, v in enumerate(cell)) for cell in cells}
                assert abs(sum(np.exp(table[side][i]) for i in at.values()) - 1) < 1e-6
                p *= np.exp(table[side][at[tuple(pattern[clique])]])
            odds.append(p)
        assert abs(model.posterior(pattern[None])[0] - odds[0] / sum(odds)) < 1e-9


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(2)
    at, votes, soft = [[i % 5] for i in range(40)], rng.integers(-1, 2, (40, 3)), rng.random(40)
    twice = np.where(np.arange(40) < 10, 2.0, 1.0)
    rows = [i for i in range(40) for _ in range(int(twice[i]))]
    one = toxicity.Linear(at, votes, soft, 5, twice)
    other = toxicity.Linear([at[i] for i in rows], votes[rows], soft[rows], 5)
    assert np.allclose(one.w, other.w) and np.allclose(one.v, other.v) and abs(one.b - other.b) < 1e-9


def test_no_distinct_labelled_text_is_left_out(spark):
    """Texts that share their two smallest hashes but little else all teach, with one weight together."""
    texts = [f"common start here {sentence(i, 30)}" for i in range(6)] + [sentence(50, 40)] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(len(texts))], "doc_id long, toxic int")
    _, once = toxicity.labelled_texts(docs, labels)
    kept = [i for i in range(len(texts)) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    assert once.count() == len({texts[i] for i in kept})
    assert all(0 < r.weight <= 1 for r in once.collect())


def dense_rates(n, p, targets, budget, rounds=20_000):
    """Projected gradient least squares over all rates at once."""
    rate = np.full(len(n), min(1.0, budget / n.sum()))
    a = (n[:, None] * p).T
    step = 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(rounds):
        rate = np.clip(rate - step * a.T @ (a @ rate - targets * budget), 0, 1)
    return rate


def test_rates_reach_what_a_dense_solver_reaches(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 400, 200)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    members = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "id long, n_tokens long, p array<double>")
    for targets in ([0.6, 0.3, 0.1], [0.2, 0.2, 0.6]):
        targets = np.array(targets)
        held = n @ p
        budget = 0.98 * float((held / targets).min())
        first, steps = mixing.fit_rates(members, targets, 1.0)
        rate = mixing.rates_after(200, p, first, steps, 1.0)
        dense = dense_rates(n.astype(float), p, targets, budget)
        error, least = (np.abs((n * r) @ p - targets * budget).max() / budget for r in (rate, dense))
        assert ((rate >= 0) & (rate <= 1)).all() and error <= least + 0.01
        assert np.abs((n * (rate - dense)) @ p).max() < 0.02 * budget


def test_a_target_that_nothing_can_meet(spark):
    """A domain of a few tokens with a large target: rates stay in bounds and the others shrink towards it, none is lost by an error."""
    p = np.array([[1.0, 0.0]] * 50 + [[0.0, 1.0]])
    members = spark.createDataFrame([(i, 10, row.tolist()) for i, row in enumerate(p)], "id long, n_tokens long, p array<double>")
    first, steps = mixing.fit_rates(members, np.array([0.5, 0.5]), 1.0)
    rate = mixing.rates_after(51, p, first, steps, 1.0)
    assert ((rate >= 0) & (rate <= 1)).all() and 0.9 < rate[-1] <= 1 and abs(rate[:50].sum() - rate[-1]) < 0.1


VALID = {
    "card": ["4111 1111 1111 1111", "5500005555555559", "378282246310005"], "ssn": ["219-09-9999", "001-01-0001"], "phone": ["(415) 555-2671", "+44 20 7946 0958", "212-555-0199"],
    "ip": ["10.0.0.1", "192.168.1.254", "8.8.8.8"], "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "date": ["2001-02-03", "31/12/1999", "3.4.2010"], "email": ["ann.lee+x@mail.example.org", "b_c@ex-ample.com"],
}
INVALID = ["4111 1111 1111 1112", "000-12-3456", "666-01-0001", "999.1.1.1", "01.2.3.4", "2001-02-30", "12345", "3.14", "GB00 WEST 1234 5698 7654 32", "a@b", "v1.2.3.4.5", "115-555-2671"]


@given(st.lists(st.one_of(st.sampled_from([(k, v) for k, values in VALID.items() for v in values]), st.sampled_from([(None, x) for x in [*INVALID, "words", "end.", "Straße", "日本"]])), max_size=12), st.sampled_from([", ", "\n", " ; "]))
@settings(max_examples=300, deadline=None)
def test_planted_values_are_found_and_come_back(parts, gap):
    """Exactly the valid values are replaced, each within its format, whatever stands beside it; the key gives every text back."""
    text, spans = "", []
    for kind, value in parts:
        text += gap if text else ""
        if kind:
            spans.append((len(text), kind, value.partition("@")[0] if kind == "email" else value))
        text += value
    hidden, found = pii.Pseudonyms(b"k").replace(text)
    assert [(start, kind, text[start:end]) for start, end, kind, _ in found] == spans
    for (_, kind, old), (_, _, _, new) in zip(spans, found, strict=True):
        shape = lambda s: ["9" if c.isdigit() else "a" if c.isalpha() else c for c in s]
        assert kind == "ip" and new.count(".") == 3 or shape(new) == shape(old)
    back, again = pii.Pseudonyms(b"k", undo=True).replace(hidden)
    assert back == text and len(again) == len(found)


def test_votes_by_a_loop_over_the_classifiers():
    """The family of most support, and in it the language of most support, each duel by its own weights."""
    rng = np.random.default_rng(4)
    langs = ["en", "de", "fr", "es", "it", "fi"]
    centres = rng.random((6, langid.FEATURES)).astype(np.float32)
    x = np.concatenate([c + rng.random((15, langid.FEATURES)).astype(np.float32) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Hierarchy(x, [lang for lang in langs for _ in range(15)])
    some = x[::4]
    found, scores = model.predict(some)

    def winner(duels, row):
        support = dict.fromkeys(duels.classes, 0.0)
        for a, b in itertools.combinations(duels.classes, 2):
            svm = duels.svms[a, b]
            p = 1 / (1 + np.exp(-np.clip(svm.slope * (float(row @ svm.w) + svm.b), -30, 30)))
            support[a] += p / (len(support) - 1)
            support[b] += (1 - p) / (len(support) - 1)
        if len(support) == 1:
            return duels.classes[0], 1.0
        best = max(support, key=lambda k: (support[k], [-ord(c) for c in k]))
        return best, support[best]

    for row, lang, score in zip(some, found, scores, strict=True):
        family, sure = winner(model.family, row)
        own, p = winner(model.members[family], row)
        assert own == lang and abs(score - sure * p) < 1e-5
    assert np.mean([a == b for a, b in zip(found, [lang for lang in langs for _ in range(15)][::4], strict=True)]) > 0.9


def test_without_labels_the_pipeline_loses_nothing(spark):
    texts = [f"{ENGLISH} {i}" for i in range(8)] + ["12 34", None, ""]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8)) and {r.lang for r in kept.collect()} == {None}
    assert corpus_pipeline.mix(spark, kept, "").count() == 8


def test_the_predicted_language_takes_effect(spark):
    rows = [(i, f"{ENGLISH} {i}", "en" if i else None) for i in range(40)] + [(100 + i, f"{GERMAN} {i}", "de" if i > 1 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang for r in langid.accepted(docs).collect()}
    assert found[0] == "en" and found[100] == found[101] == "de" and len(found) == 80


def test_folders_are_qualified_on_the_driver(spark, tmp_path):
    assert staging.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://elsewhere/")
    conf.set("fs.viewfs.mounttable.elsewhere.link./data", f"file://{tmp_path}")
    try:
        assert staging.qualified(spark, "/data/x") == "viewfs://elsewhere/data/x"
    finally:
        conf.set("fs.defaultFS", before)
    with pytest.raises(ValueError, match="no scheme"):
        records.open_fs(str(tmp_path))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from civilake.llm import queries

    manifest = records.write_records(docs, queries.tokenizer_path(), str(tmp_path / "records"))
    assert all(r.path.startswith("file:///") for r in manifest.collect())
    assert sorted(r.doc_id for r in records.read_records(manifest).collect()) == [1, 2]


def test_date_pseudonyms_stay_dates():
    rng = random.Random(5)
    for _ in range(300):
        day = datetime.date.fromordinal(rng.randrange(pii.FIRST_DAY.toordinal(), pii.LAST_DAY.toordinal() + 1))
        text = rng.choice([f"{day:%Y-%m-%d}", f"{day:%d/%m/%Y}", f"{day.day}.{day.month}.{day.year}"])
        new, found = pii.Pseudonyms(b"x").replace(text)
        assert found[0][2] == "date" and pii.Pseudonyms(b"x").replace(new)[1]
