"""Defined results at the edges: copies, clashing names, dates of every notation, session settings, caches."""

import datetime
import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from civilake.llm import langid, mixing, packing, pii, queries, records, simhash, staging, tokens, topk, toxicity
from tests.llm.conftest import AWKWARD, sentence

GERMAN = "der hund läuft über die straße und das kind spielt im garten mit einem ball wir gehen heute zur schule nummer"
ENGLISH = "the dog runs over the street and the child plays in the garden with a ball we go to school today number"


def test_copied_texts_keep_their_language(spark):
    """A language made of one copied text is learnt and predicted like any other."""
    rows = [(i, ENGLISH, "en") for i in range(3000)] + [(10_000 + i, f"{GERMAN} {i}", "de") for i in range(500)] + [(20_000, "une phrase française écrite avec élégance", "fr"), (20_003, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = dict(langid.op9(docs).where("lang_pred <> 'und'").join(docs, "doc_id").where("lang <> 'fr'").groupBy("lang", "lang_pred").count().select("lang", "lang_pred").collect())
    assert found == {"en": "en", "de": "de"}
    mixed = mixing.mix(docs, docs, {"en": 0.5, "de": 0.5})
    assert {r.domain for r in mixed.where("id < 20000").select("domain").distinct().collect()} == {"en", "de"}
    assert mixing.mix(docs.where("doc_id = 20000"), docs, {"en": 0.5, "de": 0.5}).first().domain is None


def test_without_labels_tokens_are_counted(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", None), (3, "two words", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.n_tokens, r.rate, r.copies) for r in mixing.op4(rows).collect()} == {1: (0, 1.0, 1), 2: (0, 1.0, 1), 3: (2, 1.0, 1)}


def test_clashing_columns_stay(spark):
    """Columns named as the operators name theirs come out of the stages unchanged."""
    rows = [(i, f"{ENGLISH} {i} {sentence(i, 30)}", "en", -5.0, "kept", True, f"r{i}", 3) for i in range(30)]
    schema = "doc_id long, text string, lang string, score double, lang_pred string, toxic boolean, __id string, size int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all((r.score, r.lang_pred, r.toxic, r["__id"]) == (-5.0, "kept", True, f"r{r.doc_id}") for r in out.collect()), name
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.op3(docs, labels).count() == 30
    vectors = spark.createDataFrame([(0, [1.0], 9, "x"), (1, [2.0], 9, "y")], "vec_id long, embedding array<double>, dim int, grp string")
    assert topk.op10(vectors).count() == 1


def test_stages_on_empty_and_awkward_tables(spark, awkward, empty):
    kept = {"language_id": lambda i, t: any(c.isalpha() for c in t or "")}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        out = stage(spark, awkward, "")
        if name in kept:
            assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, t in AWKWARD if kept[name](i, t))
        else:
            assert out.count() > 0
    near = corpus_pipeline.near(spark, awkward, "").collect()
    groups = {}
    for i, t in AWKWARD:
        groups.setdefault(simhash.fingerprint(t), []).append(i)
    lone = {min(x for x in ids if x is not None) for ids in groups.values() if any(x is not None for x in ids)}
    assert {r.doc_id for r in near if r.doc_id is not None} <= lone  # fingerprints within the radius may join further


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    """What the pipeline returns over a small table is what its rules say, document by document."""
    rows = [(i, f"{ENGLISH} {sentence(i, 60)}", "en") for i in range(40)] + [(100 + i, f"{ENGLISH} {sentence(i, 60)}", "en") for i in range(5)] + [(200, "12345", None), (201, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    found = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    letters = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    unique = {}
    for i, t in letters.items():
        unique[t] = max(unique.get(t, -1), i)
    left = {i: simhash.fingerprint(letters[i]) for i in unique.values()}
    chosen = set(left)
    for i in sorted(left):
        group, todo = {i}, [i]
        while todo:
            one = todo.pop()
            close = {j for j in left if j not in group and (left[j] ^ left[one]).bit_count() <= 4}
            group |= close
            todo += close
        chosen -= group - {min(group)}
    rates = {r.doc_id: 1 for r in mixing.mixed(spark.createDataFrame([(i, letters[i], "en") for i in chosen], "doc_id long, text string, lang string"), spark.createDataFrame([(i, letters[i], "en") for i in chosen], "doc_id long, text string, lang string")).collect()}
    assert found == set(rates) and found <= chosen


NOTATIONS = ("{y:04d}-{m:02d}-{d:02d}", "{y:04d}/{m}/{d}", "{d:02d}.{m:02d}.{y:04d}", "{d}/{m}/{y:04d}", "{m:02d}/{d:02d}/{y:04d}", "{m}-{d}-{y:04d}")


def test_dates_of_every_notation_come_back():
    """Over 1900-2099 each notation is permuted one to one, undone exactly, and linked with the others."""
    do, undo = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(0, 73_049, 7)]
    image = {}
    for notation in NOTATIONS:
        seen = set()
        for day in days:
            text = notation.format(y=day.year, m=day.month, d=day.day)
            new, spans = do.replace(text)
            assert len(spans) == 1 and undo.replace(new)[0] == text, text
            if not notation.startswith("{m") or day.day > 12:
                assert new not in seen
                seen.add(new)
        first = notation.format(y=2001, m=11, d=25)
        image[notation] = "".join(sorted(c for c in do.replace(first)[0] if c.isdigit()))
    assert len(set(image.values())) == 1


def test_validated_numbers_only():
    do = pii.Pseudonyms(b"k")
    for text in ("1٢٣-٤٥٦-٧٨٩٠", "000-000-0000", "155-555-0123", "2001-13-01", "1899-12-31", "4111 1111 1111 1112", "999.1.1.1"):
        assert do.replace(text) == (text, []), text
    new, _ = do.replace("+1 (212) 555-0187")
    assert new.startswith("+1 (") and new[4] in "23456789" and new[9] in "23456789" and pii.Pseudonyms(b"k", True).replace(new)[0] == "+1 (212) 555-0187"


def test_pseudonyms_of_long_and_repeated_rows(spark, awkward, empty):
    text = "call 212-555-0187 now " * 5000
    docs = spark.createDataFrame([(1, text), (1, text), (2, "born 1970-02-28")], "doc_id long, text string")
    out = pii.op7(docs, b"key").collect()
    long_rows = [r for r in out if r.doc_id == 1]
    assert len(long_rows) == 2 and long_rows[0].text == long_rows[1].text and long_rows[0].n_found == 5000
    assert len({f.pseudonym for f in long_rows[0].found}) == 1
    assert pii.op7(awkward, b"key").count() == len(AWKWARD) and pii.op7(empty, b"key").count() == 0


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert staging.shared_dir(Session()).startswith("file:///") and staging.shared_dir(Session()) == staging.shared_dir(Session())


def test_scratch_removes_what_was_staged(spark):
    path = staging.fresh_path(spark, "stays")
    with staging.scratch(spark):
        inner = staging.staged(spark.range(3), "goes").inputFiles()[0]
        staging.staged(spark.range(3), "", path)
    assert not os.path.exists(inner.removeprefix("file://")) and spark.read.parquet(path).count() == 3


def test_spaceless_chunks_do_not_fill_the_cache():
    encoder = tokens.ChunkEncoder(queries.tokenizer_path(), limit=100_000)
    for at in range(30):
        texts = ["語" * (500 + at) + str(i) for i in range(20)] + [f"word{at}x{i}" for i in range(200)]
        assert len(list(encoder.encode(texts))) == len(texts)
    assert all(len(chunk) <= tokens.LONG_CHUNK for chunk in [*encoder.new, *encoder.old])
    assert len(encoder.new) + len(encoder.old) < 2 * (100_000 // tokens.ENTRY_BYTES) + 500


def test_padding_is_small(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    rows = packing.pack(docs, queries.tokenizer_path(), 2048).groupBy("sequence_id").sum("length").collect()
    used = sum(r[1] for r in rows)
    full = sum(r[1] if r[1] & (r[1] - 1) == 0 else 2048 for r in rows)
    assert full <= 1.02 * used or len(rows) == -(-used // 2048)


def test_several_files_a_shard(spark, monkeypatch):
    monkeypatch.setattr(records, "SHARD_BYTES", 2000)
    writer = records.ShardWriter(staging.fresh_path(spark, "shards"), 3)
    for i in range(50):
        writer.write(i, np.arange(i, dtype="<u2").tobytes(), 2)
    writer.close()
    assert len(writer.done) > 1 and sum(row[4] for row in writer.done) == 50
    number, first = 0, writer.done[1]
    assert records.read_at(first[3], [number])[0][0] == writer.done[0][4]


def test_correlated_voters_are_modelled_together():
    """Two copies of one voter make a clique and do not count twice."""
    rng = np.random.default_rng(0)
    label = rng.random(4000) < 0.2
    vote = lambda hit, false: np.where(label, rng.random(4000) < hit, rng.random(4000) < false).astype(int)
    one, other, third = vote(0.8, 0.05), vote(0.7, 0.05), vote(0.75, 0.1)
    patterns, counts = np.unique(np.c_[one, one, other, third], axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float), 0.2)
    assert any({0, 1} <= set(clique) for clique in model.cliques) and model.correlation[0, 1] > 0.9
    p = model.posterior(np.array([[1, 1, 0, 0], [1, 1, 1, 1], [0, 0, 0, 0]]))
    assert p[2] < 0.1 and p[1] > 0.95 and 0.05 < p[0] < 0.8  # the true posterior is 0.23; counted twice, one voter would make it 0.83
    assert 0.4 < model.accuracy[0] <= 1


def test_a_threshold_score_is_toxic(spark):
    linear = toxicity.Linear([], np.zeros((0, len(toxicity.VOTERS)), int), np.zeros(0), 0)
    rows = spark.createDataFrame([(1, 0, [])], "tag long, mask int, at array<int>")
    exact = toxicity.score(rows, linear).first().score
    assert toxicity.score(rows, linear, threshold=exact).first().predicted == 1
