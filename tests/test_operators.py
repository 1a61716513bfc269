"""Rules, merges, sources and streams on small literal inputs."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from civilake.functions import bills, polls, text
from civilake.operators import joins, merge, ordering, retrieval
from civilake.operators import polls as poll_ops
from civilake.sources import envelopes, html
from civilake.streaming import changes


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cross_tab_cells(spark):
    row = F.array(*(F.lit(c) for c in ("전체", None, "(1007)", "(1007)", "52.4", "abc", "30.0")))
    assert value(spark, polls.percentages(row, 4)) == [52.4, 30.0]
    assert value(spark, polls.percentages(F.array(*(F.lit(c) for c in ("전체", "150.0", "52.4", "-5.0", "30.0"))), 1)) == [52.4, 30.0]
    assert value(spark, polls.bunched_percentages(F.lit("46.3 13.9 9.8 25.1 4.9"))) == [46.3, 13.9, 9.8, 25.1, 4.9]
    counts = [value(spark, polls.sample_count(F.lit(c).cast("string"))) for c in ("(1,007)", "사례수 (500) 명", "abc", "", None)]
    assert counts == [1007, 500, None, None, None]
    for marker in ("[ 전 체 ]", "▣ 전 체 ▣", "전체"):
        grid = F.array(F.array(F.lit("구분"), F.lit("x")), F.array(F.lit(marker), F.lit("1")))
        assert value(spark, polls.total_row(grid)) == [marker, "1"]
    kept = value(spark, polls.without_summaries(F.array(F.lit("민주당"), F.lit("(합)"), F.lit("국민의힘")), F.array(F.lit(50.0), F.lit(80.0), F.lit(30.0))))
    assert [(p.option, p.pct) for p in kept] == [("민주당", 50.0), ("국민의힘", 30.0)]


def test_poll_overview(spark):
    rows = [(1, 1, "더불어 민주당", 42.5), (1, 2, "국민의힘", 36.2), (1, 3, "지지정당 없음", 9.3), (1, 4, "모름", 5.1), (1, 5, "무응답", 1.2)]
    options = spark.createDataFrame(rows, "s int, option_id int, name string, pct double")
    folded = poll_ops.folded_options(options, ["s"], "name", "pct", polls.party_name(F.col("name")))
    top = poll_ops.leaders(folded, ["s"]).first()
    assert (top.leader, top.leader_pct, round(top.undecided, 2), round(top.gap, 2)) == ("더불어민주당", 42.5, 15.6, 6.3)


@pytest.mark.parametrize(
    ("now", "then", "allowed"),
    [("접수", "NewStage", True), ("OldStage", "접수", True), ("접수", "소관위접수", True), ("접수", "공포", True), ("소관위접수", "접수", False), ("접수", "접수", False)],
)
def test_stage_order(spark, now, then, allowed):
    assert value(spark, bills.can_update_stage(F.lit(now), F.lit(then))) is allowed


def test_text_rules(spark):
    assert value(spark, text.shortened(F.lit("가 " * 100))).endswith("...")
    assert value(spark, text.brief_summary(F.lit("제안이유\n\n 첫 줄 \n둘째"), F.lit("이름"), F.lit(""))) == "첫 줄"
    assert value(spark, text.without_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, text.first_text(F.lit("  "), F.lit(""), F.lit("x"))) == "x"
    assert value(spark, retrieval.uuid5(F.lit(str(uuid.NAMESPACE_DNS)), F.lit("bill-1"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "bill-1"))


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", "s", 5), (2, "b", None, 6)], "id int, stage string, summary string, views int")
    new = spark.createDataFrame([(2, None, "t"), (3, "c", None)], "id int, stage string, summary string")
    rows = merge.upsert(old, new, ["id"], overwrite=("stage",), fill=("summary",), on_insert={"views": F.lit(0)}).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "s", 5), (2, None, "t", 6), (3, "c", None, 0)]
    assert merge.upsert(old.limit(0), new.limit(0), ["id"]).count() == 0


def test_relations_on_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v string, o int")
    assert ordering.page(none, [F.asc("k")], 0, 5).count() == 0
    assert ordering.first_per(none, ["k"], [F.asc("o")]).count() == 0
    assert joins.exists_flag(none, none, ["k"], "there").count() == 0
    assert merge.changed(none, "k", "o", "v").count() == 0
    assert merge.toggled(none, ["k"], "o").count() == 0


def test_gap_clusters(spark):
    xs = [1.0, 2.0, 30.0, 31.0, 33.0, 80.0]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "g int, i int, x double")
    found = ordering.gap_clusters(rows, ["g"], "x", "i", 3, 10.0).orderBy("i").collect()
    assert [r.cluster for r in found] == [0, 0, 1, 1, 1, 2]


def test_html_tables(spark):
    page = "<table><tr><th>기관<td>A &amp; B</tr><tr><th>표본</th><td> 1,000 \n 명</td></tr></table><table><tr><td>x</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "no table")], "page_id long, html string")
    rows = html.table_rows(pages, "page_id", "html")
    assert [(r.table_no, r.row_no, [c.text for c in r.cells]) for r in rows.orderBy("table_no", "row_no").collect()] == [
        (0, 0, ["기관", "A & B"]), (0, 1, ["표본", "1,000 명"]), (1, 0, ["x"]),
    ]
    assert {(r.label, r.value) for r in html.header_pairs(rows, "page_id").collect()} == {("기관", "A & B"), ("표본", "1,000 명")}


def test_envelopes(spark, tmp_path):
    good = json.dumps({"bills": [{"head": [{"list_total_count": 2}, {"RESULT": {"CODE": "INFO-000", "MESSAGE": "ok"}}]}, {"row": [{"id": "a", "n": 1}, {"id": "b", "n": None}]}]})
    none = json.dumps({"RESULT": {"CODE": "INFO-200", "MESSAGE": "no data"}})
    bad = json.dumps({"RESULT": {"CODE": "ERROR-300", "MESSAGE": "key"}})
    pages = spark.createDataFrame([(good,), (none,)], "body string")
    assert [tuple(r) for r in envelopes.envelope_rows(pages, "bills", "id string, n int").orderBy("id").collect()] == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="ERROR-300"):
        envelopes.envelope_rows(spark.createDataFrame([(bad,)], "body string"), "bills", "id string, n int").collect()
    xml = "<r xmlns:n='u'><code>00</code><items><item n:a='1'><id>1</id></item><item><id>2</id></item></items></r>"
    answers = spark.createDataFrame([(xml,), (xml.replace("00", "99"),)], "body string")
    assert sorted(r.id for r in envelopes.xml_items(answers, "items.item", "id int", "r/code").collect()) == [1, 2]
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\nnot json\n\n')
    lines = {r.id: r.malformed for r in envelopes.result_lines(spark, str(tmp_path / "x.jsonl"), "id string").collect()}
    assert lines == {"a": None, None: "not json"}


def test_stream_equals_batch(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    rows = [
        {"txn_id": 1, "table": "Bill", "op": "u", "before": {"id": "b1", "stage": "접수"}, "after": {"id": "b1", "stage": "공포"}},
        {"txn_id": 2, "table": "Bill", "op": "u", "before": {"id": "b1", "stage": "공포"}, "after": {"id": "b1", "stage": "공포"}},
        {"txn_id": 3, "table": "Congressman", "op": "u", "before": {"id": "m1"}, "after": {"id": "m1", "party_id": "2"}},
        {"txn_id": 4, "table": "RepresentativeProposer", "op": "c", "after": {"id": "m1"}},
        {"txn_id": 5, "table": "Bill", "op": "u", "after": {"stage": "x"}},
    ]
    for i, row in enumerate(rows):
        (landed / f"{i}.json").write_text(json.dumps(row))
    followers = spark.createDataFrame([("b1", 7), ("b1", 8), ("m1", 9)], "target string, user_id int")
    stream = changes.notifications(changes.watched(changes.read_changes(spark, str(landed)), "id"), followers)
    keys = ["txn_id", "event", "target", "user_id"]
    streamed = changes.run_to_end(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check", keys)
    batch = changes.notifications(changes.watched(spark.read.schema(changes.CHANGE).json(str(landed)), "id"), followers)
    assert sorted(map(tuple, streamed.select(*keys).collect())) == sorted(map(tuple, batch.select(*keys).collect()))
    assert sorted(map(tuple, streamed.select("txn_id", "event", "user_id").collect())) == [
        (1, "BILL_STAGE_UPDATE", 7), (1, "BILL_STAGE_UPDATE", 8), (3, "CONGRESSMAN_PARTY_UPDATE", 9), (4, "RP_INSERT", 9),
    ]


def test_batches_of_a_stream_are_merged(spark, tmp_path):
    """Each micro-batch is merged into a table; what is left is the merge of all that landed."""
    landed, table = tmp_path / "landed", f"{tmp_path}/table"
    landed.mkdir()
    for i, (key, n) in enumerate([("a", 1), ("b", 2), ("a", 3)]):
        (landed / f"{i}.json").write_text(json.dumps({"key": key, "n": n, "ord": i}))
    spark.createDataFrame([("a", 0), ("z", 9)], "key string, n int").write.parquet(f"{table}/0")
    versions = [0]

    def put(batch, number):
        old = spark.read.parquet(f"{table}/{versions[-1]}")
        merge.upsert(old, merge.latest(batch, ["key"], "ord").select("key", "n"), ["key"], overwrite=("n",)).write.mode("overwrite").parquet(f"{table}/{number + 1}")
        versions.append(number + 1)

    stream = spark.readStream.schema("key string, n int, ord int").json(str(landed))
    changes.each_batch(stream, f"file://{tmp_path}/check", put).awaitTermination()
    assert dict(spark.read.parquet(f"{table}/{versions[-1]}").collect()) == {"a": 3, "b": 2, "z": 9}


def test_windowed_counts(spark):
    times = spark.createDataFrame([("2024-01-01 00:00:10",), ("2024-01-01 00:00:50",), ("2024-01-01 00:01:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert sorted(r.n for r in changes.windowed_counts(times, "t", "1 minute", "5 minutes").collect()) == [1, 2]


def test_landed_pages_are_read_whole(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r>\n<x>1</x>\n</r>")
    assert [r.body for r in envelopes.raw_pages(spark, str(tmp_path)).collect()] == ["<r>\n<x>1</x>\n</r>"]


def test_plans_use_semi_joins(spark):
    from civilake.plans import relational

    plan = relational.two_hop_semi(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Inner" not in plan.split("LeftSemi")[0]
