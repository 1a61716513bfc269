"""Rules against the plain statements of what they mean, on small literal inputs and random ones."""

import datetime
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civilake.functions import bills, dates, lifecycle, polls, text
from civilake.operators import aggregates, joins, merge, ordering
from civilake.sources import envelopes, html


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stage_fold_is_a_plain_loop(spark):
    """Stages applied one by one leave what the grouped fold says."""
    rng = random.Random(1)
    names = [*bills.STAGES, "재의", "폐기"]
    rows = [(k, i, rng.choice(names)) for k in range(60) for i in range(rng.randrange(1, 12))]
    rng.shuffle(rows)
    found = {r.k: r.s for r in merge.folded_stages(spark.createDataFrame(rows, "k int, i int, s string"), "k", "i", "s", bills.stage_order(F.col("s"))).collect()}
    place = {s: n for n, s in enumerate(bills.STAGES)}
    for key in found:
        now = None
        for _, _, s in sorted(r for r in rows if r[0] == key):
            if now is None or now not in place or s not in place or place[now] < place[s]:
                now = s
        assert found[key] == now


def test_lines_and_clusters_are_plain_loops(spark):
    rng = random.Random(2)
    words = [(p, rng.randrange(30), rng.randrange(200), f"w{i}") for p in range(20) for i in range(rng.randrange(1, 9))]
    table = spark.createDataFrame(words, "p int, y int, x int, w string")
    found = {}
    for row in ordering.lines_of(table, "p", "x", "y", "w").orderBy("p", "line_no").collect():
        found.setdefault(row.p, []).append(row.line)
    clusters = {}
    for row in ordering.gap_clusters(table, ["p"], "x", "w", 3, 10.0).collect():
        clusters.setdefault(row.p, {}).setdefault(row.cluster, set()).add(row.w)
    for page in range(20):
        own = sorted((y, x, w) for p, y, x, w in words if p == page)
        lines, current = [], None
        for y, _, w in own:
            if current is None or abs(y - current) > 3:
                current = y
                lines.append([w])
            else:
                lines[-1].append(w)
        assert found[page] == [" ".join(line) for line in lines]
        along = sorted((x, w) for p, _, x, w in words if p == page)
        if len(along) <= 3:
            expected = [{w} for _, w in along]
        else:
            gaps = sorted(((along[i + 1][0] - along[i][0], -i) for i in range(len(along) - 1)), reverse=True)
            cuts = sorted(-i for gap, i in gaps if gap > 10)[:0] or sorted(-i for gap, i in [g for g in gaps if g[0] > 10][:2])
            bounds = [0, *(c + 1 for c in cuts), len(along)]
            expected = [{w for _, w in along[a:b]} for a, b in zip(bounds, bounds[1:], strict=False)] if len(cuts) == 2 else []
        assert [clusters.get(page, {})[c] for c in sorted(clusters.get(page, {}))] == expected


@given(st.lists(st.sampled_from(['{', '}', '"', '\\', "a", " ", "\n", ":"]), max_size=25))
@settings(max_examples=60, deadline=None)
def test_first_json_object(spark, parts):
    """The first balanced object as a character-by-character reader finds it."""
    source = "".join(parts)
    start, depth, inside, escaped, expected = source.find("{"), 0, False, False, None
    for at in range(start, len(source)) if start >= 0 else ():
        c = source[at]
        if inside:
            inside, escaped = (True, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                expected = source[start : at + 1]
                break
    assert value(spark, text.first_json_object(F.lit(source))) == expected


def test_json_object_with_long_strings(spark):
    """A string of a million characters, with and without escapes, closed or not."""
    for part in ("x" * 1_000_000, '\\"}' * 300_000):
        whole = f'{{"a": "{part}"}}'
        assert value(spark, text.first_json_object(F.lit(f"see {whole} and {{}}"))) == whole
        assert value(spark, text.first_json_object(F.lit(f'{{"a": "{part}'))) is None


@pytest.mark.parametrize(
    ("answer", "found"),
    [('```json\n{"a": {"b": "}"}} tail\n```', '{"a": {"b": "}"}}'), ('text {"x": "\\"{"} more {"y": 1}', '{"x": "\\"{"}'), ("no object", None), ('{"open": 1', None), (None, None)],
)
def test_answers(spark, answer, found):
    assert value(spark, text.first_json_object(text.without_fences(F.lit(answer).cast("string")))) == found


def test_new_names_get_the_next_keys(spark):
    names = [f"n{i:03d}" for i in range(300)]
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names[::3])], "name string, key long")
    found = {r.name: (r.key, r.created) for r in joins.resolve_or_create(spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string"), known, "name", "key", parts=7).collect()}
    fresh = [n for i, n in enumerate(names) if i % 3]
    assert all(found[n] == (i, False) for i, n in enumerate(names[::3]))
    assert [found[n] for n in fresh] == [(99 + i, True) for i in range(1, 201)]


def test_top_and_other_with_nulls(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [(None,)], "k string")
    assert dict(aggregates.top_and_other(rows, "k", 2).collect()) == {"a": 5, "b": 3, "other": 3}


@pytest.mark.parametrize("body", ["not json", json.dumps({"x": [{"head": [{"list_total_count": 1}]}, {"row": []}]}), json.dumps({"RESULT": {"CODE": "INFO-000"}})])
def test_answers_without_a_good_code_fail(spark, body):
    with pytest.raises(Exception, match="x: "):
        envelopes.envelope_rows(spark.createDataFrame([(body,)], "body string"), "x", "id string").collect()


def test_answers_without_rows(spark):
    bodies = [json.dumps({"RESULT": {"CODE": "INFO-200"}}), json.dumps({"other": []}), json.dumps({"x": [{"head": []}]})]
    assert envelopes.envelope_rows(spark.createDataFrame([(b,) for b in bodies], "body string"), "x", "id string").count() == 0


def test_early_stop(spark):
    """A scan ends with the page whose last dated row is too old, and with a short page."""
    pages = [(0, ["2024-03-03", "2024-03-02"]), (1, ["2024-02-20", None]), (2, ["2024-01-05", "2024-01-02"]), (3, ["2024-02-28", "2024-02-27"])]
    table = spark.createDataFrame([(p, [{"day": d, "id": f"{p}{i}"} for i, d in enumerate(days)]) for p, days in pages], "page int, rows array<struct<day:string,id:string>>")
    day = lambda row: F.to_date(row["day"])
    bounds = [F.lit(d).cast("date") for d in ("2024-02-01", "2024-03-02")]
    assert sorted(r.id for r in envelopes.early_stop(table, "page", "rows", day, *bounds, 2).collect()) == ["01", "10"]
    assert sorted(r.id for r in envelopes.early_stop(table.where("page <> 2"), "page", "rows", day, *bounds, 2).collect()) == ["01", "10", "30", "31"]
    assert sorted(r.id for r in envelopes.early_stop(table, "page", "rows", day, *bounds, 3).collect()) == ["01"]


def test_targets_beyond_the_broadcast(spark):
    """However many targets there are, the same records fit."""
    records = spark.createDataFrame([(i, f"r{i % 4}", ["a"], "p") for i in range(40)], "record int, region string, names array<string>, pollster string")
    targets = spark.createDataFrame([(1, "r1", None, None), (2, None, ["a"], ["p"]), (3, "r2", ["b"], None)], "target int, want_region string, want_names array<string>, want_pollsters array<string>")
    fits = polls.matches_target(*(F.col(c) for c in ("region", "names", "pollster", "want_region", "want_names", "want_pollsters")))
    ways = [envelopes.records_for_targets(records, targets, fits, region, most) for region, most in ((None, 10), (("region", "want_region"), 2), (("region", "want_region"), 0), (None, 0))]
    found = [sorted((r.record, r.target) for r in way.collect()) for way in ways]
    assert found[0] == sorted([(i, 1) for i in range(40) if i % 4 == 1] + [(i, 2) for i in range(40)]) and all(f == found[0] for f in found)


def test_lifecycle_example(spark):
    """Three dated stages give three events, the result stands with the plenary, an undated row falls back to its reference, which is its first text, date or not."""
    names = ["BILL_ID", "PPSL_DT", "JRCMIT_PRSNT_DT", "RGS_RSLN_DT", "PROC_DT"]
    rows = spark.createDataFrame([("B1", "2026-04-15", "2026-04-16", "2026.04.17", None), ("B2", " ", None, None, "2026-05-01"), ("B3", None, None, None, None), ("B4", None, None, "soon", "2026-05-01")], ", ".join(f"{n} string" for n in names))
    events = lifecycle.with_events(rows, F.lit("정무위원회"), F.lit("원안가결")).select("BILL_ID", F.inline("events")).collect()
    assert [(e.BILL_ID, e.stage, str(e.day), e.result) for e in events] == [
        ("B1", "접수", "2026-04-15", None), ("B1", "위원회 심사", "2026-04-16", None), ("B1", "본회의 심의", "2026-04-17", "원안가결"), ("B2", "접수", "2026-05-01", None),
    ]


def test_dates_and_labels(spark):
    assert value(spark, dates.rfc_2822(F.lit("Mon, 01 Jan 2024 09:00:00 +0900"))) == datetime.datetime(2024, 1, 1)
    assert value(spark, dates.rfc_2822(F.lit("yesterday"))) is None
    assert value(spark, dates.survey_times(F.lit("2024-01-02 9시 0분~18시 0분, 2024-01-03 10시 0분 ~ 12 시 30 분"))) == ["2024-01-02 9시 0분~18시 0분", "2024-01-03 10시 0분 ~ 12 시 30 분"]
    assert value(spark, text.text_list(F.lit(" a, b ,,c"))) == ["a", "b", "c"]
    assert [value(spark, text.last_number(F.lit(x), 22)) for x in ("제21대 3", "none")] == [3, 22]
    assert value(spark, lifecycle.batch_state(F.lit("JOB_STATE_SUCCEEDED"))) == "COMPLETED"
    assert value(spark, html.plain(F.lit("<b>a</b> &amp;lt; b"), 5)) == "a &lt"


def test_undecided_words_in_any_spacing(spark):
    for name, expected in (("지지 정당 없음", True), ("잘 모르겠다", True), ("그 외 정당", True), ("국민의힘", False), (None, False)):
        assert value(spark, polls.is_undecided(F.lit(name).cast("string"))) is expected


def each(spark, f, inputs):
    """A Column function over some literals."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_rules_on_literals(spark):
    assert each(spark, text.safe_int, ["1,234", "77.0", "n/a", "", None, " 42 "]) == [1234, 0, 0, 0, 0, 42]
    assert each(spark, text.bill_number, ["77.0", " 2100001 ", "", None]) == ["77", "2100001", None, None]
    assert each(spark, polls.party_name, ["더불어 민주당", " 국민의 힘", "새 정당", None, "진보당"]) == ["더불어민주당", "국민의힘", "새 정당", "", "진보당"]
    assert each(spark, polls.question_kind, ["귀하의 지지 정당은", "후보 적합도 조사", "가상 대결 A 대 B", "직무 평가", None]) == ["PARTY_SUPPORT", "CANDIDATE_FIT", "MATCHUP", "OTHER", "OTHER"]
    entries = ["전국 대통령선거", "서울특별시 전체 시장선거", "경기도 수원시 시장선거", "부산광역시 교육감선거", "무제"]
    assert each(spark, lambda c: polls.title_region(c)[0], entries) == ["전국", "서울특별시 전체", "경기도 수원시", "부산광역시", ""]
    assert each(spark, lambda c: polls.title_region(c)[1], entries) == ["대통령선거", "시장선거", "시장선거", "교육감선거", "무제"]
    names = ["도로법 개정안(김철수의원 등 10인)", "예산안(정부)", "세법(대안)", "무제"]
    assert each(spark, bills.bare_name, names) == ["도로법 개정안", "예산안", "세법", "무제"]
    assert each(spark, bills.proposers_in_name, names) == ["김철수의원 등 10인", "정부", "대안", None]
    assert each(spark, bills.member_names, names) == [["김철수"], [], [], []]
    assert each(spark, bills.without_alternative, ["도로법(대안)", "세법 개정안(김철수의원 등 10인)", "예산안"]) == ["도로법", "세법 개정안(김철수의원 등 10인)", "예산안"]
    assert each(spark, text.text_list, ["a, b ,,c", "one", "", None, " x , "]) == [["a", "b", "c"], ["one"], [], [], ["x"]]
    assert each(spark, lambda c: text.last_number(c, 22), ["제22대", "대수 21 (22)", "없음", "20대 국회 3차"]) == [22, 22, 22, 3]
    assert each(spark, polls.region_label, ["서울특별시", "강원특별자치도", "전북특별자치도", "전국", ""]) == ["서울특별시 전체", "강원도 전체", "전라북도 전체", "전국", ""]
    assert each(spark, lambda c: polls.candidate_name(c, {"김 동 연": "김동연"}), ["김 동 연", "홍 길동", None]) == ["김동연", "홍길동", ""]
    assert each(spark, lambda c: text.safe_filename(c, "default.pdf"), ["a/b:c.pdf", "  x   y.pdf ", "", "plain.pdf"]) == ["a_b_c.pdf", "x y.pdf", "default.pdf", "plain.pdf"]
    address = "https://example.org/portal/cmm/fms/FileDown.do?atchFileId=F1&fileSn=2&bbsId=B3&bbsKey=K4"
    assert each(spark, lambda c: text.download_url(c, "https://example.org"), ["view('F1', '2', 'B3', 'K4')", "go('x')", None]) == [address, "", ""]
    companies = ["(주)기타리서치", "리서치 (주)", "주식회사  한국갤럽", "갤럽  조사 연구소", "가(주)나", None]
    assert each(spark, text.company_name, companies) == ["기타리서치", "리서치", "한국갤럽", "갤럽 조사 연구소", "가(주)나", None]
