"""Pages against plain loops: questions of small reports in every kind of layout, tables from word boxes, profiles."""

import random

from civilake.functions import polls
from civilake.operators import pages
from pyspark.sql import functions as F

TABLE = [["구분", "사례수", "가중", "가 당", "나 당"], ["▣ 전 체 ▣", "(1,007)", "1,000", "52.4", "30.0"], ["남성", "(500)", "490", "50.0", "31.0"]]
MORE = [["구분", "사례수", "가중", "다 당", "모름", "계"], ["[전체]", "(1,007)", "1,000", "10.1", "7.5", "100.0"]]


def read(spark, layout, rows):
    base = {"layout": "a", "title": r"\[표\s*(\d+)\]\s*([^\n]*)", "totals": ["전체"], "n_column": 1, "weighted_column": 2, "first": 3, "last": None, "header": None, "mode": "cell", "split": "join", "carried": False, "sums": True}
    base |= layout
    layouts = spark.createDataFrame([tuple(base.values())], pages.LAYOUT)
    table = spark.createDataFrame([(1, "a", i, text, tables) for i, (text, tables) in enumerate(rows)], pages.PAGE)
    found = pages.questions(table, layouts).orderBy("number").collect()
    return [(r.number, r.title, r.options, r.shares, r.n_completed, r.n_weighted) for r in found]


def test_questions(spark):
    both = (1, "정당 지지", ["가 당", "나 당", "다 당", "모름"], [52.4, 30.0, 10.1, 7.5], 1007, 1000)
    first = (*both[:2], both[2][:2], both[3][:2], 1007, 1000)
    two = [("[표 1] 정당  지지\n", [TABLE]), ("[표1] 계속", [[["x"]], MORE])]
    assert read(spark, {}, two) == [both]
    assert read(spark, {"split": "first"}, two) == [first]
    assert read(spark, {"carried": True}, [("[표 1] 정당 지지", None), (None, [TABLE, MORE]), ("", [MORE])]) == [both]
    assert read(spark, {}, [("[표 1] 정당 지지", None), (None, [TABLE])]) == []
    each = read(spark, {"split": "each", "title": None, "sums": False}, [("", [TABLE, [["합계", "1"]]]), ("", [MORE])])
    assert [(n, o, s) for n, _, o, s, *_ in each] == [(1, ["가 당", "나 당"], [52.4, 30.0]), (2, ["다 당", "모름", "계"], [10.1, 7.5, 100.0])]
    bunched = [TABLE[0], ["전체", "(1,007)", "(1,000)", "52.4 30.0\n1.0"]]
    for mode, expected in (("bunched", [52.4, 30.0]), ("auto", [52.4, 30.0])):
        assert [s for *_, s, _, _ in read(spark, {"mode": mode}, [("[표 3] x", [bunched])])] == [expected]
    assert read(spark, {"mode": "cell"}, [("[표 3] x", [bunched])]) == []
    counts = [["구분", "수", "A", "B", "sum"], ["전체", "(1,007)\n(1,000)", "40", "59.9", "99.9"]]
    assert read(spark, {"n_column": 1, "weighted_column": 1, "first": 2, "last": -1, "header": 0}, [("[표 12] 제목", [counts])]) == [(12, "제목", ["A", "B"], [40.0, 59.9], 1007, 1000)]
    short = [["구분", "", "", "only one"], ["전체", "1", "1", "10", "20"]]
    assert read(spark, {"sums": False}, [("[표 2] x", [short, None, []])]) == []
    assert read(spark, {}, []) == []


def test_summary_labels(spark):
    sums = ["(합)", "합계", "소계", "계", "T1", "B2", "①+②", "(1+2)", "(1) + (2)", "【긍정】", "① + ②"]
    options = ["민주당", "계양구", "T10", "잘함", "A+", "무소속", "C + D", None]
    rows = spark.createDataFrame([(x,) for x in sums + options], "x string")
    assert [r.s for r in rows.select(polls.is_summary(F.col("x")).alias("s")).collect()] == [True] * len(sums) + [False] * len(options)


def plain_table(words):
    """One page's table by loops over sorted words."""
    import re

    def stretches(items, low, high, gap):
        out, reached = [], None
        for w in sorted(items, key=lambda w: (w[low], w[high])):
            if reached is None or w[low] > reached + gap:
                out.append([])
            out[-1].append(w)
            reached = max(w[high], reached if reached is not None else w[high])
        return out

    number = re.compile(r"\(?\d[\d,]*(\.\d+)?\)?%?").fullmatch
    lines = stretches(words, 2, 3, 0.5)
    body = [sum(bool(number(w[4])) for w in line) >= 2 for line in lines]
    if not any(body):
        return {}
    columns = [(min(w[0] for w in c), max(w[1] for w in c)) for c in stretches([w for line, b in zip(lines, body, strict=True) if b for w in line if number(w[4])], 0, 1, 2.0)]
    first, cells, row = body.index(True), {}, -1
    for i, line in enumerate(lines):
        row += body[i]
        for w in line:
            centre = (w[0] + w[1]) / 2
            edge = columns[0][0]
            if i < first:
                edge -= (columns[1][0] - columns[0][0]) / 2 if len(columns) > 1 else float("inf")
            nearest = min(range(len(columns)), key=lambda c: (abs(sum(columns[c]) / 2 - centre), c))
            cells.setdefault((row, 0 if centre < edge else nearest + 1), []).append((i, w[0], w[4]))
    return {(r + 1, c): " ".join(t for *_, t in sorted(ws)) for (r, c), ws in cells.items()}


def test_tables_from_words(spark):
    rng, rows, wanted = random.Random(8), [], {}
    for page in range(40):
        width, words = rng.randrange(1, 6), []
        y = 10.0
        for kind in ["head"] * rng.randrange(0, 3) + [rng.choice(["body", "body", "body", "tail"]) for _ in range(rng.randrange(0, 5))]:
            for c in range(width + 1):
                x = 20 + 70.0 * c + rng.uniform(-5, 5)
                text = rng.choice(["가", "label", "b-c"]) if kind != "body" or c == 0 else rng.choice([f"{rng.randrange(100)}.{rng.randrange(10)}", f"({rng.randrange(1000)})", "-"])
                if rng.random() < 0.85:
                    words.append((x, x + rng.uniform(8, 30), y + rng.uniform(0, 2), y + rng.uniform(7, 9), text))
            y += rng.choice([10.0, 14.0])
        rows += [(page, *w) for w in words]
        wanted |= {(page, *k): t for k, t in plain_table(words).items()}
    found = {(r.page, r.row, r.column): r.text for r in pages.word_tables(spark.createDataFrame(rows, pages.WORD)).collect()}
    assert found == wanted and len(wanted) > 100
    assert pages.word_tables(spark.createDataFrame([], pages.WORD)).count() == 0


def test_profiles(spark):
    rows = [(1, "a", 1, "문 1) 지지\n전체 (1,007) 45.2 30.1 20.0", None), (1, "a", 2, "문 1) 지지 계속\n1.5 2.5 3.5", None), (1, "a", 3, " 문2) 다음 (1,200)\n[표 9] x", None), (2, "a", 1, None, None), (2, "a", 2, "12 34.5\n1500 1,500", None), (3, "a", 1, "1. 첫째\n3. 셋째\n2023년 4. 중간", None)]
    found = {r.doc: tuple(r)[1:] for r in pages.document_profiles(spark.createDataFrame(rows, pages.PAGE)).collect()}
    assert found == {
        1: (3, "문#)", 2, 1, True, "bunched", "(0,000)", True),
        2: (2, None, 0, 0, False, "cell", "0,000 0000", False),
        3: (1, "#.", 2, 0, False, "none", "", False),
    }


def test_profiles_of_odd_pages(spark):
    """Several styles and numbers on a page, pages given twice, words that end in signs for a new line."""
    texts = ["[표 1] x\n[표 1] 계속\n문 2) (1,007) 1000", "문 1)\n문 3)\n[표 2] 1,007) (1000 1234\u0085", "5.5 6.5\t7.5\n1.5", "1.55 1.2.3 (1,0 a1234 12345"]
    rows = [(1, "a", 1, texts[0], None), (1, "a", 1, texts[1], None), (1, "a", 2, texts[0], None), (2, "a", 7, texts[2], None), (2, "a", 8, "1.5\n2.5 3.5", None), (2, "a", 9, "1.5 1.5 1.5", None), (3, "a", 1, texts[3], None)]
    found = {r.doc: tuple(r)[1:] for r in pages.document_profiles(spark.createDataFrame(rows, pages.PAGE)).collect()}
    assert found == {
        1: (3, "[표#]", 2, 1, True, "none", "(0,000) (0000 0,000) 0000", True),
        2: (3, None, 0, 0, False, "bunched", "", False),
        3: (1, None, 0, 0, False, "none", "0000", False),
    }


def test_markers(spark):
    """All that a page shows, in its text and in its cells."""
    texts = [
        "[표 1] 질문\n전체 (1,007) 45.2 30.1 20.0", "Q1. 질문\n합계 1007 45.2", "문 3) 다음 페이지\n▣ 전체 ▣", "nothing", None,  # the pages screened before headings were
        "see [표 2] and [표3]-x, SQ 4. or 설문 5) of 6번)\n표 7\n 8) one\n9. Two\n10. three\n11)\n[문 1200] x\n[표 2] y",
        "a FAQ 1. 2Q23. 45.2% (500) (1234 명 1,007명 2023년 12,345 1007, 0.123 A100 12345\n계 속\n전\t체 이하 계속",
    ]
    texts.append("표 5\n. x\n▣계▣ 전 체 ▣")
    rows = [(1, "a", i, text, None) for i, text in enumerate(texts)]
    rows.append((2, "a", 0, "표 1", [[["구분", "[Q 2]"], ["[ 전 체 ]", "(500)", "45.2", "30.1", "20.0"], None, [], [None, "x"]], None, [["합계", "1.5, 2.5\n3.5", "계속"], ["□합 계□", "1,007"], ["전체의", "계"]]]))
    rows.append((2, "a", 1, "", [[["합계", "1,007", "45.2", "30.1", "20.0"]]]))
    found = {(r.doc, r.page): tuple(r)[2:] for r in pages.page_markers(spark.createDataFrame(rows, pages.PAGE)).collect()}
    assert found == {
        (1, 0): ("[표#]=1", "[표#]=1", "전체", "parenthesized_comma", "bunched", False),
        (1, 1): ("Q#.=1", "Q#.=1", "합계", "plain_plain", "cell", False),
        (1, 2): ("문#)=1", "문#)=1", "▣ 전체 ▣", "", "none", True),
        (1, 3): ("", "", "", "", "none", False),
        (1, 4): ("", "", "", "", "none", False),
        (1, 5): ("#)=2,#.=2,[문#]=1,[표#]=1,표#=1", "#)=2,#.=1,#번)=1,SQ#.=1,[문#]=1,[표#]=3,문#)=1,표#=1", "", "plain_plain", "none", False),
        (1, 6): ("", "", "계,전 체", "parenthesized_plain,plain_comma,plain_plain", "cell", True),
        (1, 7): ("표#.=1", "표#=1", "▣ 전 체 ▣,▣계▣,전 체", "", "none", False),
        (2, 0): ("표#=1", "[Q#]=1,표#=1", "[ 전 체 ],□합 계□,전 체,합계", "parenthesized_plain,plain_comma", "bunched", True),
        (2, 1): ("", "", "합계", "plain_comma", "cell", False),
    }


def test_table_shapes(spark):
    t = lambda *widths: [[""] * n for n in widths]
    rows = [(1, "a", 1, "", [t(2, 3), t(2, 3), t(1)]), (1, "a", 2, "", [[], None, t(4), t(5)]), (1, "a", 3, "", None), (1, "a", 4, "", []), (2, "a", 1, "", None), (3, "a", 1, "", [[]]), (3, "a", 2, "", [t(2, 1, 1), t(1)])]
    found = {r.doc: tuple(r)[1:] for r in pages.table_shapes(spark.createDataFrame(rows, pages.PAGE)).collect()}
    assert found == {1: (2, 2, 1, 3), 2: (0, 1, 0, 0), 3: (2, 0, 1, 1)}
