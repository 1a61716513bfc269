"""Poll rules as Column expressions: names, options, question kinds, cross-tab cells, validation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from civilake.functions.text import collapsed, squashed

UNDECIDED = "undecided"
# Canonical party names.
PARTIES = (
    "더불어민주당", "국민의힘", "개혁신당", "조국혁신당", "진보당", "정의당", "기본소득당", "새로운미래", "자유통일당", "민주노동당", "노동당", "녹색당", "무소속",
)
# An option whose name, without spaces, holds one of these is undecided.
UNDECIDED_WORDS = ("없음", "없다", "없음/모름", "지지정당없음", "그외정당", "그외다른정당", "무응답", "모름", "잘모르겠다", "잘모름", "의견유보", "기타")
# Question kinds in the order they are tried, by words their title or text holds.
QUESTION_KINDS = {
    "PARTY_SUPPORT": ("정당지지도", "지지정당"),
    "CANDIDATE_FIT": ("후보적합도", "후보지지도", "누가가장적합"),
    "MATCHUP": ("가상대결", "양자대결", "누구에게투표", "맞붙는다면"),
}
# Provinces that changed their names; every other is written as it is.
RENAMED_PROVINCES = {"강원특별자치도": "강원도", "전북특별자치도": "전라북도"}
# Names of columns that sum up others.
SUMMARY_NAMES = ("합계", "소계", "계", "T1", "T2", "B1", "B2")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))[key]


def party_name(c: Column) -> Column:
    """The canonical party of the same letters whatever the spaces, else the trimmed text; null is empty."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(_lookup({p: p for p in PARTIES}, collapsed(text)), text)


def party_mentioned(title: Column, description: Column, keywords: dict[str, str]) -> Column:
    """The party of the first keyword, in their order, that the title or the description holds; null if neither holds any."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    return F.coalesce(*(F.when(both.contains(keyword), F.lit(party)) for keyword, party in keywords.items()))


def is_undecided(c: Column) -> Column:
    """Whether an option stands for no choice."""
    return F.coalesce(collapsed(c).rlike("|".join(UNDECIDED_WORDS)), F.lit(False))


def question_kind(title: Column, text: Column | None = None) -> Column:
    """The first kind whose words the title or the text holds, spaces ignored; OTHER if none."""
    both = collapsed(title) if text is None else collapsed(F.concat_ws("|", title, text))
    out = F
    for kind, words in QUESTION_KINDS.items():
        out = out.when(both.rlike("|".join(words)), kind)
    return out.otherwise("OTHER")


def region_label(province: Column) -> Column:
    """The region a province is polled under; blank stays blank."""
    name = F.coalesce(_lookup(RENAMED_PROVINCES, province), province)
    return F.when(name == "전국", name).when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.concat(name, F.lit(" 전체")))


def title_region(c: Column) -> tuple[Column, Column]:
    """Region and election name of a list entry's title."""
    text = squashed(c)
    parts = F.split(text, " ")
    rest = lambda n: F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), " ")
    first, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    at = F.instr(text, " 전체")
    suffix = second.rlike("[시군구읍면동리]$")
    region = F.when(first == "전국", first).when(at > 0, F.substring(text, F.lit(1), at + 2)).when(suffix, F.concat_ws(" ", first, second))
    name = F.when(first == "전국", rest(1)).when(at > 0, F.trim(F.substring(text, at + 3, F.length(text)))).when(suffix, rest(2))
    several = F.size(parts) >= 2
    return region.when(several, first).otherwise(""), name.when(several, rest(1)).otherwise(text)


# Names of elections by their type codes.
ELECTION_TYPES = {
    1: "대통령선거", 2: "국회의원선거", 3: "광역단체장선거", 4: "기초단체장선거", 5: "광역의원선거", 6: "기초의원선거",
    7: "국회의원비례대표선거", 8: "광역의원비례대표선거", 9: "기초의원비례대표선거", 10: "교육의원선거", 11: "교육감선거",
}


def election_type_name(code: Column) -> Column:
    """The name of an election type; an unknown code is an empty name."""
    return F.coalesce(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ELECTION_TYPES.items()))[code.cast("int")], F.lit(""))


def label_of(code: Column, name: Column, by_code: dict[str, str], by_name: dict[str, str]) -> Column:
    """A label by its trimmed code, else by its trimmed name, else the name as it is; null is empty."""
    plain_code, plain_name = (F.trim(F.coalesce(c, F.lit(""))) for c in (code, name))
    return F.coalesce(_lookup(by_code, plain_code), _lookup(by_name, plain_name), plain_name)


def candidate_name(c: Column, aliases: dict[str, str]) -> Column:
    """A candidate's name by its alias, else without spaces."""
    return F.coalesce(_lookup(aliases, F.trim(F.coalesce(c, F.lit("")))), collapsed(F.coalesce(c, F.lit(""))))


def matches_target(region: Column, names: Column, pollster: Column, want_region: Column, want_names: Column, want_pollsters: Column) -> Column:
    """Whether a list entry fits a target; a null wish fits everything."""
    fits_region = want_region.isNull() | (region == want_region)
    fits_name = want_names.isNull() | F.arrays_overlap(names, want_names)
    fits_pollster = want_pollsters.isNull() | F.exists(want_pollsters, lambda p: F.contains(pollster, p))
    return fits_region & fits_name & fits_pollster


def total_row(table: Column, markers: tuple[str, ...] = ("전체",)) -> Column:
    """The first row whose first cell, without spaces, brackets and bullets, is a marker."""
    plain = lambda cell: F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\s\[\]■▣●]", "")
    return F.get(F.filter(table, lambda row: (F.size(row) > 0) & plain(F.get(row, F.lit(0))).isin(*markers)), F.lit(0))


def percentages(row: Column, start: int, low: float = 0.0, high: float = 100.0) -> Column:
    """The cells from column ``start`` (from 0) that are numbers in the range."""
    cells = F.slice(row, start + 1, F.greatest(F.size(row) - start, F.lit(0)))
    numbers = F.transform(cells, lambda cell: F.trim(F.coalesce(cell, F.lit(""))).try_cast("double"))
    return F.filter(numbers, lambda x: x.isNotNull() & (x >= low) & (x <= high))


def bunched_percentages(cell: Column) -> Column:
    """The numbers that begin a cell's first line, up to the first token that is none."""
    tokens = F.split(F.trim(F.get(F.split(F.coalesce(cell, F.lit("")), "\n"), F.lit(0))), r"\s+")
    start = F.struct(F.array().cast("array<double>").alias("found"), F.lit(True).alias("open"))

    def step(state, token):
        good = state["open"] & token.rlike(r"^\d+\.?\d*$")
        grown = F.when(good, F.concat(state["found"], F.array(token.try_cast("double")))).otherwise(state["found"])
        return F.struct(grown.alias("found"), good.alias("open"))

    return F.aggregate(tokens, start, step, lambda s: s["found"])


def shares_of(row: Column, start: int, mode: Column) -> tuple[Column, Column]:
    """A total row's shares and the mode they were read in: ``cell`` (one a cell), ``bunched`` (all in one cell), else the one that finds more."""
    single, bunched = percentages(row, start), bunched_percentages(F.get(row, F.lit(start)))
    used = F.when(mode.isin("cell", "bunched"), mode).when(F.size(bunched) > F.size(single), "bunched").otherwise("cell")
    return F.when(used == "bunched", bunched).otherwise(single), used


def sample_count(c: Column) -> Column:
    """The number in parentheses, else the whole text as a number, else null."""
    text = F.trim(F.coalesce(c, F.lit("")))
    inside = F.nullif(F.regexp_extract(text, r"\((\d[\d,]*)\)", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(inside, text), ",", "").try_cast("bigint")


def options_from_row(row: Column, start: int) -> Column:
    """The labels of a header row from column ``start``, on one line each, blanks left out."""
    cells = F.transform(F.slice(row, start + 1, F.greatest(F.size(row) - start, F.lit(0))), lambda c: squashed(F.coalesce(c, F.lit(""))))
    return F.filter(cells, lambda c: (c != "") & (F.lower(c) != "none"))


def is_summary(label: Column) -> Column:
    """Whether a column sums up others: by its name, the mark of a sum, corner brackets around it, or two marks of options (figures, circled figures, parentheses) that a plus joins."""
    text = F.trim(label)
    mark = r"[\d)(\u2460-\u2473]"
    joined = collapsed(text).rlike(rf"{mark}\+{mark}")
    bracketed = text.startswith("【") & text.endswith("】")
    return F.coalesce(text.isin(*SUMMARY_NAMES) | text.contains("(합)") | bracketed | joined, F.lit(False))


def paired(options: Column, values: Column) -> Column:
    """(option, pct) pairs, as far as both go."""
    pairs = F.arrays_zip(options.alias("option"), values.alias("pct"))
    return F.transform(F.slice(pairs, F.lit(1), F.least(F.size(options), F.size(values))), lambda p: F.struct(p["option"].alias("option"), p["pct"].alias("pct")))


def without_summaries(options: Column, values: Column) -> Column:
    """(option, pct) pairs without the summary columns; all of them, paired as far as they go, if the counts differ."""
    pairs = paired(options, values)
    return F.when(F.size(options) == F.size(values), F.filter(pairs, lambda p: ~is_summary(p["option"]))).otherwise(pairs)


def question_errors(number: Column, title: Column, options: Column, values: Column, n: Column) -> Column:
    """The names of the rules a question's result breaks, sorted; empty if it is sound."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    rules = {
        "count_mismatch": F.size(options) != F.size(values),
        "few_respondents": n < 50,
        "negative_value": F.exists(values, lambda x: x < 0),
        "no_options": F.size(options) == 0,
        "no_title": F.coalesce(F.trim(title), F.lit("")) == "",
        "no_values": F.size(values) == 0,
        "number_below_1": number < 1,
        "sum_out_of_range": (F.size(values) > 0) & ~total.between(75.0, 115.0),
        "value_over_100": F.exists(values, lambda x: x > 100),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))
