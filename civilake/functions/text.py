"""Text and number cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space and the no-break space, which Java's \\s leaves out.
SPACE = r"[\s ]+"
# Headings that are no summary.
HEADINGS = ("제안이유", "주요내용", "제안이유 및 주요내용")


def optional_text(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*(optional_text(c) for c in columns))


def squashed(c: Column) -> Column:
    """White space runs, no-break spaces included, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def collapsed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"\s+", "")


def safe_int(c: Column, default: int | None = 0) -> Column:
    """An integer with optional thousands commas, or the default."""
    found = F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("bigint")
    return found if default is None else F.coalesce(found, F.lit(default))


def bill_number(c: Column) -> Column:
    """A bill number as text, without a trailing ``.0``."""
    return F.regexp_replace(optional_text(c), r"\.0$", "")


def text_list(c: Column) -> Column:
    """The trimmed non-blank parts of a comma-separated text; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def first_n(items: Column, n: Column) -> Column:
    """The first ``n`` items of an array, all if it has fewer."""
    return F.slice(items, F.lit(1), F.greatest(n, F.lit(0)))


def last_number(c: Column, default: int) -> Column:
    """The last run of digits in a text as an integer, or the default."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)\D*$", 1), F.lit("")).try_cast("int"), F.lit(default))


def percent_in(c: Column) -> Column:
    """The first number in a text that a percent sign follows, or null."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).try_cast("double")


def int_in(c: Column) -> Column:
    """The first integer in a text, thousands commas ignored, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def download_url(onclick: Column, base: str) -> Column:
    """The download address that a link's script call ``view('file', 'number', 'board', 'key')`` stands for; empty if it is no such call."""
    call = r"view\('([^']+)',\s*'([^']+)',\s*'([^']+)',\s*'([^']+)'\)"
    part = lambda i: F.regexp_extract(onclick, call, i)
    url = F.format_string(f"{base}/portal/cmm/fms/FileDown.do?atchFileId=%s&fileSn=%s&bbsId=%s&bbsKey=%s", part(1), part(2), part(3), part(4))
    return F.when(F.coalesce(onclick.rlike(call), F.lit(False)), url).otherwise("")


def shortened(c: Column, most: int = 120) -> Column:
    """At most ``most`` characters on one line; longer text is cut three earlier and ends in ``...``."""
    line = squashed(c)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("...")))


def brief_summary(summary: Column, name: Column, existing: Column) -> Column:
    """The existing brief, else the summary's first line that is no heading, else the name; shortened unless existing."""
    lines = F.filter(F.transform(F.split(summary, r"\R"), squashed), lambda x: (x != "") & ~x.isin(*HEADINGS))
    return F.coalesce(F.nullif(existing, F.lit("")), shortened(F.get(lines, F.lit(0))), F.nullif(shortened(name), F.lit("")))


def url_param(url: Column, key: str) -> Column:
    """The value of a query parameter, null if absent."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


def safe_filename(c: Column, default: str) -> Column:
    """Characters that file systems reject become ``_``; a blank name is the default."""
    return F.coalesce(F.nullif(squashed(F.regexp_replace(c, r'[\\/:*?"<>|]', "_")), F.lit("")), F.lit(default))


def company_name(c: Column) -> Column:
    """A company's name without the marks of a stock company at either end (``(주)``, ``주식회사``), white space squashed."""
    mark = r"(?:\(주\)|주식회사)"
    return squashed(F.regexp_replace(squashed(c), rf"^{mark}\s*|\s*{mark}$", ""))


def first_json_object(c: Column) -> Column:
    """The first ``{...}`` of a text whose braces balance, those inside strings not counted, or null.

    The text from its first brace on is cut into strings and other tokens, and
    their lengths and brace depths are folded until the depth is 0 again. A string
    that never ends is all the rest. The pattern never goes back (possessive
    quantifiers), so strings may be of any length.
    """
    tail = F.substring(c, F.instr(c, "{"), F.length(c))
    tokens = F.regexp_extract_all(tail, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}]|[^"{}]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(state, token):
        at = state["at"] + F.length(token)
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        end = F.when(state["end"] > 0, state["end"]).when((token == "}") & (depth == 0), at).otherwise(0)
        return F.struct(at.alias("at"), depth.alias("depth"), end.alias("end"))

    end = F.aggregate(tokens, start, step, lambda state: state["end"])
    return F.when((F.instr(c, "{") > 0) & (end > 0), F.substring(tail, F.lit(1), end))


def without_fences(c: Column) -> Column:
    """A model's answer without the code fences around it: a first line that opens one, and a last line that is one."""
    text = F.trim(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"(^|\n)[ \t]*```[ \t]*$", "")
    return F.when(text.startswith("```"), F.trim(F.regexp_replace(inner, r"^\s+|\s+$", ""))).otherwise(text)


def in_range(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """A percentage as decimal(5,2), null if it is no number in the range."""
    number = c.try_cast("double")
    return F.when(number.between(low, high), F.round(number, 2).cast("decimal(5,2)"))


def clamped(c: Column, fallback: int, low: int, high: int) -> Column:
    """An integer parameter: the fallback if it does not parse, held within the bounds."""
    return F.least(F.greatest(F.coalesce(F.trim(c).try_cast("int"), F.lit(fallback)), F.lit(low)), F.lit(high))


def cache_key(params: Column, secret: str = "KEY") -> Column:
    """A map of parameters as one canonical string: the secret dropped, keys sorted."""
    entries = F.filter(F.map_entries(params), lambda e: e["key"] != secret)
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")


def mapped(landed: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """A landed record as a row: each output column from a field, ``as is``, as ``text`` or ``int`` (blank is null) or as part of a ``key`` (null is blank)."""
    kinds = {"as is": F.col, "text": lambda c: optional_text(F.col(c)), "int": lambda c: safe_int(F.col(c), None), "key": lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))}
    return landed.select(*(kinds[kind](field).alias(name) for name, (field, kind) in fields.items()))
