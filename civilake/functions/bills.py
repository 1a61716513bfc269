"""Bill rules as Column expressions: ingest status, stages, proposers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from civilake.functions.text import optional_text

# The stages of a bill in order; any other stage is unknown and has no order.
STAGES = ("접수", "소관위접수", "소관위심사", "체계자구심사", "본회의심의", "정부이송", "공포")
# Proposer kinds by their names in the data.
PROPOSER_KINDS = {"의원": "CONGRESSMAN", "위원장": "CHAIRMAN", "정부": "GOVERNMENT", "의장": "SPEAKER"}


def ingest_status(name: Column, date: Column, stage: Column, summary: Column) -> Column:
    """READY if all four are there, PARTIAL if some are, else PENDING; empty text counts as missing."""
    there = [optional_text(c).isNotNull() for c in (name, date, stage, summary)]
    every, some = there[0], there[0]
    for t in there[1:]:
        every, some = every & t, some | t
    return F.when(every, "READY").when(some, "PARTIAL").otherwise("PENDING")


def stage_order(stage: Column, stages: tuple[str, ...] = STAGES) -> Column:
    """A stage's place from 1; null for a stage that is not predefined."""
    return F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in enumerate(stages, 1)))[stage]


def can_update_stage(current: Column, following: Column, stages: tuple[str, ...] = STAGES) -> Column:
    """Between predefined stages only forward; to and from any other stage always."""
    return F.coalesce(stage_order(current, stages) < stage_order(following, stages), F.lit(True))


def derived_stage(withdrawn: Column, *dated: tuple[str, Column]) -> Column:
    """The stage of the first condition that holds, a withdrawal before all; the first of all stages if none does."""
    out = F.when(withdrawn, "철회")
    for stage, condition in dated:
        out = out.when(condition, stage)
    return out.otherwise("접수")


def proposer_kind(c: Column) -> Column:
    """The kind's code from its name or code; unknown and blank are members' bills."""
    text = F.trim(F.coalesce(c, F.lit("")))
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in PROPOSER_KINDS.items()))
    return F.coalesce(known[text], F.when(text.isin(*PROPOSER_KINDS.values()), text), F.lit("CONGRESSMAN"))


def proposers_in_name(name: Column) -> Column:
    """What the parentheses at a bill name's end hold, null if there are none."""
    return F.nullif(F.regexp_extract(name, r"\(([^)]+)\)$", 1), F.lit(""))


def bare_name(name: Column) -> Column:
    """A bill name without the parentheses at its end."""
    return F.trim(F.regexp_replace(name, r"\([^)]+\)$", ""))


def without_alternative(name: Column) -> Column:
    """A bill name without the mark of an alternative, wherever it stands."""
    return F.regexp_replace(name, r"\(대안\)", "")


def member_names(c: Column) -> Column:
    """All Korean names that stand before the word for member."""
    return F.regexp_extract_all(c, F.lit("([가-힣]+)의원"), F.lit(1))
