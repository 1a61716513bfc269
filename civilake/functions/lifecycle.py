"""Rules of a bill's lifecycle as Column expressions: stage events from dates, vote counts, batch states, notification texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.functions.dates import multi_date
from civilake.functions.text import first_text, safe_int

# The stages of a lifecycle row and the date fields that show one, the first that parses counting.
STAGE_DATES = {
    "접수": ("PPSL_DT",), "위원회 심사": ("JRCMIT_CMMT_DT", "JRCMIT_PRSNT_DT", "JRCMIT_PROC_DT"), "체계자구 심사": ("LAW_CMMT_DT", "LAW_PRSNT_DT", "LAW_PROC_DT"),
    "본회의 심의": ("RGS_PRSNT_DT", "RGS_RSLN_DT"), "정부이송": ("GVRN_TRSF_DT",), "공포": ("PROM_DT",),
}
EVENTS = "array<struct<day:date,stage:string,committee:string,result:string,reference:date>>"
PLENARY, RECEIVED = "본회의 심의", "접수"
# The date that a row is dated by, in this order.
REFERENCE_DATES = ("PROM_DT", "GVRN_TRSF_DT", "RGS_RSLN_DT", "RGS_PRSNT_DT", "LAW_PROC_DT", "JRCMIT_PROC_DT", "PROC_DT", "PPSL_DT")
# Fields that are all empty in a row whose committee review has to be fetched.
REVIEW_FIELDS = ("JRCMIT_NM", "CURR_COMMITTEE", "JRCMIT_PRSNT_DT", "JRCMIT_PROC_DT", "LAW_PRSNT_DT", "LAW_PROC_DT")
# States of batch providers and what they are called here.
BATCH_STATES = {
    "PENDING": "SUBMITTED", "QUEUED": "SUBMITTED", "RUNNING": "IN_PROGRESS", "UPDATING": "IN_PROGRESS", "PAUSED": "IN_PROGRESS", "SUCCEEDED": "COMPLETED",
    "PARTIALLY_SUCCEEDED": "COMPLETED", "CANCELLED": "CANCELED", "UNSPECIFIED": "UNKNOWN",
}


def known(column: str, columns: list[str]) -> Column:
    """A column, or null where the table has none of that name."""
    return F.col(column) if column in columns else F.lit(None).cast("string")


def with_events(rows: DataFrame, committee: Column, result: Column, name: str = "events") -> DataFrame:
    """``rows`` with an array of stage events (``day, stage, committee, result, reference``), by date, then stage name.

    The result stands only with the plenary stage. A row without a stage date
    becomes one receipt event at its reference date, or has none if it has none.
    Every field is parsed once.
    """
    fields = [c for c in rows.columns if any(c in names for names in STAGE_DATES.values())]
    parsed = rows.withColumns({f"__{c}": multi_date(F.col(c)) for c in fields} | {"__reference": first_text(*(known(c, rows.columns) for c in REFERENCE_DATES))})
    parsed = parsed.withColumns({"__reference": multi_date(F.col("__reference")), "__committee": committee, "__result": result})
    none = F.lit(None).cast("string")

    def event(stage: str, day: Column, of: Column) -> Column:
        return F.struct(day.alias("day"), F.lit(stage).alias("stage"), F.col("__committee").alias("committee"), of.alias("result"), F.coalesce("__reference", day).alias("reference"))

    own = {stage: [F.col(f"__{c}") for c in names if c in fields] for stage, names in STAGE_DATES.items()}
    dated = [event(stage, F.coalesce(*days), F.col("__result") if stage == PLENARY else none) for stage, days in own.items() if days]
    reached = F.array_sort(F.filter(F.array(*dated), lambda e: e["day"].isNotNull())) if dated else F.array().cast(EVENTS)
    found = parsed.withColumn(name, reached)
    fallback = F.when(F.col("__reference").isNotNull(), F.array(event(RECEIVED, F.col("__reference"), none))).otherwise(F.array().cast(EVENTS))
    return found.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(fallback)).select(*rows.columns, name)


def review_missing(columns: list[str]) -> Column:
    """Whether all fields of the committee review are empty."""
    return F.coalesce(*(F.nullif(known(c, columns), F.lit("")) for c in REVIEW_FIELDS)).isNull()


def vote_count(columns: list[str], *names: str) -> Column:
    """A count under the first of its names that is not null, thousands commas allowed; anything else is 0."""
    return safe_int(F.coalesce(*(known(c, columns).cast("string") for c in names)))


def batch_state(c: Column) -> Column:
    """A provider's state in common terms: case and a ``JOB_STATE_`` prefix ignored, unknown ones as they are, none is UNKNOWN."""
    name = F.regexp_replace(F.upper(F.coalesce(c, F.lit("UNKNOWN"))), "^JOB_STATE_", "")
    return F.coalesce(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in BATCH_STATES.items()))[name], name)


def job_action(state: Column, has_output: Column, dry_run: Column, applied: Column) -> tuple[Column, Column]:
    """What an ingest run does with a job, and the state it stores: wait, skip (dry run), roll back (state FINALIZING) or apply."""
    done = (state == "COMPLETED") & has_output
    action = F.when(~done, "wait").when(dry_run, "skip").when(~applied, "rollback").otherwise("apply")
    return action, F.when(action == "rollback", "FINALIZING").otherwise(state)
