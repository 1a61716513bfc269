"""Incremental merges: upserts with a rule for each column, child replacement, refreshes and folds of ordered changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row of each key, the one of the largest ordinal."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("__x")).select(*keys, *(F.col(f"__x.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: tuple[str, ...] = (), fill: tuple[str, ...] = (), on_insert: dict[str, Column] | None = None) -> DataFrame:
    """``old`` after the rows of ``new`` (unique in its keys) are merged into it, with the columns of ``old``.

    ``overwrite`` columns take the new value even if it is null, ``fill`` columns
    only if it is not null. Other columns keep the old value; a new row takes
    them from ``on_insert``, or else from ``new`` if it has them, or else null.
    """
    on_insert = on_insert or {}
    a = old.withColumn("__old", F.lit(True)).alias("a")
    b = new.withColumn("__new", F.lit(True)).alias("b")
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    out = []
    for c in old.columns:
        before, after = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            value = F.coalesce(before, after)
        elif c in overwrite:
            value = F.when(F.col("__new"), after).otherwise(before)
        elif c in fill:
            value = F.coalesce(after, before)
        else:
            value = F.when(F.col("__old"), before).otherwise(on_insert.get(c, after))
        out.append(value.alias(c))
    return a.join(b, condition, "full").select(*out)


def refreshed(old: DataFrame, new: DataFrame, key: str, active: str) -> DataFrame:
    """``old`` after a full refresh: rows that ``new`` has take its values and are active, rows that it lacks are not, its other rows are added."""
    values = tuple(c for c in new.columns if c != key)
    merged = upsert(old, new.withColumn(active, F.lit(True)), [key], overwrite=(*values, active))
    gone = old.select(key).join(new.select(key), key, "left_anti").withColumn("__gone", F.lit(True))
    return merged.join(gone, key, "left").withColumn(active, F.col("__gone").isNull() & F.col(active)).drop("__gone")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent that ``new`` speaks of are replaced by the rows of ``new``."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def without_user(tables: dict[str, DataFrame], gone: DataFrame, user: str) -> dict[str, DataFrame]:
    """Each table without the rows of the users in ``gone``."""
    return {name: rows.join(gone.select(user), user, "left_anti") for name, rows in tables.items()}


def changed(rows: DataFrame, key: str, ordinal: str, watched: str) -> DataFrame:
    """Rows whose watched column differs from the row before it of the same key (nulls compare as values): ``before``, ``after``."""
    order = Window.partitionBy(key).orderBy(ordinal)
    seen = rows.withColumns({"__before": F.lag(watched).over(order), "__at": F.row_number().over(order)})
    moved = seen.where((F.col("__at") > 1) & ~F.col("__before").eqNullSafe(F.col(watched)))
    return moved.select(key, ordinal, F.col("__before").alias("before"), F.col(watched).alias("after"))


def toggled(actions: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Keys that an odd number of toggles left switched on, with the ordinal of the last one."""
    folded = actions.groupBy(*keys).agg(F.count("*").alias("n"), F.max(ordinal).alias(ordinal))
    return folded.where("n % 2 = 1").select(*keys, ordinal)


def folded_stages(rows: DataFrame, key: str, ordinal: str, stage: str, place: Column) -> DataFrame:
    """``key, stage``: the stage left after each key's stages are applied in order, where predefined ones (with a ``place``) only move forward and any other is always taken.

    After the last stage without a place any predefined one is taken, and from
    there only later ones: so what is left is the furthest stage seen after that
    one, or that one itself. The last occurrence of each place tells both, so a
    key's history is summed before it is shuffled and never listed.
    """
    last = rows.select(key, ordinal, stage, place.alias("__place")).groupBy(key, "__place").agg(F.max(F.struct(ordinal, stage)).alias("__last"))
    free = F.max(F.when(F.col("__place").isNull(), F.col("__last"))).alias("__free")
    seen = last.groupBy(key).agg(free, F.collect_list(F.when(F.col("__place").isNotNull(), F.struct("__place", "__last"))).alias("__seen"))  # one entry a place
    after = F.filter("__seen", lambda x: F.col("__free").isNull() | (x["__last"][ordinal] > F.col(f"__free.{ordinal}")))
    furthest = F.array_max(after)
    return seen.select(key, F.coalesce(furthest["__last"][stage], F.col(f"__free.{stage}")).alias(stage))


def toggle_outcomes(actions: DataFrame, keys: list[str], ordinal: str, wanted: str) -> DataFrame:
    """Each request to switch a key on or off with its outcome, and the state it leaves: asking for the state that is there already is an error and changes nothing.

    A request moves the state if it differs from what was asked for last, so the
    state before a request is simply the request before it (off at the start).
    """
    before = F.coalesce(F.lag(wanted).over(Window.partitionBy(*keys).orderBy(ordinal)), F.lit(False))
    outcome = F.when(F.col(wanted) == before, "error").when(F.col(wanted), "created").otherwise("deleted")
    return actions.withColumn("outcome", outcome)
