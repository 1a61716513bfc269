"""Results written as JSON or CSV files in one of three modes: shown only, beside the real ones, or for good."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Names of the modes and what else they are called.
MODES = {"dry_run": "dry_run", "dryrun": "dry_run", "test": "test_db", "test_db": "test_db", "testdb": "test_db", "prod": "prod", "remote": "prod", "db": "prod"}


def execution_mode(name: str | None) -> str:
    """The mode that a name means, whatever its case and hyphens; none is a dry run, an unknown one a ValueError."""
    found = (name or "dry_run").strip().lower().replace("-", "_")
    if found not in MODES:
        raise ValueError(f"{name}: the modes are dry_run, test and prod")
    return MODES[found]


def write_artifact(rows: DataFrame, folder: str, name: str, mode: str | None, kind: str = "json") -> str | None:
    """Write rows as ``json`` lines or ``csv`` with a header under ``folder/name``, in the test mode under ``folder/test/name``, and return that path. A dry run writes nothing and returns None.

    A run replaces what an earlier one wrote under the name.
    """
    mode = execution_mode(mode)
    if kind not in ("json", "csv"):
        raise ValueError(f"{kind}: an artifact is json or csv")
    if mode == "dry_run":
        return None
    path = f"{folder}/{name}" if mode == "prod" else f"{folder}/test/{name}"
    writer = rows.write.mode("overwrite")
    if kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.option("header", "true").option("escape", '"').csv(path)
    return path
