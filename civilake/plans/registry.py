"""How query modules register a query together with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Queries by name, and the DuckDB SQL of those that have one."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, dates: tuple[str, ...] = ()):
        """Register a query. Its ``dates`` columns are returned as ISO text by both sides, since date types differ between engines."""

        def register(f: Callable) -> Callable:
            @wraps(f)
            def run(spark, sf_dir) -> DataFrame:
                found = f(spark, sf_dir)
                return found.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else found

            self.queries[f.__name__] = run
            if sql:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
                self.oracles[f.__name__] = f"SELECT * REPLACE ({casts}) FROM (\n{sql.strip()}\n)" if dates else sql.strip()
            return f

        return register
