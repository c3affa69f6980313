"""How plan modules register their queries: by name, with the DuckDB text that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.tables import sql

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def both(self, name: str, text: str, duck: str | None = None, args: dict | list | None = None) -> None:
        """A query whose SQL text serves both engines, {table} standing for a table; `duck` where the texts differ."""
        self.queries[name] = lambda spark, sf_dir: sql(spark, sf_dir, text, args)
        self.oracle[name] = duck or re.sub(r"\{(\w+)\}", r"\1", text)

    def plan(self, duck: str | None) -> Callable[[Query], Query]:
        """Registers a function of (spark, sf_dir) under its own name, less a trailing underscore."""
        def register(f: Query) -> Query:
            name = f.__name__.rstrip("_")
            self.queries[name] = f
            if duck is not None:
                self.oracle[name] = duck
            return f

        return register
