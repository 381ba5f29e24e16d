"""All queries of the library's own operators, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "endpoint_batch"
MODULES = ["q_gates", "q_scoring", "q_verify", "q_series", "q_sessions", "q_prep", "q_streams", "q_files", "q_batches"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
