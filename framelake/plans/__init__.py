"""Registered queries and their SQL, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.plans import detection, indexing, ingest, lexical, metrics, models, reading, search, sequences  # noqa: E402

AREAS: tuple = (search, lexical, indexing, detection, sequences, metrics, models, reading, ingest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for area in AREAS for name, (fn, _) in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, (_, sql) in area.QUERIES.items() if sql}
