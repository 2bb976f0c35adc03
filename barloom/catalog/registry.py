"""Query registry: name -> (Spark callable, equivalent SQL or None)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Build
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register the decorated builder under its function name."""
    def register(build: Build) -> Build:
        if build.__name__ in ENTRIES:
            raise ValueError(f"duplicate query {build.__name__}")
        ENTRIES[build.__name__] = Entry(build.__name__, build, sql)
        return build
    return register
