"""Registered queries: name -> (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what an independent engine should answer."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    from paperfold.catalog import (  # noqa: F401
        access,
        constraints,
        corpus,
        evaluating,
        published,
        quality,
        retrieval,
        streams,
        study,
    )
