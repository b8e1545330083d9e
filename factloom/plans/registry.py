"""Queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import answers, calculations, datasets, documents, evidence, examples, gathering, gold, joins, questions, quotes, retrieval, statements, tables, traces
from factloom.sources import files
from factloom.streaming import logs

_MODULES: tuple = (retrieval, calculations, datasets, joins, documents, answers, tables, evidence, questions, quotes, traces, statements, gold, gathering, examples, files, logs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: lexical hits fused with a second ranking, accepted and dealt over the groups of each question."""
    return retrieval.q_rerank_pool(spark, sf_dir)
