"""All queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from stratum.sources.tables import small_batches

from . import answers, documents, graphs, ladders, lines, nested, normalised, reconciled, reports, retrieval, runs, searches, walks

_MADE: dict = {**retrieval.QUERIES, **reports.QUERIES, **ladders.QUERIES, **documents.QUERIES, **normalised.QUERIES, **reconciled.QUERIES, **searches.QUERIES, **walks.QUERIES, **nested.QUERIES, **lines.QUERIES, **graphs.QUERIES, **runs.QUERIES, **answers.QUERIES}
ORACLES: dict = {**retrieval.ORACLES, **reports.ORACLES, **ladders.ORACLES, **documents.ORACLES, **normalised.ORACLES, **reconciled.ORACLES, **searches.ORACLES, **walks.ORACLES, **nested.ORACLES, **lines.ORACLES, **graphs.ORACLES, **runs.ORACLES, **answers.ORACLES}


def _entry(made: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query as an entry point: Python gets small batches, so that a worker's memory doesn't grow with a task's rows."""

    @wraps(made)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return made(spark, sf_dir)

    return run


QUERIES: dict = {name: _entry(made) for name, made in _MADE.items()}
