"""Every query of the engine by name, with the text an independent engine runs to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.tables import owning
from .plans import checks, copies, log, texts, verification

MODULES = (verification, checks, log, copies, texts)


def owner(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The tables that ``query`` writes on the way belong to its result (``operators.tables.release``)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with owning(spark) as own:
            out = query(spark, sf_dir)
        out.tables = own
        return out

    return run


QUERIES = {name: owner(query) for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
