"""Which change log feeds which table, and the two phases of a run that uses both."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

MODES = ("binlog", "capture-triggers")


def parse(spark: SparkSession, spec: str) -> DataFrame:
    """(table_key, mode) from ``schema.table=mode,..``; the last of several routes of one table holds."""
    entry = spark.range(1).select(F.posexplode(text.listed(F.lit(spec))).alias("at", "entry"))
    pair = entry.select("at", "entry", F.trim(F.split_part("entry", F.lit("="), F.lit(1))).alias("table_key"), F.trim(F.regexp_extract("entry", "=(.*)$", 1)).alias("mode"))
    bad = pair.filter(~F.col("entry").contains("=") | ~F.col("mode").isin(*MODES)).limit(1).collect()
    if bad:
        raise ValueError(f"invalid table route {bad[0]['entry']!r} (expected schema.table=mode, modes {' or '.join(MODES)})")
    return pair.groupBy("table_key").agg(F.max_by("mode", "at").alias("mode"))


def databases_of(routes: DataFrame, mode: str, everything: DataFrame) -> DataFrame:
    """Databases with a table routed to ``mode``; all of ``everything`` (database) where there are no routes."""
    if routes.isEmpty():
        return everything.select("database")
    return routes.filter(F.col("mode") == mode).filter(F.col("table_key").contains(".")).select(F.split_part("table_key", F.lit("."), F.lit(1)).alias("database")).distinct()


def owners(tables: DataFrame, routes: DataFrame) -> DataFrame:
    """(database, table, mode): each table has one owner; what no route names is read from the binary log."""
    keyed = tables.withColumn("table_key", text.table_key(F.col("database"), F.col("table")))
    folded = routes.select(F.lower("table_key").alias("table_key"), "mode")
    return keyed.join(folded, "table_key", "left").select("database", "table", F.coalesce("mode", F.lit("binlog")).alias("mode"))


def several_owners(claims: DataFrame) -> DataFrame:
    """(database, table, modes) of tables that more than one log would feed."""
    return claims.groupBy("database", "table").agg(F.array_sort(F.collect_set("mode")).alias("modes")).filter("size(modes) > 1").orderBy("database", "table")


def run(phases: dict[str, Callable[[list[str]], object]], routes: DataFrame) -> dict[str, object]:
    """Feed captured tables from the trigger log first, then the rest from the binary log, which is told to leave them out."""
    captured = sorted(r["table_key"].lower() for r in routes.filter(F.col("mode") == "capture-triggers").select("table_key").collect())  # named by hand
    out = {}
    if captured:
        out["capture-triggers"] = phases["capture-triggers"](captured)
    out["binlog"] = phases["binlog"](captured)
    return out


def admitted(changes: DataFrame, order: list[str], rows_per_second: int) -> DataFrame:
    """``changes`` with the second, from the start of a run, in which each may be applied; a rate of 0 admits all at once."""
    from .ordering import numbered

    placed = numbered(changes, order, "_n")
    second = F.lit(0).cast("long") if rows_per_second <= 0 else F.expr(f"greatest((_n - 1) div {int(rows_per_second)}, 0L)")
    return placed.withColumn("second", second).drop("_n")


class Limiter:
    """A token bucket for driver-side batches: ``rate`` rows a second, as many at once."""

    def __init__(self, rate: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = max(0, rate), clock, sleep
        self.tokens, self.at = float(self.rate), clock()

    def wait(self, rows: int) -> float:
        """Wait until ``rows`` may go; more than a burst go in parts.  Seconds waited."""
        waited = 0.0
        while self.rate and rows > 0:
            part = min(rows, self.rate)
            now = self.clock()
            self.tokens, self.at = min(float(self.rate), self.tokens + (now - self.at) * self.rate), now
            if self.tokens < part:
                pause = (part - self.tokens) / self.rate
                self.sleep(pause)
                waited += pause
                self.tokens, self.at = float(part), self.clock()
            self.tokens -= part
            rows -= part
        return waited
