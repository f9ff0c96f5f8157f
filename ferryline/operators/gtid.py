"""Sets of transaction identifiers as intervals, and what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intervals(sets: DataFrame, flavor: str = "mysql") -> DataFrame:
    """(source, first, last) of a column ``gtid_set``: ``uuid:1-5:7,uuid:9``, or for mariadb ``domain-server-sequence``, which stands
    for all sequences of its domain up to it.  A set that cannot be read raises when it is."""
    entry = sets.select(F.explode(F.split(F.regexp_replace("gtid_set", r"\s", ""), ",")).alias("e")).filter("e <> ''")
    if flavor == "mariadb":
        ok = F.col("e").rlike(r"^\d+-\d+-\d+$")
        part = lambda i: F.split_part("e", F.lit("-"), F.lit(i))
        return entry.select(F.when(ok, part(1)).otherwise(F.raise_error(F.concat(F.lit("cannot read identifier "), "e"))).alias("source"), F.lit(1).cast("long").alias("first"), part(3).cast("long").alias("last"))
    ok = F.col("e").rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(:\d+(-\d+)?)+$")
    source = F.when(ok, F.lower(F.split_part("e", F.lit(":"), F.lit(1)))).otherwise(F.raise_error(F.concat(F.lit("cannot read identifier set "), "e")))
    each = entry.select(source.alias("source"), F.explode(F.slice(F.split("e", ":"), 2, 1 << 20)).alias("i"))
    return each.select("source", F.split_part("i", F.lit("-"), F.lit(1)).cast("long").alias("first"), F.split_part("i", F.lit("-"), F.lit(-1)).cast("long").alias("last"))


def held(events: DataFrame, sets: DataFrame) -> DataFrame:
    """Events (source, number, ..) with ``executed``: does an interval hold them?  Intervals that meet are joined first, so an event
    finds at most one, and the join is on the source."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source").orderBy("first")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = sets.withColumn("opens", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1)))
    joined = opened.withColumn("run", F.sum("opens").over(order)).groupBy("source", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = joined.groupBy(F.col("source").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans"))
    inside = F.exists("_spans", lambda s: (F.col("number") >= s["first"]) & (F.col("number") <= s["last"]))
    return events.join(spans, F.lower("source") == F.col("_s"), "left").withColumn("executed", F.coalesce(inside, F.lit(False))).drop("_s", "_spans")
