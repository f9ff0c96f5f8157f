"""Row numbers and running sums over a whole table in order, without a single task that sees it all.

Rows are dealt to ranges of the order and written; each range is summed up, the few totals are summed in order (one row for
each range), and windows then run inside ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import cut


def running(df: DataFrame, order: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums``: its total over all rows up to this one in ``order``, which tells rows apart."""
    n = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy("_range").agg(*(F.sum(x).alias(f"_{name}") for name, x in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``n`` rows
    before = totals.select("_range", *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(F.broadcast(before), "_range")
    return summed.select(*df.columns, *((F.col(f"_{name}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(name) for name, x in sums.items()))


def numbered(df: DataFrame, order: list[str], name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1."""
    return running(df, order, {name: F.lit(1).cast("long")}, ranges)
