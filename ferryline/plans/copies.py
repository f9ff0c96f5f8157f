"""Queries of key-ordered movement over data tables, with SQL of its own for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import copying, verify
from ..sources import state
from .log import events_log
from .verification import TABLES, both, dest, side_sql, source


def t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_orderkey", "l_linenumber"]


def snapshot_log(spark, sf_dir: str) -> DataFrame:
    """The change log between two snapshots of a table."""
    found = state.changes_between(source(spark, sf_dir, "customer"), dest(spark, sf_dir, "customer"), ["c_custkey"])
    return found.groupBy("operation").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"), F.count("old_row").alias("old_rows"), F.count("new_row").alias("new_rows"))


def reconciled(name: str):
    return lambda spark, sf_dir: verify.row_differences(source(spark, sf_dir, name), dest(spark, sf_dir, name), [TABLES[name][0]])


def reconciled_sql(name: str) -> str:
    key, columns = TABLES[name]
    rest = [c.split()[0] for c in columns if c.split()[0] != key]
    differ = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in rest)
    return f"SELECT coalesce(a.{key}, b.{key}) AS {key}, CASE WHEN b.{key} IS NULL THEN 'missing_in_destination' WHEN a.{key} IS NULL THEN 'missing_in_source' ELSE 'content_mismatch' END AS kind FROM ({side_sql(name, 0)}) a FULL OUTER JOIN ({side_sql(name, 1)}) b ON a.{key} = b.{key} WHERE a.{key} IS NULL OR b.{key} IS NULL OR {differ}"


def counted(spark, sf_dir: str) -> DataFrame:
    a, b = both(spark, sf_dir)
    left, right = verify.counts(spark, a).withColumnRenamed("rows", "source_count"), verify.counts(spark, b).withColumnRenamed("rows", "dest_count")
    return left.join(right, ["database", "table"]).select("table", "source_count", "dest_count")


QUERIES = {
    "verify_count": counted,
    "row_reconcile": reconciled("orders"),
    "row_reconcile_summary": lambda spark, sf_dir: reconciled("customer")(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key")),
    "keyset_page": lambda spark, sf_dir: copying.page(t(spark, sf_dir, "lineitem").select(*LINE, "l_quantity"), LINE, None, 100),
    "keyset_resume": lambda spark, sf_dir: copying.page(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], (100,), 50),
    "keyset_resume_two_keys": lambda spark, sf_dir: copying.page(t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey", "n_nationkey"], (1, 3), 10),
    "offset_page": lambda spark, sf_dir: copying.offset_page(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 30, 10),
    "resume_cursor": lambda spark, sf_dir: t(spark, sf_dir, "nation").agg(F.max(F.struct("n_regionkey", "n_nationkey")).alias("m")).select("m.*"),
    "dest_empty": lambda spark, sf_dir: copying.union_all([spark.range(1).select(F.lit(n).alias("name"), F.lit(t(spark, sf_dir, "orders").filter(c).isEmpty()).alias("empty")) for n, c in (("all", "true"), ("none", "o_orderkey < 0"))]),
    "source_watermark": lambda spark, sf_dir: copying.watermark(events_log(spark, sf_dir)),
    "watermark_unavailable": lambda spark, sf_dir: copying.watermark(events_log(spark, sf_dir).limit(0)),
    "orphans": lambda spark, sf_dir: copying.orphans(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], t(spark, sf_dir, "customer").filter("c_custkey % 50 <> 7"), ["c_custkey"]).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order")),
    "rehearsal_counts": lambda spark, sf_dir: copying.invalid_rows(dest(spark, sf_dir, "customer").withColumn("c_custkey", F.col("c_custkey").cast("string")), ["c_name"], {"c_custkey": "smallint"}),
    "changes_between_snapshots": snapshot_log,
}
SQL = {
    "verify_count": " UNION ALL ".join(f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM ({side_sql(n, 0)})) AS source_count, (SELECT count(*) FROM ({side_sql(n, 1)})) AS dest_count" for n in TABLES),
    "row_reconcile": reconciled_sql("orders"),
    "row_reconcile_summary": f"SELECT kind, count(*) AS n, min(c_custkey) AS first_key FROM ({reconciled_sql('customer')}) GROUP BY kind",
    "keyset_page": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY 1, 2 LIMIT 100",
    "keyset_resume": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 50",
    "keyset_resume_two_keys": "SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE (n_regionkey, n_nationkey) > (1, 3) ORDER BY 1, 2 LIMIT 10",
    "offset_page": "SELECT c_custkey, c_name FROM customer ORDER BY 1 LIMIT 10 OFFSET 30",
    "resume_cursor": "SELECT n_regionkey, n_nationkey FROM nation ORDER BY 1 DESC, 2 DESC LIMIT 1",
    "dest_empty": "SELECT 'all' AS name, NOT EXISTS (SELECT 1 FROM orders) AS empty UNION ALL SELECT 'none', NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey < 0)",
    "source_watermark": "SELECT 'bin.000001' AS file, max(event_id) AS pos FROM events",
    "watermark_unavailable": "SELECT 'unavailable' AS file, CAST(0 AS BIGINT) AS pos",
    "orphans": "SELECT count(*) AS n, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7)",
    "rehearsal_counts": f"SELECT count(*) AS rows, count(*) FILTER (WHERE c_name IS NULL) AS null_violations, count(*) FILTER (WHERE c_custkey > 32767) AS cast_failures FROM ({side_sql('customer', 1)})",
    "changes_between_snapshots": f"SELECT CASE kind WHEN 'missing_in_destination' THEN 'delete' WHEN 'missing_in_source' THEN 'insert' ELSE 'update' END AS operation, count(*) AS n, min(c_custkey) AS first_key, count(*) FILTER (WHERE kind <> 'missing_in_source') AS old_rows, count(*) FILTER (WHERE kind <> 'missing_in_destination') AS new_rows FROM ({reconciled_sql('customer')}) GROUP BY 1",
}
