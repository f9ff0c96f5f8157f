"""Do two sides hold the same data?  Counts, digests and samples of all tables, as differences with notes on noisy columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .digest import Incompatible, table_digest

Tables = Mapping[tuple[str, str], DataFrame]  # (database, table) -> rows

# The notes a table's columns call for.
NOTES = {
    "approximate_numeric_columns": "Approximate numeric columns can produce representation-sensitive hash noise; confirm with row samples if hashes drift.",
    "temporal_columns": "Temporal columns depend on session time_zone rendering; verify runs normalize sessions to UTC before hashing.",
    "json_columns": "JSON values are canonicalized before hashing, but semantic edge cases still deserve row-sample review.",
    "collation_sensitive_columns": "Text ordering and collation differences can create false positives if hashing depends on SQL sort order; row hashes are sorted client-side here.",
}
KINDS = {
    "approximate_numeric_columns": ("float", "double", "real"),
    "temporal_columns": ("timestamp", "datetime", "date", "time"),
    "json_columns": ("json",),
}


def union_of_names(*sides: DataFrame) -> DataFrame:
    """Distinct trimmed names of all sides, blanks dropped, in order."""
    names = reduce(DataFrame.union, (s.select(F.trim(s.columns[0]).alias("name")) for s in sides))
    return names.filter("name <> ''").distinct().orderBy("name")


def table_risks(columns: DataFrame) -> DataFrame:
    """(database, table, four counts, notes) from (database, table, data_type, collation) rows; tables without a note are left out."""
    kind = F.lower(F.trim("data_type"))
    counts = [F.count_if(kind.isin(*words)).alias(name) for name, words in KINDS.items()]
    counts.append(F.count_if(F.trim(F.coalesce("collation", F.lit(""))) != "").alias("collation_sensitive_columns"))
    notes = F.array_compact(F.array(*(F.when(F.col(name) > 0, F.lit(text)) for name, text in NOTES.items())))
    return columns.groupBy("database", "table").agg(*counts).withColumn("notes", notes).filter("size(notes) > 0").orderBy("database", "table")


def _collected(spark: SparkSession, tables: Tables, one, schema: str) -> DataFrame:
    rows = [one(df, database, table).select(F.lit(database).alias("database"), F.lit(table).alias("table"), "*") for (database, table), df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], f"database string, `table` string, {schema}")


def counts(spark: SparkSession, tables: Tables) -> DataFrame:
    """(database, table, rows): no key is needed."""
    return _collected(spark, tables, lambda df, *_: df.agg(F.count(F.lit(1)).alias("rows")), "rows long")


def digests(spark: SparkSession, tables: Tables, keys: Mapping[tuple[str, str], list[str]], mode: str, **options) -> DataFrame:
    """(database, table, digest); a table without a stable key is refused by name."""
    return _collected(spark, tables, lambda df, d, t: table_digest(df, keys.get((d, t), []), mode, name=f"{d}.{t}", **options).select("digest"), "digest string")


def _paired(source: DataFrame, dest: DataFrame, value: str, kind: str) -> DataFrame:
    a, b = source.select("database", "table", F.col(value).alias(f"source_{value}"), F.lit(1).alias("here")), dest.select("database", "table", F.col(value).alias(f"dest_{value}"), F.lit(1).alias("there"))
    why = F.when(F.col("there").isNull(), "missing_in_destination").when(F.col("here").isNull(), "missing_in_source").when(F.col(f"source_{value}") != F.col(f"dest_{value}"), kind)
    return a.join(b, ["database", "table"], "full_outer").withColumn("kind", why)


def count_differences(source: DataFrame, dest: DataFrame) -> DataFrame:
    """(kind, database, table, source_count, dest_count), a missing side counting 0, in order."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    found = _paired(source, dest, "rows", "row_count_mismatch").filter("kind is not null")
    return found.select("kind", "database", "table", zero("source_rows").alias("source_count"), zero("dest_rows").alias("dest_count")).orderBy("database", "table", "kind")


def digest_differences(source: DataFrame, dest: DataFrame, risks: DataFrame) -> DataFrame:
    """(kind, database, table, source_hash, dest_hash, noise_risk, notes); mismatches of noisy tables say so."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    noted = F.col("kind") == "table_hash_mismatch"
    found = _paired(source, dest, "digest", "table_hash_mismatch").filter("kind is not null").join(risks.select("database", "table", "notes"), ["database", "table"], "left")
    noise = F.when(noted & F.col("notes").isNotNull(), "representation_sensitive").otherwise("")
    notes = F.when(noted, F.coalesce("notes", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return found.select("kind", "database", "table", text("source_digest").alias("source_hash"), text("dest_digest").alias("dest_hash"), noise.alias("noise_risk"), notes.alias("notes")).orderBy("database", "table", "kind")


def summary(source: DataFrame, dest: DataFrame, differences: DataFrame) -> DataFrame:
    """One row: tables compared, missing on either side, mismatches of counts and hashes, and of those the noisy ones."""
    both = source.join(dest, ["database", "table"], "left_semi").agg(F.count(F.lit(1)).alias("compared_tables"))
    noisy = F.count_if(F.col("noise_risk") != "") if "noise_risk" in differences.columns else F.lit(0).cast("long")
    n = lambda k: F.count_if(F.col("kind") == k)
    found = differences.agg(n("missing_in_destination").alias("missing_in_destination"), n("missing_in_source").alias("missing_in_source"), n("row_count_mismatch").alias("count_mismatches"), n("table_hash_mismatch").alias("hash_mismatches"), noisy.alias("noise_risk_mismatches"))
    return both.crossJoin(found)  # one row each


def verify(spark: SparkSession, source: Tables, dest: Tables, mode: str, *, keys: Mapping[tuple[str, str], list[str]] | None = None, risks: DataFrame | None = None, **options) -> DataFrame:
    """Differences by ``mode``: ``count``, ``hash``, ``full-hash`` or ``sample``."""
    if mode == "count":
        return count_differences(counts(spark, source), counts(spark, dest))
    keys = keys or {}
    if missing := sorted({n for n, df in {**source, **dest}.items() if df.columns and not keys.get(n)}):
        raise Incompatible(f"incompatible_for_v1_{'sample' if mode == 'sample' else 'deterministic_hash'}: {', '.join('.'.join(n) for n in missing)} without a stable key")
    risks = risks if risks is not None else spark.createDataFrame([], "database string, `table` string, notes array<string>")
    return digest_differences(digests(spark, source, keys, mode, **options), digests(spark, dest, keys, mode, **options), risks)


def row_differences(source: DataFrame, dest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind) of rows on one side only, or whose content differs."""
    from ..functions.canonical import row_digest

    side = lambda df, n: df.select(*keys, row_digest(df).alias(n))
    kind = F.when(F.col("d").isNull(), "missing_in_destination").when(F.col("s").isNull(), "missing_in_source").when(F.col("s") != F.col("d"), "content_mismatch")
    return side(source, "s").join(side(dest, "d"), keys, "full_outer").withColumn("kind", kind).filter("kind is not null").select(*keys, "kind")
