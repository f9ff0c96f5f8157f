"""What a server tells of itself, as frames: databases, tables, columns, keys, objects, accounts, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Schemas that belong to the server.
SYSTEM_SCHEMAS = ("information_schema", "performance_schema", "mysql", "sys")

FRAMES = {
    "databases": "database string, collation string",
    "tables": "database string, table string, table_type string, engine string, collation string, create_sql string",
    "columns": "database string, table string, column string, ordinal int, data_type string, column_type string, nullable string, default string, extra string, charset string, collation string, column_key string",
    "index_parts": "database string, table string, index string, non_unique int, seq int, column string, index_type string, visible string",
    "fk_parts": "database string, table string, constraint string, ordinal int, column string, ref_database string, ref_table string, ref_column string, update_rule string, delete_rule string",
    "partitions": "database string, table string, partition string, method string, expression string, description string, ordinal int",
    "objects": "database string, object_type string, name string, create_sql string",
    "accounts": "user string, host string, plugin string, create_sql string, grants array<string>",
    "plugins": "name string, status string, type string",
    "engines": "engine string, support string",
    "collations": "name string",
    "keywords": "word string, reserved int",
    "settings": "name string, value string",
    "triggers": "database string, table string, trigger string",
    "sequences": "database string, name string",
}


class Catalog:
    """The frames of one server; what it does not have is an empty frame."""

    def __init__(self, spark: SparkSession, **frames: DataFrame):
        if unknown := set(frames) - set(FRAMES):
            raise ValueError(f"no such catalog frames: {sorted(unknown)}")
        self.spark, self._frames = spark, frames

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FRAMES:
            raise AttributeError(name)
        return self._frames.get(name) or self.spark.createDataFrame([], ", ".join(f"`{c.rpartition(' ')[0]}` {c.rpartition(' ')[2]}" for c in FRAMES[name].split(", ")))

    def setting(self, *names: str) -> str | None:
        """The first of the settings that the server has; names are few and each has one value."""
        known = {r["name"].lower(): r["value"] for r in self.settings.filter(F.lower("name").isin([n.lower() for n in names])).limit(len(names) * 2).collect()}
        return next((known[n.lower()] for n in names if known.get(n.lower()) is not None), None)

    def instance(self):
        """(engine, raw_version, major, minor, patch, parsed, version) of the server."""
        one = self.spark.range(1).select(text.version(F.lit(self.setting("version") or "")).alias("v"))
        return one.first()["v"]


def selected(databases: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Databases in scope, in order: system schemas never, excluded ones not, of a non-empty ``include`` these alone; case is ignored."""
    fold = lambda items: [x.strip().lower() for x in items if x and x.strip()]
    name = F.lower(F.trim("database"))
    kept = databases.filter(~name.isin([*SYSTEM_SCHEMAS, *fold(exclude)]))
    if wanted := fold(include):
        kept = kept.filter(name.isin(wanted))
    return kept.select("database").distinct().orderBy("database")


def selected_for_capture(databases: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The scope of the trigger log: as ``selected``, but names are taken as they are, neither trimmed nor ordered."""
    name = F.lower("database")
    kept = databases.filter(~name.isin([*SYSTEM_SCHEMAS, *(x.lower() for x in exclude)]))
    return (kept.filter(name.isin([x.lower() for x in include])) if include else kept).select("database")


def within(frame: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of a catalog frame whose database is in scope."""
    return frame.join(scope.select("database"), "database", "left_semi")


def base_tables(catalog: Catalog, scope: DataFrame) -> DataFrame:
    return within(catalog.tables, scope).filter("table_type = 'BASE TABLE'").select("database", "table").orderBy("database", "table")


def column_list(catalog: Catalog) -> DataFrame:
    """Columns in the order of their definition, types in lower case."""
    return catalog.columns.select("database", "table", "column", "ordinal", F.lower("data_type").alias("data_type"), "charset", "collation").orderBy("database", "table", "ordinal")


def not_null_columns(catalog: Catalog) -> DataFrame:
    return catalog.columns.filter("nullable = 'NO'").select("database", "table", "column")


def stable_keys(catalog: Catalog) -> DataFrame:
    """(database, table, index, columns): the first index that tells all rows apart - unique, all columns NOT NULL, the primary key first, then by name."""
    of = ["database", "table", "column"]
    parts = catalog.index_parts.join(not_null_columns(catalog).withColumn("filled", F.lit(True)), of, "left")
    whole = parts.groupBy("database", "table", "index").agg(F.max("non_unique").alias("non_unique"), F.count_if(F.col("filled").isNull()).alias("open"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "column"))), lambda x: x["column"]).alias("columns"))
    rank = F.struct((F.col("index") != "PRIMARY").alias("later"), "index", "columns")
    best = whole.filter("non_unique = 0 and open = 0").groupBy("database", "table").agg(F.min(rank).alias("k"))
    return best.select("database", "table", "k.index", "k.columns")


def replay_keys(catalog: Catalog) -> DataFrame:
    """(database, table, columns, has_foreign_keys): what changes are matched by; the stable key, as for copies."""
    linked = catalog.fk_parts.select("database", "table").distinct().withColumn("has_foreign_keys", F.lit(True))
    tables = catalog.tables.select("database", "table").join(stable_keys(catalog), ["database", "table"], "left").join(linked, ["database", "table"], "left")
    return tables.select("database", "table", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), F.coalesce("has_foreign_keys", F.lit(False)).alias("has_foreign_keys"))


def keyless_tables(catalog: Catalog, scope: DataFrame) -> DataFrame:
    return base_tables(catalog, scope).join(stable_keys(catalog), ["database", "table"], "left_anti").orderBy("database", "table")


def table_counts(catalog: Catalog, exclude: list[str] = ()) -> DataFrame:
    """(database, tables) of user databases: a destination is empty where there is no row."""
    return within(catalog.tables, selected(catalog.tables.select("database").distinct(), exclude=list(exclude))).groupBy("database").agg(F.count("*").alias("tables"))


def primary_key_parts(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """(database, table, column, ordinal) of primary keys, from (database, table, constraint, constraint_type) and key column usage
    (database, table, constraint, column, ordinal); parts by number, not by the order of the text."""
    on = ["database", "table", "constraint"]
    keys = constraints.filter("constraint_type = 'PRIMARY KEY'").select(*on)
    return usage.join(keys, on, "left_semi").select("database", "table", "column", F.col("ordinal").cast("int").alias("ordinal")).orderBy("database", "table", "ordinal")


def fk_parts_of(referential: DataFrame, usage: DataFrame) -> DataFrame:
    """The ``fk_parts`` frame from rules (database, table, constraint, update_rule, delete_rule) and key column usage with references."""
    on = ["database", "table", "constraint"]
    found = usage.filter("ref_table is not null").join(referential.select(*on, "update_rule", "delete_rule"), on)
    return found.select(*on, F.col("ordinal").cast("int").alias("ordinal"), "column", "ref_database", "ref_table", "ref_column", "update_rule", "delete_rule")


def settings_row(catalog: Catalog, *names: str) -> DataFrame:
    """One row with a column for each of the settings named, null where the server lacks it."""
    wide = catalog.settings.filter(F.lower("name").isin([n.lower() for n in names]))
    return wide.agg(*(F.max(F.when(F.lower("name") == n.lower(), F.col("value"))).alias(n) for n in names))
