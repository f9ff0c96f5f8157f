"""Do two sides have the same schema?  Whole definitions by object, or columns, indexes, foreign keys and partitions apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .catalog import Catalog

OBJECT_TYPES = ("table", "view", "procedure", "function", "trigger", "event")
NAMED = ["database", "table", "name"]


def _part(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f" {label}="), value)).otherwise("")


def _listed(order: str, column: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), ",")


def column_signatures(catalog: Catalog) -> DataFrame:
    default = F.when(F.col("default").isNull(), "").otherwise(F.concat(F.lit(" default="), "default"))
    signature = F.concat(F.lower(F.trim("column_type")), F.lit(" nullable="), "nullable", default, _part("extra", F.lower(F.trim("extra"))), _part("charset", F.lower("charset")), _part("collation", F.lower("collation")))
    return catalog.columns.select("database", "table", F.col("column").alias("name"), signature.alias("signature"))


def index_signatures(catalog: Catalog) -> DataFrame:
    first = lambda c: F.min_by(c, "seq")
    found = catalog.index_parts.groupBy("database", "table", F.col("index").alias("name")).agg(first("index_type").alias("kind"), first("non_unique").alias("open"), _listed("seq", "column").alias("cols"))
    unique = F.when(F.col("open") != 0, "non_unique").otherwise("unique")
    return found.select(*NAMED, F.concat(F.lit("type="), F.lower("kind"), F.lit(" unique="), unique, F.lit(" cols="), "cols").alias("signature"))


def fk_signatures(catalog: Catalog) -> DataFrame:
    first = lambda c: F.min_by(c, "ordinal")
    found = catalog.fk_parts.groupBy("database", "table", F.col("constraint").alias("name")).agg(first("ref_table").alias("ref"), first("update_rule").alias("upd"), first("delete_rule").alias("del"), _listed("ordinal", "column").alias("cols"), _listed("ordinal", "ref_column").alias("refs"))
    return found.select(*NAMED, F.concat(F.lit("ref="), "ref", F.lit("("), "refs", F.lit(") on_update="), F.upper("upd"), F.lit(" on_delete="), F.upper("del"), F.lit(" cols="), "cols").alias("signature"))


def partition_signatures(catalog: Catalog) -> DataFrame:
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    signature = F.concat(F.lit("method="), text_of("method"), F.lit(" expr="), text_of("expression"), F.lit(" desc="), text_of("description"), F.lit(" pos="), F.col("ordinal").cast("string"))
    return catalog.partitions.filter("partition is not null").select("database", "table", F.col("partition").alias("name"), signature.alias("signature"))


PARTS = {"column": column_signatures, "index": index_signatures, "fk": fk_signatures, "partition": partition_signatures}


def common_tables(source: Catalog, dest: Catalog) -> DataFrame:
    """Tables that both sides have: only their parts are compared."""
    of = lambda c: c.tables.filter("table_type = 'BASE TABLE'").select("database", "table")
    return of(source).intersect(of(dest))


def part_differences(source: Catalog, dest: Catalog, parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """(database, table, kind, object_name, source_def, dest_def) of tables on both sides, in order."""
    both, found = common_tables(source, dest), []
    for part in parts:
        a = PARTS[part](source).join(both, ["database", "table"], "left_semi").withColumnRenamed("signature", "source_def")
        b = PARTS[part](dest).join(both, ["database", "table"], "left_semi").withColumnRenamed("signature", "dest_def")
        kind = F.when(F.col("dest_def").isNull(), f"{part}_missing_in_destination").when(F.col("source_def").isNull(), f"{part}_extra_in_destination").when(F.col("source_def") != F.col("dest_def"), f"{part}_definition_mismatch")
        found.append(a.join(b, NAMED, "full_outer").withColumn("kind", kind).filter("kind is not null"))
    shown = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return reduce(DataFrame.unionByName, found).select("database", "table", "kind", F.col("name").alias("object_name"), shown("source_def"), shown("dest_def")).orderBy("database", "table", "kind", "object_name")


def object_differences(source: DataFrame, dest: DataFrame, types: tuple[str, ...] = OBJECT_TYPES) -> DataFrame:
    """(kind, database, object_type, object_name, source_create_sql, dest_create_sql) where normalised definitions differ, in order."""
    of = ["database", "object_type", "name"]
    side = lambda df, p: df.filter(F.col("object_type").isin(*types)).select(*of, F.col("create_sql").alias(f"{p}_create_sql"), text.normal_statement(F.col("create_sql")).alias(f"{p}_normal"))
    kind = F.when(F.col("dest_normal").isNull(), "missing_in_destination").when(F.col("source_normal").isNull(), "missing_in_source").when(F.col("source_normal") != F.col("dest_normal"), "definition_mismatch")
    found = side(source, "source").join(side(dest, "dest"), of, "full_outer").withColumn("kind", kind).filter("kind is not null")
    shown = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.select("kind", "database", "object_type", F.col("name").alias("object_name"), shown("source_create_sql"), shown("dest_create_sql")).orderBy("database", "object_type", "object_name", "kind")
