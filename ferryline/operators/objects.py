"""Copying what is not rows: schema objects and accounts, as ordered statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import graph
from .catalog import Catalog, selected, within

TYPES = ("table", "view", "procedure", "function", "trigger", "event")
LATER = ("procedure", "function", "trigger", "event")
SYSTEM_USERS = ("root", "mysql.sys", "mysql.session", "mysql.infoschema", "mariadb.sys", "PUBLIC")  # fixed values: accounts of the server


def schema_statements(catalog: Catalog, scope: DataFrame, types: tuple[str, ...] = ("table", "view"), run_id: str | None = None) -> DataFrame:
    """(database, place, object_type, name, statement) in the order of application: the database, tables so that what a table
    needs comes first, views by name, then routines, triggers and events.  With ``run_id`` statements go to rehearsal databases."""
    if unknown := sorted(set(types) - set(TYPES)):
        raise ValueError(f"unsupported object types: {', '.join(unknown)}")
    spark = catalog.spark
    found = within(catalog.objects, scope).filter(F.col("object_type").isin(*types))
    links = graph.edges(catalog, scope)
    # the order of tables is found on the driver: names only, as many as the catalog has
    names: dict[str, list[str]] = {}
    for r in found.filter("object_type = 'table'").select("database", "name").collect():
        names.setdefault(r["database"], []).append(r["name"])
    needs: dict[str, list[tuple[str, str]]] = {}
    for r in links.collect():
        needs.setdefault(r["database"], []).append((r["table"], r["needs"]))
    placed = [(d, t, i) for d, ts in names.items() for i, t in enumerate(graph.copy_order(ts, needs.get(d, []))[0])]
    order = spark.createDataFrame(placed, "database string, name string, rank int")
    target = text.sandbox_name(run_id, F.col("database")) if run_id else F.col("database")
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("object_type"))
    body = text.own_definer(F.col("create_sql"))
    body = text.moved_to(body, F.col("database"), target) if run_id else body
    objects = found.join(F.broadcast(order), ["database", "name"], "left").select("database", kind.cast("int").alias("kind"), F.coalesce(F.when(F.col("object_type") == "table", F.col("rank")), F.lit(0)).alias("rank"), "object_type", "name", body.alias("statement"))
    bases = scope.select("database", F.lit(0).alias("kind"), F.lit(0).alias("rank"), F.lit("database").alias("object_type"), target.alias("name"), F.concat(F.lit("CREATE DATABASE IF NOT EXISTS "), text.quoted(target)).alias("statement"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("database").orderBy("kind", "rank", "name"))
    return bases.unionByName(objects).withColumn("place", place).select("database", "place", "object_type", "name", "statement").orderBy("database", "place")


def sandbox_drops(scope: DataFrame, run_id: str) -> DataFrame:
    """(statement) that removes the rehearsal databases of a run, each once, in order."""
    return scope.select(F.concat(F.lit("DROP DATABASE IF EXISTS "), text.quoted(text.sandbox_name(run_id, F.col("database")))).alias("statement")).distinct().orderBy("statement")


def apply_statements(spark: SparkSession, statements: DataFrame) -> int:
    """Run catalog statements in their order, one after the other, in this session; how many."""
    n = 0
    for r in statements.orderBy("database", "place").toLocalIterator():
        spark.sql(r["statement"])
        n += 1
    return n


def destination_empty(catalog: Catalog, exclude: list[str] = ()) -> bool:
    scope = selected(catalog.tables.select("database").distinct(), exclude=list(exclude))
    return within(catalog.tables, scope).isEmpty()


def skipped_account(business_only: bool):
    u = F.col("user")
    return F.lit(business_only) & (u.isin(*SYSTEM_USERS) | u.endswith(".sys") | u.endswith(".session") | u.endswith(".infoschema"))


def account_statements(catalog: Catalog, business_only: bool = True) -> DataFrame:
    """(user, host, place, statement): CREATE USER, then grants in order, usage alone left out, then the flush that makes them count."""
    kept = catalog.accounts.filter(~skipped_account(business_only))
    grants = F.array_sort(F.filter(F.coalesce("grants", F.array().cast("array<string>")), lambda g: ~F.upper(g).startswith("GRANT USAGE ON")))
    return kept.select("user", "host", F.posexplode(F.concat(F.array(F.trim("create_sql")), grants, F.array(F.lit("FLUSH PRIVILEGES")))).alias("place", "statement")).orderBy("user", "host", "place")


def account_counts(catalog: Catalog, business_only: bool = True) -> DataFrame:
    """(seen, skipped, copied)."""
    skip = skipped_account(business_only)
    return catalog.accounts.agg(F.count("*").alias("seen"), F.count_if(skip).alias("skipped"), F.count_if(~skip).alias("copied"))
