"""A server as a folder of Parquet: ``catalog/<frame>.parquet``, ``tables/<database>/<table>`` and ``log`` (change events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as store
from ..operators.catalog import FRAMES, Catalog, base_tables, selected, stable_keys, within


class Server:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not store.exists(spark, f"{self.path}/catalog"):
            raise FileNotFoundError(f"{path} holds no catalog")

    def catalog(self) -> Catalog:
        there = {n: f"{self.path}/catalog/{n}.parquet" for n in FRAMES}
        return Catalog(self.spark, **{n: self.spark.read.parquet(p) for n, p in there.items() if store.exists(self.spark, p)})

    def scope(self, include=(), exclude=()) -> DataFrame:
        return selected(self.catalog().databases, list(include), list(exclude))

    def path_of(self, database: str, table: str) -> str:
        return f"{self.path}/tables/{database}/{table}"

    def table(self, database: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path_of(database, table))

    def names(self, scope: DataFrame) -> list[tuple[str, str]]:
        """Base tables in scope whose rows are here; names are as many as the catalog has."""
        found = [(r["database"], r["table"]) for r in base_tables(self.catalog(), scope).collect()]
        return [n for n in found if store.exists(self.spark, self.path_of(*n))]

    def keys(self) -> dict[tuple[str, str], list[str]]:
        return {(r["database"], r["table"]): r["columns"] for r in stable_keys(self.catalog()).collect()}

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log")

    def write_catalog(self, name: str, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/catalog/{name}.parquet")

    def views(self, scope: DataFrame) -> DataFrame:
        return within(self.catalog().objects, scope).filter(F.col("object_type") == "view")
