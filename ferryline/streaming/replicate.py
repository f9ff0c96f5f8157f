"""Bounded replication runs as a stream: files of an ordered change log are folded into a keyed table, bucket by bucket.

Rows of the target are dealt to buckets by a hash of the key.  A micro-batch reads and rewrites only the buckets its changes fall in,
each to a folder of the batch, then moves a manifest that names the folder of every bucket, the batch and the position reached.
So a batch that is repeated finds itself done, a reader sees one version, and folders that no manifest names any more are
deleted with the next batch.  Changes that come below the position reached are refused, not dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as store
from ..operators.changelog import POLICIES, applied, conflicts

SCHEMA = "pos long, op string, k long, v string"
ROWS = "k long, v string"


class Stopped(RuntimeError):
    """A run that may not go on; nothing of the batch was applied."""


def ready(settings: dict[str, str]) -> None:
    """The log must be on, hold rows, and hold them whole."""
    for name, fine in (("log_bin", ("1", "ON", "TRUE")), ("binlog_format", ("ROW",)), ("binlog_row_image", ("FULL",))):
        if str(settings.get(name, "")).strip().upper() not in fine:
            raise Stopped(f"{name} must be {fine[-1] if name != 'log_bin' else 'ON'}, is {settings.get(name)!r}")


def fold(current: DataFrame, changes: DataFrame, policy: str = "source-wins") -> DataFrame:
    """State (k, v) after ``changes`` (pos, op, k, v) in order of position."""
    return applied(current, ["k"], changes.withColumnRenamed("pos", "seq").withColumn("place", F.lit(0)), policy)


class Manifest:
    """Which folder holds each bucket; kept beside the target by whatever store holds it."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.path = spark, f"{target.rstrip('/')}/manifest.json"
        jvm = spark.sparkContext._jvm
        self.Path, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self.files, self.io = self.Path(self.path).getFileSystem(conf), jvm.org.apache.commons.io.IOUtils

    def read(self) -> dict:
        for path in (self.path, f"{self.path}.next"):  # a run may have ended between removing the old and moving the new
            if self.files.exists(self.Path(path)):
                stream = self.files.open(self.Path(path))
                try:
                    return json.loads(self.io.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return {"batch": -1, "pos": -1, "buckets": {}}

    def write(self, state: dict) -> None:
        new = self.Path(f"{self.path}.next")
        stream = self.files.create(new, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        self.files.delete(self.Path(self.path), False)
        self.files.rename(new, self.Path(self.path))


def read(spark: SparkSession, target: str, buckets: list[int] | None = None) -> DataFrame:
    """The current version, or some of its buckets."""
    held = Manifest(spark, target).read()["buckets"]
    paths = sorted(p for b, p in held.items() if buckets is None or int(b) in buckets)
    return spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)


def run(spark: SparkSession, log_dir: str, target: str, checkpoint: str, *, policy: str = "source-wins", buckets: int = 16, settings: dict[str, str] | None = None) -> DataFrame:
    """Apply all that the log holds and has not been applied, then stop; returns the current version."""
    if policy not in POLICIES:
        raise ValueError(f"unsupported conflict policy {policy!r}")
    if settings is not None:
        ready(settings)
    manifest = Manifest(spark, target)
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        if number > manifest.read()["batch"]:
            with store.owning(spark) as own:
                advance(batch, number)
                own.drop()

    def advance(batch: DataFrame, number: int) -> None:
        done = manifest.read()
        batch = store.cut(batch.withColumn("bucket", bucket))
        span = batch.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("bucket").alias("touched")).first()  # at most ``buckets`` numbers
        if span["low"] is None:
            return
        if span["low"] <= done["pos"]:
            raise Stopped(f"change at {span['low']} comes after position {done['pos']} was applied")
        current = read(spark, target, span["touched"])
        if policy == "fail":
            first = conflicts(current, ["k"], batch.withColumnRenamed("pos", "seq").withColumn("place", F.lit(0))).limit(1).collect()
            if first:
                raise Stopped(f"{first[0]['failure_type']} at {first[0]['seq']}")
        folder = f"{target.rstrip('/')}/batch-{number:08d}"
        fold(current, batch.drop("bucket"), policy).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        held, old = dict(done["buckets"]), set(done["buckets"].values())
        for b in span["touched"]:
            part = f"{folder}/bucket={b}"
            held.pop(str(b), None)
            if store.exists(spark, part):  # a bucket may have lost all its rows
                held[str(b)] = part
        manifest.write({"batch": number, "pos": span["high"], "buckets": held})
        for gone in old - set(held.values()):
            store.delete(spark, gone)

    stream = spark.readStream.schema(SCHEMA).parquet(log_dir)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read(spark, target)
