"""Tables written on the way, in the folder all machines share, and who owns them.

``cut`` ends a lineage: it writes a frame and reads it back.  What a call writes belongs to the frame it returns, so frames do not
disturb each other; ``release`` deletes it, and shuffle files go with the query that made them.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see, ``spark.checkpoint.dir``; set here only where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not existing.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines see")
        folder = existing.get() if existing.isDefined() else "file:///tmp/checkpoints/ferryline"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Tables:
    """Folders that ``cut`` wrote for one call.  The frame that the call returns carries them; nobody else deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.shared = spark, [], []

    def forget(self) -> None:
        """Destroy the broadcasts of this owner, on all machines."""
        for b in self.shared:
            b.destroy()
        self.shared = []

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables of this owner that ``frames`` read; without frames, all."""
        read = "\n".join(f for t in frames for f in t.inputFiles())
        gone = [p for p in self.paths if not frames or p.rpartition("/")[2] in read]
        self.paths = [p for p in self.paths if p not in gone]
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for p in gone:
            path = jvm.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop_since(self, before: list[str]) -> None:
        """Delete what was written after the paths were ``before``."""
        kept, self.paths = before, [p for p in self.paths if p not in before]
        self.drop()
        self.paths = kept


_OWNER: ContextVar[Tables | None] = ContextVar("owner", default=None)


@contextmanager
def owning(spark: SparkSession):
    """What ``cut`` writes inside belongs to the owner given; an operator called inside shares it."""
    outer = _OWNER.get()
    own = Tables(spark) if outer is None else outer
    token = _OWNER.set(own)
    try:
        with tidy_shuffles(spark):
            yield own
    except BaseException:
        if outer is None:
            own.drop()
        raise
    finally:
        _OWNER.reset(token)


def owned(operator):
    """For functions of a frame that return one: the tables written on the way belong to the frame returned (``release``)."""

    @wraps(operator)
    def call(df: DataFrame, *args, **kwargs):
        with owning(df.sparkSession) as own:
            out = operator(df, *args, **kwargs)
        if isinstance(out, DataFrame):
            out.tables = own
        return out

    return call


def drop(*frames: DataFrame) -> None:
    """Delete tables that the running call wrote and needs no more."""
    if own := _OWNER.get():
        own.drop(*frames)


def broadcast(spark: SparkSession, value):
    """A broadcast that goes with the tables of the running call."""
    shared = spark.sparkContext.broadcast(value)
    if own := _OWNER.get():
        own.shared.append(shared)
    return shared


def release(df: DataFrame) -> None:
    """Delete the tables and broadcasts that ``df`` owns, once it and what was made from it are not read any more."""
    if tables := df.__dict__.get("tables"):
        tables.drop()
        tables.forget()


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of a query that ends inside go with it, not when the driver happens to collect them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ferryline/{uuid.uuid4().hex}"
    if own := _OWNER.get():
        own.paths.append(path)
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
