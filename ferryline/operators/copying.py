"""Key-ordered chunked copies of tables that can be resumed, with a ledger, a work list and a rehearsal that leaves nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import tables as store
from .digest import Incompatible

CHUNK_ROWS, WORKERS = 1000, 4


def after(df: DataFrame, keys: list[str], cursor: tuple | None) -> DataFrame:
    """Rows beyond the cursor in key order; the plain bound on the first key reaches the scan."""
    if cursor is None:
        return df
    beyond = F.struct(*keys) > F.struct(*[F.lit(c).cast(df.schema[k].dataType).alias(k) for k, c in zip(keys, cursor)])
    return df.filter((F.col(keys[0]) >= F.lit(cursor[0])) & beyond)


def page(df: DataFrame, keys: list[str], cursor: tuple | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    return after(df, keys, cursor).orderBy(*keys).limit(rows)


def offset_page(df: DataFrame, keys: list[str], offset: int, rows: int) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(rows)


def pinned(df: DataFrame) -> DataFrame:
    """``df``, read from files, over the files that are there now: what is written to the folder later is not seen."""
    files = df.inputFiles()
    return df.sparkSession.read.schema(df.schema).parquet(*files) if files else df.limit(0)


def cursor_of(df: DataFrame, keys: list[str]) -> tuple | None:
    """The greatest key that ``df`` holds, to resume from."""
    top = df.agg(F.max(F.struct(*keys)).alias("m")).first()["m"]
    return tuple(top) if top is not None else None


def is_empty(spark: SparkSession, path: str) -> bool:
    """Has the table at ``path`` no row (or is there no table)?"""
    return not store.exists(spark, path) or spark.read.parquet(path).limit(1).isEmpty()


def resume(source: DataFrame, dest_path: str, keys: list[str], cursor: tuple | None = None) -> int:
    """Append what the destination lacks beyond ``cursor``, by default its greatest key; one scan.  Rows copied."""
    spark = source.sparkSession
    there = store.exists(spark, dest_path)
    if cursor is None and there:
        cursor = cursor_of(spark.read.parquet(dest_path), keys)
    before = spark.read.parquet(dest_path).count() if there else 0  # footers only
    after(source, keys, cursor).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append").parquet(dest_path)
    return spark.read.parquet(dest_path).count() - before


@dataclass
class Entry:
    """What a ledger knows of one table."""

    key_columns: list[str] = field(default_factory=list)
    cursor: list | None = None
    rows_copied: int = 0
    done: bool = False
    watermark: str = ""


def resume_point(entry: Entry | None, keys: list[str], dest_cursor: tuple | None) -> tuple[str, tuple | None]:
    """``skip`` a finished table, go on ``from`` the ledger's cursor where it fits the key, from the destination's greatest key where
    rows were copied without one, else from the ``start``."""
    if entry and entry.done:
        return "skip", None
    if entry and entry.cursor is not None and len(entry.cursor) == len(keys) and (len(entry.key_columns) != len(keys) or entry.key_columns == keys):
        return "from", tuple(entry.cursor)
    if entry and entry.rows_copied > 0 and dest_cursor is not None:
        return "from", dest_cursor
    return "start", None


def copy_tables(spark: SparkSession, source: Mapping[str, DataFrame], dest_folder: str, keys: Mapping[str, list[str]], ledger: dict[str, Entry], *, order: list[str] | None = None, workers: int = WORKERS, save=lambda ledger: None, rehearse: bool = False, watermark: str = "unavailable") -> dict[str, int]:
    """Copy each table of ``source`` to ``dest_folder/name``; the ledger is saved after each.  Rows copied by table.

    Tables start in ``order``; the first failure cancels those that have not started.  A table without columns is done at once, one
    without a stable key is refused.  A rehearsal writes to folders of its own, counts what arrived and deletes them.
    """
    names = [n for n in (order or sorted(source)) if n in source]
    for n in names:
        if source[n].columns and not keys.get(n):
            raise Incompatible(f"incompatible_for_v1_copy: {n} has no stable key")

    def one(name: str) -> int:
        df, entry = source[name], ledger.setdefault(name, Entry(watermark=watermark))
        if entry.done and not rehearse:
            return 0
        if not df.columns:
            entry.done = True
            return 0
        path = f"{dest_folder.rstrip('/')}/{name}"
        if rehearse:
            trial = f"{dest_folder.rstrip('/')}/.rehearsal-{uuid.uuid4().hex}/{name}"
            try:
                return resume(df, trial, keys[name])
            finally:
                store.delete(spark, trial.rpartition("/")[0])
        there = cursor_of(spark.read.parquet(path), keys[name]) if store.exists(spark, path) else None
        how, cursor = resume_point(entry, keys[name], there)
        if how == "start" and there is not None:
            cursor = there  # an interrupted append: what is there stays
        copied = resume(df, path, keys[name], cursor)
        last = cursor_of(spark.read.parquet(path), keys[name])
        ledger[name] = Entry(list(keys[name]), list(last) if last else None, entry.rows_copied + copied, True, entry.watermark)
        return copied

    out: dict[str, int] = {}
    with ThreadPoolExecutor(max(1, workers)) as pool:
        running = {pool.submit(one, n): n for n in names}
        while running:
            done, _ = wait(running, return_when=FIRST_EXCEPTION)
            for f in done:
                name = running.pop(f)
                if f.exception():
                    for other in running:
                        other.cancel()
                    raise f.exception()
                out[name] = f.result()
                save(ledger)
    return out


def ledger_text(ledger: dict[str, Entry]) -> str:
    return json.dumps({n: vars(e) for n, e in sorted(ledger.items())}, default=str, sort_keys=True)


def chunk_ledger(df: DataFrame, keys: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, first, last, rows) of chunks of so many rows in key order."""
    from .ordering import numbered

    placed = numbered(df.select(*keys), keys).withColumn("chunk", F.expr(f"(row_number - 1) div {rows}"))
    return placed.groupBy("chunk").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"), F.count("*").alias("rows"))


def invalid_rows(df: DataFrame, not_null: list[str], casts: Mapping[str, str]) -> DataFrame:
    """(rows, null_violations, cast_failures): what a destination would refuse of ``df``, without writing."""
    nulls = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in not_null), F.lit(False))
    lost = reduce(lambda a, b: a | b, (F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in casts.items()), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(nulls).alias("null_violations"), F.count_if(lost).alias("cast_failures"))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of ``child`` whose reference is set and finds no row of ``parent``: the check after a load without checks."""
    on = parent.select(*(F.col(p).alias(c) for p, c in zip(parent_columns, columns))).distinct()
    return child.filter(" and ".join(f"`{c}` is not null" for c in columns)).join(on, columns, "left_anti")


def watermark(events: DataFrame) -> DataFrame:
    """(file, pos) of the last event there is, the point from which changes are replayed after a copy; ``unavailable`` without events."""
    last = events.agg(F.max_by(F.struct("file", "pos"), text.position(F.col("file"), F.col("pos"))).alias("l"))
    return last.select(F.coalesce("l.file", F.lit("unavailable")).alias("file"), F.coalesce("l.pos", F.lit(0).cast("long")).alias("pos"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
