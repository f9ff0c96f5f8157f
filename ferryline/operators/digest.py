"""Content digests of tables in key order, in three modes.

A table's rows are numbered in key order by ranges and gathered in chunks; a chunk's digest is over its row digests in order.
``hash`` and ``full-hash`` differ in chunk size and framing.  Chunk lines are digested in books of ``BOOK`` chunks and books in
the table, so no task holds more than a chunk's or a book's lines, except for one line a book (a table of 10**12 rows has
half a million books).  ``sample`` is over the first rows by key, which an ordered limit fetches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import row_digest
from .ordering import numbered

HASH_CHUNK, FULL_CHUNK, SAMPLE_ROWS, BOOK = 2000, 500, 1000, 4096
MODES = ("hash", "full-hash", "sample")
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes


class Incompatible(ValueError):
    """What cannot be compared as asked; the command line exits with 2."""


def in_order(line, order):
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), ""), F.lit(""))


def table_digest(df: DataFrame, keys: list[str], mode: str, *, name: str = "", sample: int = SAMPLE_ROWS, chunk: int | None = None, ranges: int | None = None) -> DataFrame:
    """One row (digest, rows, chunks) for the table ``df`` with stable ``keys``."""
    spark = df.sparkSession
    if mode not in MODES:
        raise ValueError(f"unsupported hash mode {mode!r}")
    if not df.columns:
        return spark.range(1).select(F.lit(NOTHING).alias("digest"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("chunks"))
    if not keys:
        raise Incompatible(f"incompatible_for_v1_{'sample' if mode == 'sample' else 'deterministic_hash'}: {name or 'table'} has no stable key")
    digested = df.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), row_digest(df).alias("digest"))
    order = [f"k{i}" for i in range(len(keys))]
    if mode == "sample":
        size = sample if sample >= 1 else SAMPLE_ROWS
        lines = digested.orderBy(*order).limit(size).agg(in_order(F.concat(F.lit("r:"), "digest", F.lit("\n")), F.struct(*order).alias("at")).alias("text"), F.count("*").alias("rows"))
        end = F.concat(F.lit("mode:sample rows:"), F.col("rows").cast("string"), F.lit("\n"))
        return lines.select(F.sha2(F.concat("text", end), 256).alias("digest"), "rows", F.lit(1).cast("long").alias("chunks"))
    size = chunk or (HASH_CHUNK if mode == "hash" else FULL_CHUNK)
    lead = "r:" if mode == "hash" else ""
    rows = numbered(digested, order, ranges=ranges).select(F.expr(f"(row_number - 1) div {size}").alias("chunk"), "row_number", "digest")
    chunks = rows.groupBy("chunk").agg(F.sha2(in_order(F.concat(F.lit(lead), "digest", F.lit("\n")), F.col("row_number")), 256).alias("digest"), F.count("*").alias("rows"))
    line = F.concat(F.lit("chunk:"), F.col("chunk").cast("string"), F.lit(" rows:"), F.col("rows").cast("string"), F.lit(" digest:"), "digest", F.lit("\n"))
    books = chunks.groupBy(F.expr(f"chunk div {BOOK}").alias("book")).agg(F.sha2(in_order(line, F.col("chunk")), 256).alias("digest"), F.sum("rows").alias("rows"), F.count("*").alias("chunks"))
    whole = books.agg(in_order(F.concat("digest", F.lit("\n")), F.col("book")).alias("text"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    end = F.concat(F.lit(f"mode:{mode} rows:"), F.col("rows").cast("string"), F.lit(" chunks:"), F.col("chunks").cast("string"), F.lit("\n"))
    return whole.select(F.sha2(F.concat("text", end), 256).alias("digest"), "rows", "chunks")
