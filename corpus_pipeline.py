"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, secrets are blanked, the rest is packed.

``STAGES`` are functions of (spark, docs, sf_dir); each works on all that the one before kept.  All but the last return the
columns of documents, further columns of ``docs`` are not read.  What a stage writes on the way belongs to the frame it returns:
it disturbs no other, and ``common.release`` deletes it once the frame is written.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm import common, packing, secrets, simhash, substrings, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source", "n_chars")


def toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours call toxic (score of 0.7 or more) go; labels of the held-out fold are not learned from.

    Null and empty texts get the base rate and stay unless most labelled rows are toxic; repeated rows are judged each; without
    labels all documents stay; an empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.learn(docs, labels.filter(F.coalesce(common.crc_mod(F.col("doc_id"), 3) != 1, F.lit(True))))
    judged = toxicity.score(docs.select(F.lit(0).alias("doc_id"), "text", F.struct(*COLUMNS).alias("whole")), index, carry=("whole",))
    return judged.filter("score < 0.7").select("whole.*")


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (four-word shingles, linked fingerprints of at most 4 differing bits) one document stays.

    The least identifier stays, a null one last; of repeated rows one stays.  Null and blank texts are copies of each other.  An
    empty table gives an empty table.
    """
    rows = common.cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("number")))
    grouped = simhash.near_groups(rows.select(F.col("number").alias("doc_id"), "text"))
    named = grouped.select(F.col("doc_id").alias("number"), "label").join(rows.select("number", "doc_id"), "number")
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("f")).select(F.col("f.number").alias("number"))
    return rows.join(first, "number", "left_semi").select(*COLUMNS)


def repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that occur earlier go; texts that lose none stay as they are, and no document goes.

    A text that loses words is the words left, joined by one blank, and its ``n_chars`` is counted anew.  Null texts stay null;
    null identifiers come last in the order; an empty table gives an empty table.
    """
    cleaned = substrings.remove_repeats(docs.select("doc_id", "text", F.struct(*REST, F.col("text").isNull().alias("none")).alias("rest")), carry=("rest",))
    text = F.when(F.col("rest.none"), F.lit(None).cast("string")).otherwise(F.col("clean"))
    n = F.when(F.col("n_removed") > 0, F.length("clean").cast("long")).otherwise(F.col("rest.n_chars"))
    return cleaned.select("doc_id", text.alias("text"), "rest.lang", "rest.source", n.alias("n_chars"))


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found, linked weak parts included, are overwritten with a mark; no document goes, other texts stay as they are.

    Overlapping spans are one mark.  Null texts stay null; repeated rows are scanned each; an empty table gives an empty table.
    """
    found = secrets.scan(docs, carry=COLUMNS[1:], wide=True)
    spans = F.array_sort(F.concat("base", "extra"))
    clean = found.select("doc_id", secrets.blanked(F.col("text"), spans, "[secret]").alias("text"), "lang", "source", "n_chars", F.size(spans).alias("found"))
    return clean.select("doc_id", "text", "lang", "source", F.when(F.col("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, as ``packing.pack`` defines them for null, empty and long texts."""
    import public_tokenizers as P

    return packing.pack(docs, P.path("word_bpe_49k.json"))


def owner(stage):
    """The tables and broadcasts a stage makes belong to its result."""

    @wraps(stage)
    def call(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.owning(spark) as own:
            out = stage(spark, docs, sf_dir)
        out.tables = own
        return out

    return call


STAGES = [("toxicity", owner(toxic)), ("near_copies", owner(near_copies)), ("repeats", owner(repeats)), ("secrets", owner(secret_scan)), ("packing", owner(packed))]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_folder(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}/{name}"
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        common.release(done)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
