"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a blank; n-grams of one to three characters are hashed to
``2**bits`` buckets.  Training counts buckets for each language in Arrow batches and sums the counts in Spark (partial sums
first).  Its result is one log-probability for each bucket and language.  Languages are dealt to shards of at most
``SHARD`` matrix entries; a shard is what the driver holds and broadcasts at once.  One shard, the usual case, is scored in one
pass; of several, each pass gives a text's best language and the sum of its probabilities, and these are combined by text, which
gives what the whole matrix would.  Scoring treats a batch as a sparse document-by-bucket matrix (bucket numbers and row
starts) and multiplies it with the matrix by gathering and summing by row.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing was learned.
Ties go to the language first in order.  Long texts are scored whole, in pieces.  Repeated rows are scored each; rows with
a null language or null text teach nothing.  Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 16
ORDERS = (1, 2, 3)
SHARD = 1 << 24  # entries: 256 languages at 2**16 buckets
PIECE = 1 << 20  # characters that are scored at once
_TABLES: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    if not _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(table)
    return _TABLES[0]


def grams(texts: list[str | None], bits: int = BITS):
    """Yield (text number at the start, bucket array, row starts, has-letter flags) for runs of whole texts or pieces of one.

    A text that is longer than a piece comes in several runs with the same number.
    """
    fold, at = _folding(), 0

    def run(first, parts):
        lengths = np.fromiter((len(p) + 3 for p in parts), np.int64, len(parts))
        raw = np.frombuffer("".join(f" {p}  " for p in parts).encode("utf-32-le", "surrogatepass"), "<u4")
        cp = fold[raw]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        letters = np.add.reduceat((cp != 32).astype(np.int64), starts) > 0
        cols = []
        h = np.zeros(len(cp), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            shifted = np.full(len(cp), 32, np.uint32)
            shifted[: len(cp) - n + 1] = cp[n - 1 :]
            h = h * np.uint32(0x01000193) + shifted * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in ORDERS:
                cols.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
        return first, np.stack(cols, 1), starts, letters

    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (not parts or size + len(texts[at] or "") <= PIECE):
            t = texts[at] or ""
            if len(t) > PIECE:
                if parts:
                    break
                for i in range(0, len(t), PIECE):
                    yield run(at, [t[i : i + PIECE]])
                at += 1
                first = at
                continue
            parts.append(t)
            size += len(t)
            at += 1
        if parts:
            yield run(first, parts)


def train(examples: DataFrame, *, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, alpha: float = 0.5) -> Model:
    """The ``Model`` that the rows of ``examples`` teach."""
    common.ship(examples.sparkSession)
    rows = examples.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def flush():
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at].astype(np.int64)), pa.array(np.r_[docs[lang], c[at]].astype(np.int64))], names=["lang", "bucket", "n"])
            counts.clear()
            docs.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                at = [i for i, x in enumerate(langs) if x == lang]
                if lang not in counts and len(counts) >= 64:
                    yield from flush()
                c = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                docs[lang] = docs.get(lang, 0) + len(at)
                for _, buckets, _, _ in grams(batch.column(1).take(pa.array(at)).to_pylist(), bits):
                    c += np.bincount(buckets.ravel(), minlength=1 << bits)
        yield from flush()

    summed = common.cut(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return Model(summed, bits, alpha)


class Model:
    """Counts (lang, bucket, n) of the training rows in a table, -1 being the bucket of the number of rows; matrices by shard."""

    def __init__(self, summed: DataFrame, bits: int, alpha: float):
        self.summed, self.bits, self.alpha = summed, bits, alpha
        totals = summed.filter("bucket = -1").agg(F.sum("n").alias("rows"), F.count("*").alias("languages")).first()
        self.rows, self.languages = int(totals["rows"] or 0), totals["languages"]

    def shards(self):
        """(languages in order, log-probabilities of shape buckets x languages, log priors), at most ``SHARD`` entries each."""
        size, last = max(1, SHARD >> self.bits), None
        while True:
            left = self.summed.filter("bucket = -1" if last is None else (F.col("bucket") == -1) & (F.col("lang") > last))
            names = [r.lang for r in left.select("lang").orderBy("lang").limit(size).collect()]
            if not names:
                return
            t = self.summed.filter(F.col("lang").between(names[0], names[-1])).toArrow()  # at most (2**bits + 1) rows a language
            at = {x: i for i, x in enumerate(names)}
            k = np.array([at[x] for x in t["lang"].combine_chunks().dictionary_encode().dictionary.to_pylist()], np.int64)[t["lang"].combine_chunks().dictionary_encode().indices.to_numpy()]
            b, n = t["bucket"].to_numpy(), t["n"].to_numpy()
            counts, priors = np.zeros((1 << self.bits, len(names)), np.float32), np.zeros(len(names))
            counts[b[b >= 0], k[b >= 0]] = n[b >= 0]
            priors[k[b < 0]] = n[b < 0]
            totals = np.bincount(k[b >= 0], n[b >= 0], len(names))
            yield names, (np.log(counts + np.float32(self.alpha)) - np.log(totals + self.alpha * (1 << self.bits))).astype(np.float32), np.log(priors / self.rows)
            last = names[-1]
            if len(names) < size:
                return


def against(rows: DataFrame, shard, bits: int) -> DataFrame:
    """(row, doc_id, letters, lang, best, more): each text's likeliest language of a shard, its log-probability, and the sum of
    the probabilities of all languages of the shard relative to it."""
    shared = common.broadcast(rows.sparkSession, shard)

    def run(batches):
        languages, logp, prior = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                total, letters = np.zeros((batch.num_rows, len(languages))) + prior, np.zeros(batch.num_rows, bool)
                for first, buckets, starts, has in grams(batch.column(2).to_pylist(), bits):
                    letters[first : first + len(starts)] |= has
                    for k in range(len(languages)):
                        total[first : first + len(starts), k] += np.add.reduceat(logp[:, k][buckets].sum(1, dtype=np.float64), starts)
                best = total.argmax(1)
                top = total[np.arange(len(best)), best]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(letters), pa.array([languages[b] for b in best.tolist()]), pa.array(top), pa.array(np.exp(total - top[:, None]).sum(1))], names=["row", "doc_id", "letters", "lang", "best", "more"])

    return rows.mapInArrow(run, "row long, doc_id long, letters boolean, lang string, best double, more double")


@common.owned
def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior probability."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model.languages << model.bits > SHARD:  # several passes over the same numbers
        rows = common.cut(rows)
    passes = [against(rows, shard, model.bits) for shard in model.shards()]
    if not passes:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            found = found.unionByName(p)
        best = F.max("best").alias("top"), F.min(F.struct((-F.col("best")).alias("b"), "lang")).alias("first"), F.first("doc_id").alias("doc_id"), F.first("letters").alias("letters"), F.collect_list(F.struct("best", "more")).alias("shards")
        found = common.cut(found).groupBy("row").agg(*best).select("doc_id", "letters", F.col("first.lang").alias("lang"), F.aggregate("shards", F.lit(0.0), lambda acc, x: acc + x["more"] * F.exp(x["best"] - F.col("top"))).alias("more"))
    known = F.col("letters")
    return found.select("doc_id", F.when(known, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(known, 1 / F.col("more")).otherwise(0.0).alias("score"))


@common.owned
def identify(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """``predict`` by what ``examples`` teach; the counts go with the frame returned."""
    return predict(docs, train(examples))


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(common.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, docs.filter(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
