"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of a text counts.  A word's weight is its idf among all documents times the root of its log-likelihood ratio
between the classes, which is counted over all labelled rows: a word that tells nothing weighs nothing, a word of few toxic
texts only weighs what these can show, and no number of words or support bounds it.  The examples that neighbours are
drawn from are a bounded sample (``max_examples``, the least hashes of each class, half of it for each class that has so many),
so the index is bounded and broadcast; an example votes for as many labelled rows of its class as were left out for it.
Examples are dealt to blocks; for each term and block the largest weight is kept.  The ``DENSE`` words with most postings
are kept as a matrix (weights to single precision) and multiplied for many texts at once; for the others a query bounds each block by the sum of its
weights times these maxima, on top of the largest sum that the matrix gave, opens blocks in falling order of the bound and
stops once no block can hold a nearer example than the k-th.  Where the words left have few postings a block, all blocks are
opened, as bounds would cost more than they save.  The score is the share of toxic neighbours, weighted by the squares of
similarities relative to the nearest one's, shrunk to the base rate of all labelled rows with weight ``prior``.  That vote is
calibrated: for at most ``CALIBRATE`` examples of each class it is taken without the example itself, and a logistic curve over
its log odds, fitted to these with the weights of the rows they stand for, gives the score.  Neighbours are the evidence: the
identifiers of the nearest, nearest first.

Defined cases: a null or empty text, or one whose words no example holds, has no neighbour and gets the base rate; ties go to
the example first in order; long texts are read whole; null labels teach nothing; no labels at all give score 0; several
labels of one identifier count as examples each, several texts of one labelled identifier as the least of them; further
columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+").findall
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
MAX_EXAMPLES, K, BLOCK, PRIOR = 8192, 24, 64, 1.0
CALIBRATE, SHOWN = 768, 5  # examples of each class that calibration votes on; neighbours given as evidence
SLACK = 1e-5  # more than single precision can be off
DENSE, BATCH, WORTH = 512, 128, 4  # words kept as a matrix; texts multiplied at once; postings a block from which bounds pay
MAX_BITS = 1 << 26  # of the set of labelled identifiers that texts are held against before they are shuffled


def words(text: str) -> list[str]:
    """Runs of letters of the lower-cased text; of ASCII alone they are found without the pattern."""
    return text.encode().translate(LETTERS).decode().split() if text.isascii() else WORD(text.lower())


class Block:
    """The examples from ``lo`` to ``hi``."""

    def __init__(self, index, lo, hi):
        self.index, self.lo, self.hi = index, lo, hi

    @property
    def T(self) -> np.ndarray:
        """Example by term, dense: for small indexes."""
        x = self.index
        out = np.zeros((self.hi - self.lo, len(x["number"])))
        term = np.repeat(np.repeat(np.arange(len(x["number"])), np.diff(x["at"])), x["length"])
        m = (x["of"] >= self.lo) & (x["of"] < self.hi)
        out[x["of"][m] - self.lo, term[m]] = x["value"][m]
        m = x["row"] >= 0
        out[:, m] = x["dense"][x["row"][m], self.lo : self.hi].T
        return out


def ratio(held: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each word, from the numbers of clean and toxic texts that hold it and of such texts in all."""
    n = max(int(totals.sum()), 1)
    out = np.zeros(len(held))
    for y in (0, 1):
        for seen, share in ((held[:, y], held.sum(1) / n), (totals[y] - held[:, y], 1 - held.sum(1) / n)):
            want = share * totals[y]
            at = (seen > 0) & (want > 0)
            out[at] += 2 * seen[at] * np.log(seen[at] / want[at])
    return np.maximum(out, 0)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def build(examples, support=None, names: list[int] | None = None):
    """Index of labelled texts: words with weights, block maxima, postings by block and term.

    ``names`` are the identifiers of the examples, their numbers by default.  ``support`` takes the words with their numbers and returns, for each, how many clean and toxic labelled texts and how many
    documents hold it, with the totals of these three as the last row; by default the examples are all there is.
    """
    number: dict[str, int] = {}
    terms, of, tf, classes = array("i"), array("i"), array("i"), array("b")
    for i, (text, label) in enumerate(examples):  # taken one by one: texts need not all be there at once
        classes.append(label)
        for w, c in Counter(words(text)).items():
            terms.append(number.setdefault(w, len(number)))
            of.append(i)
            tf.append(c)
    n, y = len(classes), np.array(classes, np.int64)
    t, e, v = np.frombuffer(terms, np.int32), np.frombuffer(of, np.int32), 1 + np.log(np.frombuffer(tf, np.int32)) if n and len(tf) else np.zeros(0)
    del tf
    if support is None:
        held = np.stack([np.bincount(t[y[e] == c], minlength=len(number)) for c in (0, 1)], 1)
        counts = np.r_[np.c_[held, held.sum(1)], [[n - y.sum(), y.sum(), n]]]
    else:
        counts = support(number)
    held, totals = counts[:-1].astype(float), counts[-1].astype(float)
    idf = np.log((totals[2] + 1) / (held[:, 2] + 1)) + 1
    weight = idf * np.sqrt(ratio(held[:, :2], totals[:2]))
    v *= weight[t]
    norm = np.sqrt(np.bincount(e, v * v, n))
    good = v > 1e-9
    t, e, v = t[good], e[good], v[good] / norm[e[good]]
    del terms, of, good
    heaviest = np.full(n, -1)
    top = np.zeros(n)
    np.maximum.at(top, e, v)
    m = v == top[e]
    np.maximum.at(heaviest, e[m], t[m])
    order = np.lexsort((np.arange(n), heaviest))
    order = order[heaviest[order] >= 0]
    place = np.zeros(n, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    e, y_of = place[e], y[order]
    frequent = np.argsort(-np.bincount(t, minlength=len(number)), kind="stable")[:DENSE]
    row = np.full(len(number), -1, np.int32)
    row[frequent] = np.arange(len(frequent))
    dense, m = np.zeros((len(frequent), len(order)), np.float32), row[t] >= 0
    dense[row[t[m]], e[m]] = v[m]
    t, e, v = t[~m], e[~m], v[~m]
    by = np.lexsort((e, t))
    t, e, v = t[by], e[by], v[by]
    first = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(e // BLOCK) != 0)]) if len(t) else np.zeros(0, np.int64)
    index = {
        "name": np.array(range(n) if names is None else names, np.int64)[order], "curve": (1.0, 0.0),
        "number": number, "weight": weight, "y": y_of, "row": row, "dense": dense, "of": e.astype(np.int32), "value": v,
        "post": np.searchsorted(t, np.arange(len(number) + 1)), "at": np.searchsorted(t[first], np.arange(len(number) + 1)), "block": (e[first] // BLOCK).astype(np.int16), "first": first.astype(np.int32),
        "length": np.diff(np.r_[first, len(t)]).astype(np.int8), "maxima": np.maximum.reduceat(v, first) if len(t) else v,
        "stands_for": totals[:2] / np.maximum([(y == c).sum() for c in (0, 1)], 1), "rate": totals[1] / max(totals[0] + totals[1], 1),
    }
    index["blocks"] = [(Block(index, lo, min(lo + BLOCK, len(order))), y_of[lo : lo + BLOCK]) for lo in range(0, len(order), BLOCK)]
    return index


def nearest(index, at: np.ndarray, q: np.ndarray, k: int = K, base: np.ndarray | None = None):
    """(similarities, labels, numbers) of the k nearest examples to the query of weights ``q`` at the terms ``at``, and blocks opened.

    ``base`` is what the words kept as a matrix give for each example, to single precision: it finds the candidates, whose
    similarities are then summed in double precision.
    """
    row = index["row"][at]
    rows, weights = row[row >= 0], q[row >= 0]
    if base is None:
        base = weights.astype(np.float32) @ index["dense"][rows]
    exact = lambda ids: weights @ index["dense"][rows[:, None], ids].astype(np.float64)
    at, q, n, n_blocks = at[row < 0], q[row < 0], len(index["y"]), len(index["blocks"])
    if not n:
        return np.zeros(0), index["y"], np.zeros(0, np.int64), 0
    begin, post = index["at"][at], index["post"][at]
    several, held = index["at"][at + 1] - begin, index["post"][at + 1] - post
    if held.sum() < WORTH * several.sum():
        p = ranges(post, held)
        rest = np.bincount(index["of"][p], index["value"][p] * np.repeat(q, held), n)
        s = base + rest
        floor = np.partition(s, n - k)[n - k] if n > k else 0.0
        ids = np.flatnonzero((s > 0) & (s >= floor - SLACK))
        sims = exact(ids) + rest[ids]
        top = np.lexsort((ids, -sims))[:k]
        return sims[top], index["y"][ids[top]], ids[top], n_blocks
    entry, w = ranges(begin, several), np.repeat(q, several)
    block = index["block"][entry]
    bounds = np.bincount(block, w * index["maxima"][entry], n_blocks) + np.maximum.reduceat(base, np.arange(0, n, BLOCK))
    bounds[bounds > 0] += SLACK
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    sims, ids, floor, opened, step = np.zeros(0), np.zeros(0, np.int64), 0.0, 0, 16
    while opened < len(order):
        take = order[opened : opened + step]
        take = take[bounds[take] >= floor - 1e-9]
        if not len(take):
            break
        opened, step = opened + len(take), 4 * step
        chosen = np.zeros(n_blocks, bool)
        chosen[take] = True
        m = chosen[block]
        length = index["length"][entry[m]]
        p = ranges(index["first"][entry[m]], length)
        rest = np.bincount(index["of"][p], index["value"][p] * np.repeat(w[m], length), n)
        s = base + rest
        here = np.repeat(chosen, BLOCK)[:n] & (s > 0) & (s >= floor - SLACK)
        near = s[here]
        if len(near) > k:  # what is not among the k nearest of these blocks needs no second sum
            here &= s >= np.partition(near, len(near) - k)[len(near) - k] - 2 * SLACK
        new = np.flatnonzero(here)
        sims, ids = np.r_[sims, exact(new) + rest[new]], np.r_[ids, new]
        if len(sims) >= k:
            least = np.partition(sims, len(sims) - k)[len(sims) - k]
            sims, ids = sims[sims >= least], ids[sims >= least]
            top = np.lexsort((ids, -sims))[:k]
            sims, ids = sims[top], ids[top]
            floor = sims[-1]
    top = np.lexsort((ids, -sims))
    return sims[top], index["y"][ids[top]], ids[top], opened


def neighbours(index, q: np.ndarray, k: int = K):
    """``nearest`` for a dense query."""
    at = np.flatnonzero(q)
    return nearest(index, at, q[at], k)


def query(index, text: str):
    """The terms of a text and their weights, of length 1."""
    number = index["number"]
    bag = Counter(map(number.get, words(text)))
    bag.pop(None, None)
    at = np.fromiter(bag, np.int64, len(bag))
    q = (1 + np.log(np.fromiter(bag.values(), float, len(bag)))) * index["weight"][at]
    at, q = at[q > 1e-9], q[q > 1e-9]
    return at, q / max(np.sqrt((q * q).sum()), 1e-9)


def vote(index, at: np.ndarray, q: np.ndarray, base: np.ndarray | None = None, but: int = -1) -> tuple[float, list[int]]:
    """The vote of the nearest, without the example numbered ``but``, and the identifiers of the first of them."""
    s, y, ids, _ = nearest(index, at, q, K + (but >= 0), base)
    if but >= 0:
        others = np.flatnonzero(ids != but)[:K]
        s, y, ids = s[others], y[others], ids[others]
    if not len(s):
        return float(index["rate"]), []
    s = (s / s[0]) ** 2 * index["stands_for"][y] / index["stands_for"].max()
    return float(((s * y).sum() + PRIOR * index["rate"]) / (s.sum() + PRIOR)), index["name"][ids[:SHOWN]].tolist()


def log_odds(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def curved(index, share: float) -> float:
    """The calibrated vote; no vote leaves the range from 0 to 1, and no labels at all stay at 0."""
    if index["rate"] <= 0 or index["rate"] >= 1:
        return share
    slope, shift = index["curve"]
    return float(1 / (1 + np.exp(-(slope * log_odds(share) + shift))))


def calibrate(index, examples: list[tuple[str, int]], steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through votes on examples (text, number in the index), by Newton's method."""
    if not examples or not 0 < index["rate"] < 1:
        return 1.0, 0.0
    found = [vote(index, *query(index, text), but=i)[0] for text, i in examples]
    x, y = log_odds(np.array(found)), index["y"][[i for _, i in examples]]
    drawn = np.maximum([(y == c).sum() for c in (0, 1)], 1)
    total = np.array([(index["y"] == c).sum() for c in (0, 1)]) * index["stands_for"]
    weight = (total / drawn)[y]
    weight = weight * len(y) / weight.sum()
    theta, pull = np.array([1.0, 0.0]), np.array([0.02, 0.02])  # a slight pull to the vote as it is keeps parted classes finite
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        gradient = design.T @ (weight * (p - y)) + pull * (theta - [1.0, 0.0])
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + np.diag(pull), gradient)
        theta = theta - step / max(1.0, np.abs(step).max())
    return max(float(theta[0]), 1e-3), float(theta[1])


def judge_texts(index, texts: list[str | None], memo: dict) -> list[tuple[float, list[int]]]:
    """Scores and evidence of at most ``BATCH`` texts; ``memo`` keeps them by the digest of the text."""
    keys = [blake2b(common.utf8(t), digest_size=16).digest() for t in texts]
    if len(memo) > 100_000:
        memo.clear()
    new = {k: query(index, t or "") for k, t in dict(zip(keys, texts)).items() if k not in memo}
    x = np.zeros((len(new), len(index["dense"])), np.float32)
    for i, (at, q) in enumerate(new.values()):
        row = index["row"][at]
        x[i, row[row >= 0]] = q[row >= 0]
    for (k, (at, q)), base in zip(new.items(), x @ index["dense"]):
        share, shown = vote(index, at, q, base)
        memo[k] = curved(index, share), shown
    return [memo[k] for k in keys]


def score_text(index, text: str | None, memo: dict) -> float:
    return judge_texts(index, [text], memo)[0][0]


def count_words(texts: DataFrame, number: dict[str, int]) -> np.ndarray:
    """For each word of ``number``, how many of the ``texts`` (kind 0, 1 or 2, text) of each kind hold it; last, how many there are."""
    spark = texts.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(number)

    def run(batches):
        known = shared.value
        held = np.zeros((len(known) + 1, 3), np.int64)
        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bag = [known[w] for w in set(words(text.as_py() or "")) if w in known]
                held[bag, kind] += 1
                held[-1, kind] += 1
        for at in np.array_split(np.flatnonzero(held.any(1)), 1 + len(known) // 65536):
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(held[at, c]) for c in range(3))], names=["term", "n0", "n1", "n2"])

    summed = texts.mapInArrow(run, "term long, n0 long, n1 long, n2 long").groupBy("term").agg(F.sum("n0"), F.sum("n1"), F.sum("n2")).toArrow()
    out = np.zeros((len(number) + 1, 3), np.int64)
    for c in range(3):
        out[summed.column(0).to_numpy(), c] = summed.column(c + 1).to_numpy()
    shared.destroy()
    return out


def learn(docs: DataFrame, labels: DataFrame, *, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """The index of ``build``, calibrated, from the rows of ``docs`` that ``labels`` tell 0 or 1."""
    with common.owning(docs.sparkSession) as own:
        before = list(own.paths)
        index = _learn(docs, labels, max_examples, id_col, text_col, label_col)
        own.drop_since(before)
    return index


def likely(texts: DataFrame, ids: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``texts`` whose ``id`` may be among ``ids``: all that are, and few others.

    What is broadcast is a set of bits, 16 to 32 for an identifier and at most ``max_bits`` (8 MB): beyond that more others pass.
    """
    n, spark = ids.count(), texts.sparkSession
    bits = min(max(64, 1 << (16 * n).bit_length()), max_bits)
    place = F.pmod(F.xxhash64("id"), F.lit(bits).cast("long"))
    word, bit = F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.expr("shiftleft(1L, bit)")
    found = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("held")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[found.column(0).to_numpy()] = found.column(1).to_numpy()
    row = spark.createDataFrame(pa.table({"held": pa.array([held], pa.list_(pa.int64()))}))
    return texts.withColumns({"word": word, "bit": bit}).join(F.broadcast(row), F.expr("shiftrightunsigned(get(held, word), bit) & 1 = 1"), "left_semi").drop("word", "bit")


def _learn(docs: DataFrame, labels: DataFrame, max_examples: int, id_col: str, text_col: str, label_col: str):
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = likely(texts, marked.select("id")).join(marked.select("id"), "id", "left_semi").groupBy("id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    labelled = common.cut(one.join(marked, "id"))
    there = {r.y: r["count"] for r in labelled.groupBy("y").count().collect()}
    half = max_examples // 2
    quota = {y: max(half, max_examples - there.get(1 - y, 0)) for y in (0, 1)}
    drawn = [labelled.filter(F.col("y") == y).select("id", "y").orderBy(F.xxhash64("id"), "id").limit(quota[y]) for y in (0, 1)]
    # at most max_examples rows of two numbers; repeated labels are counted, not joined twice
    chosen = F.broadcast(common.cut(drawn[0].unionByName(drawn[1]).groupBy("id", "y").agg(F.count("*").cast("int").alias("times"))))
    kinds = labelled.select(F.col("y").alias("kind"), "text").unionByName(texts.select(F.lit(2).alias("kind"), "text"))
    # only texts that are drawn are shuffled
    rows = labelled.join(chosen, ["id", "y"]).dropDuplicates(["id", "y"]).select("id", "y", "times", "text").toArrow()
    ids, ys, times = (rows.column(i).to_numpy() for i in range(3))
    order = np.lexsort((ys, ids))
    ids, ys, times = ids[order], ys[order], times[order]
    held = [rows.column(3)]  # texts stay packed and in the order they came, and go once they are read
    kept = {}
    for y in (0, 1):
        own = np.flatnonzero(ys == y)
        kept.update(((int(ids[i]), y), held[0][int(order[i])].as_py()) for i in own[np.linspace(0, len(own) - 1, min(len(own), CALIBRATE)).astype(int)])
    names = np.repeat(ids, times).tolist()
    del rows

    def each():
        texts = held.pop()
        for i, y, n in zip(order.tolist(), ys.tolist(), times.tolist()):
            text = texts[i].as_py()
            for _ in range(n):
                yield text, y

    index = build(each(), lambda number: count_words(kinds, number), names)
    common.drop(labelled, chosen)
    at = {(int(name), int(y)): i for i, (name, y) in enumerate(zip(index["name"], index["y"]))}
    index["curve"] = calibrate(index, [(text, at[who]) for who, text in kept.items() if who in at])
    return index


@common.owned
def score(docs: DataFrame, index, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, evidence array<long>[, carried columns of ``docs``])."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = common.broadcast(spark, index)
    names = ["doc_id", "score", "evidence", *carry]

    def run(batches):
        memo: dict = {}
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                found = judge_texts(shared.value, batch.column(1).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), *batch.columns[2:]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, score double, evidence array<bigint>{kinds}")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(common.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    index = learn(docs, labels.filter(~held_out))
    return score(docs, index).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
