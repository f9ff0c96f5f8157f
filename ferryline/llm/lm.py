"""Language-model scores by context-tree weighting over bytes.

A text's words are lower-cased, joined by blanks and closed with an end byte.  Each byte is eight binary decisions; the
node of a decision under a context of d = 0..``DEPTH`` preceding bytes has counts of zeros and ones from the training texts.  A
Krichevsky-Trofimov estimate is mixed at every depth: weight 1/2 for a node's own estimate, 1/2 for the product of its
extensions', which makes each depth's posterior weight the ratio of these.

Texts stay in blocks of about 8 MB.  A block sends its distinct (context, byte) keys with their training counts, packed, to
sections, which are dealt by a hash of the last ``ROOT`` bytes of context, so all longer contexts of one tree lie in one section.
Sections merge what their blocks send, at most ``FAN`` at a time, and work out the tree from depth ``DEPTH`` up to ``ROOT`` with
arrays; from there to the root nodes are rows that Spark sums up.  Down again, a section gets the mixture of depths below ``ROOT``
for its nodes, prices its keys, and answers ``FAN`` blocks at a time with the prices of their own keys.  Words and their counts,
for the base score, travel the same way.  What is learned grows with the corpus and is never collected.

Defined cases: a null or blank text is its end alone; with nothing to learn from, every decision costs one bit; long texts
are read whole; repeated rows are scored each; null identifiers learn and score as others; further columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, ROOT, END = 5, 3, 0xFF
BLOCK_BYTES, RUN_BYTES, SECTION_BYTES, MAX_SECTIONS, FAN = 8 << 20, 1 << 20, 8 << 20, 4096, 64
PACKED = "section int, g int, block long, a binary, b binary"


def line(text: str | None) -> bytes:
    return b" ".join(common.utf8(text).lower().split()) + bytes([END])


# ---- packed arrays


def squeezed(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array of integers or doubles; of ascending integers the differences, low bytes apart from high ones."""
    if ascending:
        x = np.diff(x, prepend=x.dtype.type(0))
    return squeezed(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(raw: bytes, kind, ascending: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if ascending else x


def pack_words(words: list[bytes]) -> bytes:
    return squeezed(b" ".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(raw)
    return whole.split(b" ") if whole else []


# ---- keys of a block


def positions(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of every byte of all lines: its context, the last byte highest, and the byte itself; where each line starts)."""
    sizes = np.array([len(x) for x in lines], np.int64)
    pad = bytes([END]) * DEPTH
    x = np.frombuffer(pad + pad.join(lines), np.uint8).astype(np.int64)
    key = np.zeros(len(x) - DEPTH, np.int64)
    for d in range(DEPTH):
        key <<= 8
        key |= x[DEPTH - 1 - d : len(x) - 1 - d]
    key <<= 8
    key |= x[DEPTH:]
    starts = np.r_[0, np.cumsum(sizes + DEPTH)[:-1]]
    real = np.ones(len(key), bool)
    for d in range(DEPTH):  # the padding before each line but the first
        real[starts[1:] - 1 - d] = False
    return key[real], np.r_[0, np.cumsum(sizes)[:-1]]


def runs(lines: list[bytes], size: int = RUN_BYTES):
    """Bounds of runs of whole lines of about ``size`` bytes: what is worked on at once."""
    start = n = 0
    for i, x in enumerate(lines, 1):
        n += len(x)
        if n >= size or i == len(lines):
            yield start, i
            start, n = i, 0


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    o = np.argsort(keys, kind="stable")
    keys, counts = keys[o], counts[o]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


def counted(lines: list[bytes], learn: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each occurs in lines to learn from).

    A key and a count below 128 are one number to be sorted; a larger count is several such numbers.
    """
    parts = [np.empty(0, np.int64)]
    for a, b in runs(lines):
        key, starts = positions(lines[a:b])
        k = key << 1
        k |= np.repeat(np.array(learn[a:b], np.int64), np.diff(np.r_[starts, len(key)]))
        k.sort()
        at = np.flatnonzero(np.r_[True, k[1:] >> 1 != k[:-1] >> 1])
        n, k = np.add.reduceat(k & 1, at), k[at] >> 1 << 7
        while (large := n > 127).any():
            parts.append(k[large] | 127)
            n[large] -= 127
        parts.append(k | n)
    k = np.concatenate(parts)
    if not len(k):
        return k, k
    k.sort()
    at = np.flatnonzero(np.r_[True, k[1:] >> 7 != k[:-1] >> 7])
    return k[at] >> 7, np.add.reduceat(k & 127, at)


def section_of(roots: np.ndarray, sections: int) -> np.ndarray:
    return (common.mix64(roots.astype(np.uint64) + np.uint64(1)) % np.uint64(sections)).astype(np.int64)


def packed_blocks(rows: DataFrame, sections: int) -> DataFrame:
    """(kind, PACKED): texts of a block (0), its keys (1) and words (2) by section with training counts, its training texts (3)."""
    names = ["kind", *(c.split()[0] for c in PACKED.split(", "))]

    def emit(part):
        block, learn = part[0][0], [r[2] for r in part]
        lines = [x for _, _, _, x in part]
        out = [(0, -1, block, squeezed(pickle.dumps(([r[1] for r in part], learn, lines))), b""), (3, -1, block, int(sum(learn)).to_bytes(8, "little"), b"")]
        keys, n = counted(lines, learn)
        at = section_of(keys >> (8 * (DEPTH - ROOT + 1)), sections)
        o = np.argsort(at, kind="stable")
        keys, n, at = keys[o], n[o], at[o]
        for a, b in _spans(at):
            out.append((1, int(at[a]), block, pack(keys[a:b], True), pack(n[a:b])))
        held: Counter[bytes] = Counter()
        for x, flag in zip(lines, learn):
            if flag:
                held.update(x[:-1].split())
        for x, flag in zip(lines, learn):
            if not flag:
                for w in x[:-1].split():
                    held.setdefault(w, 0)
        words, n = list(held), np.fromiter(held.values(), np.int64, len(held))
        at = np.array([hash_of(w) % sections for w in words], np.int64)
        o = np.argsort(at, kind="stable")
        at = at[o]
        for a, b in _spans(at):
            out.append((2, int(at[a]), block, pack_words([words[i] for i in o[a:b].tolist()]), pack(n[o[a:b]])))
        for start in range(0, len(out), 256):
            cols = list(zip(*out[start : start + 256]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([0] * len(cols[0]), pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=names)

    def run(batches):
        held, n = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                for row, doc, learn, text in zip(*(c.to_pylist() for c in whole.slice(start, 256).columns)):
                    held.append((row, doc, learn, line(text)))
                    n += len(held[-1][3])
                    if n >= BLOCK_BYTES:
                        yield from emit(held)
                        held, n = [], 0
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, f"kind int, {PACKED}")


def hash_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _spans(at: np.ndarray):
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else np.zeros(1, np.int64)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def merge_keys(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    k, n = summed(np.concatenate([unpack(a, np.int64, True) for a, _ in parts]), np.concatenate([unpack(b, np.int64) for _, b in parts]))
    return pack(k, True), pack(n)


def merge_words(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    words = pa.concat_arrays([pa.array(unpack_words(a), pa.large_binary()) for a, _ in parts])
    t = pa.table({"w": words, "n": np.concatenate([unpack(b, np.int64) for _, b in parts])}).group_by("w").aggregate([("n", "sum")])
    return pack_words(t["w"].to_pylist()), pack(t["n_sum"].to_numpy())


def merged(parts: DataFrame, groups: int, merge) -> DataFrame:
    """One row (section, a, b) for each section: what its blocks sent, merged ``FAN`` or so at a time."""
    left = parts.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).select("section", "g", "a", "b")
    while True:
        def run(table: pa.Table) -> pa.Table:
            a, b = merge(list(zip(table["a"].to_pylist(), table["b"].to_pylist())))
            return _table([(table["section"][0].as_py(), table["g"][0].as_py(), a, b)], "section int, g int, a binary, b binary")

        left = common.cut(left.groupBy("section", "g").applyInArrow(run, "section int, g int, a binary, b binary"))
        if groups == 1:
            return left.select("section", "a", "b")
        groups = -(-groups // FAN)
        left = left.withColumn("g", F.pmod("g", F.lit(groups)).cast("int"))


# ---- the tree of one section

_HALF, _LOGS = np.log(2.0), [np.zeros(1)]


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln gamma(n + 1/2) of integers: a table that grows as needed, beyond its bound Stirling's series."""
    small = n < (1 << 16)
    need = int(n[small].max(initial=0)) + 1
    if len(_LOGS[0]) < need:
        size = 1 << int(need).bit_length()
        _LOGS[0] = np.r_[0.5 * np.log(np.pi), 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(size - 1) + 0.5))]
    out = np.empty(len(n))
    out[small] = _LOGS[0][n[small]]
    z = n[~small] + 0.5
    out[~small] = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z)
    return out


def log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability of integer counts."""
    n = zero + one
    whole = np.empty(len(n))
    small = n < (1 << 16)
    if len(_FACTORIALS[0]) <= int(n[small].max(initial=0)):
        size = 1 << int(n[small].max(initial=0) + 1).bit_length()
        _FACTORIALS[0] = np.r_[0.0, np.cumsum(np.log(np.arange(1, size + 1)))]
    whole[small] = _FACTORIALS[0][n[small]]
    z = n[~small] + 1.0
    whole[~small] = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z)
    return log_gamma_half(zero) + log_gamma_half(one) - whole - np.log(np.pi)


_FACTORIALS = [np.zeros(1)]


class Depth:
    """All decisions under the contexts of one depth: for each of the eight steps the nodes in order of (context, node)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.steps = keys, []
        for i in range(8):
            node = keys >> (8 - i)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            bit = keys >> (7 - i) & 1
            total, ones = np.add.reduceat(counts, first), np.add.reduceat(counts * bit, first)
            of = np.cumsum(np.r_[False, node[1:] != node[:-1]])
            self.steps.append({"first": first, "of": of, "bit": bit, "z": total - ones, "o": ones})


def depths(keys: np.ndarray, counts: np.ndarray) -> list[Depth]:
    """Depths ``DEPTH`` down to ``ROOT``, with ``lw``, the log of each node's weighted probability, and each node's parent."""
    out, up = [], None
    for d in range(DEPTH, ROOT - 1, -1):
        level = Depth(keys, counts)
        for i, s in enumerate(level.steps):
            kt = log_kt(s["z"], s["o"])
            if up is None:
                s["kt"], s["lw"] = kt, kt
            else:
                child = up.steps[i]
                child["parent"] = s["of"][up.above[child["first"]]]
                below = np.bincount(child["parent"], child["lw"], len(s["first"]))
                s["kt"], s["lw"] = kt, np.logaddexp(kt, below) - _HALF
        out.append(level)
        if d > ROOT:  # the same keys with one byte of context less
            shorter = keys >> 16 << 8 | keys & 255
            o = np.argsort(shorter, kind="stable")
            start = np.r_[True, shorter[o][1:] != shorter[o][:-1]]
            above = np.empty(len(keys), np.int64)
            above[o] = np.cumsum(start) - 1
            level.above = above
            at = np.flatnonzero(start)
            keys, counts = shorter[o][at], np.add.reduceat(counts[o], at)
        up = level
    return out


def root_rows(level: Depth):
    """(context, node, zeros, ones, lw) of the shallowest depth."""
    for i, s in enumerate(level.steps):
        k = level.keys[s["first"]]
        yield k >> 8, (256 | k & 255) >> (8 - i), s["z"], s["o"], s["lw"]


def prices(levels: list[Depth], ctx: np.ndarray, node: np.ndarray, p: np.ndarray, left: np.ndarray, near: np.ndarray) -> np.ndarray:
    """log10 probability of each key's byte, given what the depths above ``ROOT`` make of the nodes there."""
    o = np.argsort(ctx << 9 | node)
    code, p, left, near = (ctx << 9 | node)[o], p[o], left[o], near[o]
    total = np.zeros(len(levels[0].keys))
    for i in range(8):
        state = None
        for level in reversed(levels):
            s = level.steps[i]
            if state is None:
                k = level.keys[s["first"]]
                at = np.searchsorted(code, (k >> 8) << 9 | (256 | k & 255) >> (8 - i))
                mixed, rest, close = p[at], left[at], near[at]
            else:
                mixed, rest, close = (x[s["parent"]] for x in state)
            n = s["z"] + s["o"]
            own = (s["o"] + 0.5) / (n + 1.0)
            weight = np.where(n > 0, 1.0 if level is levels[0] else np.minimum(np.exp(s["kt"] - _HALF - s["lw"]), 1.0), 0.0)
            state = mixed + rest * weight * own, rest * (1 - weight), np.where(n > 0, own, close)
        one = state[0] + state[1] * state[2]
        s = levels[0].steps[i]
        one = one[s["of"]]
        total += np.log10(np.where(s["bit"] == 1, one, 1 - one))
    return total


# ---- from the sections' roots to the root of all, in Spark


def row_kt(zero, one):
    """``log_kt`` of columns, by Stirling's series for the gamma function."""
    def lg(z):
        s = z + 8.0
        low = F.lit(0.0)
        for i in range(8):
            low = low + F.log(z + i)
        return (s - 0.5) * F.log(s) - s + 0.9189385332046727 + 1 / (12 * s) - 1 / (360 * s * s * s) - low

    return lg(zero + 0.5) + lg(one + 0.5) - lg(zero + one + 1.0) - F.log(F.lit(float(np.pi)))


def above_root(roots: DataFrame) -> DataFrame:
    """(section, ctx, node, p, left, near) of the nodes at depth ``ROOT``: the mixture of all lesser depths, what weight is left for
    greater ones, and the nearest estimate.  ``roots`` is (section, ctx, node, z, o, lw); nodes without counts are asked for only."""
    levels, level = [], roots.select("ctx", "node", "z", "o", "lw")
    for _ in range(ROOT):
        up = level.groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("lw").alias("below"))
        up = up.withColumn("kt", row_kt(F.col("z"), F.col("o")))
        top = F.greatest("kt", "below")
        level = common.cut(up.withColumn("lw", top + F.log(F.exp(F.col("kt") - top) + F.exp(F.col("below") - top)) - F.log(F.lit(2.0))))
        levels.append(level)
    n = F.col("z") + F.col("o")
    own, weight = (F.col("o") + 0.5) / (n + 1.0), F.when(n > 0, F.least(F.exp(F.col("kt") - F.log(F.lit(2.0)) - F.col("lw")), F.lit(1.0))).otherwise(0.0)
    out = levels[-1].select("ctx", "node", (weight * own).alias("p"), (1 - weight).alias("left"), own.alias("near"))
    for level in reversed(levels[:-1]):
        above = out.select(F.col("ctx").alias("up"), "node", "p", "left", "near")
        j = level.withColumn("up", F.shiftright("ctx", 8)).join(above, ["up", "node"])
        out = j.select("ctx", "node", (F.col("p") + F.col("left") * weight * own).alias("p"), (F.col("left") * (1 - weight)).alias("left"), F.when(n > 0, own).otherwise(F.col("near")).alias("near"))
    out = out.select(F.col("ctx").alias("up"), "node", "p", "left", "near")
    return roots.select("section", "ctx", "node").withColumn("up", F.shiftright("ctx", 8)).join(out, ["up", "node"]).select("section", "ctx", "node", "p", "left", "near")


@common.owned
def score(docs: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``train`` is a condition on ``docs``."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sections = max(1, min(MAX_SECTIONS, -(-int(size) // SECTION_BYTES)))
    parts = common.cut(packed_blocks(rows, sections))
    blocks = parts.filter("kind = 0").count()
    groups = max(1, -(-blocks // FAN))
    tree = merged(parts.filter("kind = 1"), groups, merge_keys)
    known = merged(parts.filter("kind = 2"), groups, merge_words)

    def totals(batches):
        n = v = 0
        for batch in batches:
            for b in batch.column(0).to_pylist():
                c = unpack(b, np.int64)
                n, v = n + int(c.sum()), v + int((c > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v])], names=["n", "v"])

    def texts(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(int.from_bytes(a, "little") for batch in batches for a in batch.column(0).to_pylist())], pa.int64())], names=["n"])

    w = known.select("b").mapInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_texts = int(parts.filter("kind = 3").select("a").mapInArrow(texts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    n_train, v = int(w["n"]) + n_texts, int(w["v"]) + (n_texts > 0)

    def grown(batches):
        for batch in batches:
            for section, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                for ctx, node, z, o, lw in root_rows(depths(unpack(a, np.int64, True), unpack(b, np.int64))[-1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ctx), section, np.int32)), pa.array(ctx), pa.array(node.astype(np.int32)), pa.array(z.astype(float)), pa.array(o.astype(float)), pa.array(lw)], names=["section", "ctx", "node", "z", "o", "lw"])

    roots = common.cut(tree.mapInArrow(grown, "section int, ctx long, node int, z double, o double, lw double"))
    handed = above_root(roots)
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    none = F.lit(None)
    empty = [none.cast("long").alias("ctx"), none.cast("int").alias("node"), *(none.cast("double").alias(c) for c in ("p", "left", "near"))]
    own = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g")
    asked = parts.filter("kind = 1").select("section", own, F.lit(0).alias("kind"), "block", "a", none.cast("binary").alias("b"), *empty)
    model = tree.select("section", every, F.lit(1).alias("kind"), none.cast("long").alias("block"), "a", "b", *empty)
    upper = handed.select("section", every, F.lit(2).alias("kind"), none.cast("long").alias("block"), none.cast("binary").alias("a"), none.cast("binary").alias("b"), "ctx", "node", "p", "left", "near")
    answer = "block long, kind int, a binary, b binary"

    def price(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        of = lambda k, c: table[c].filter(pa.array(kind == k))
        if not (kind == 1).any() or not (kind == 0).any():
            return _table([], answer)
        keys, counts = unpack(of(1, "a")[0].as_py(), np.int64, True), unpack(of(1, "b")[0].as_py(), np.int64)
        cost = prices(depths(keys, counts), *(of(2, c).to_numpy() for c in ("ctx", "node", "p", "left", "near")))
        out = []
        for block, a in zip(of(0, "block").to_pylist(), of(0, "a").to_pylist()):
            out.append((block, 1, a, pack(cost[np.searchsorted(keys, unpack(a, np.int64, True))].astype(np.float32))))  # to 7 digits
        return _table(out, answer)

    priced = asked.unionByName(model).unionByName(upper).groupBy("section", "g").applyInArrow(price, answer)

    def tell(table: pa.Table) -> pa.Table:
        mine = table["block"].is_valid().to_numpy()
        if mine.all() or not mine.any():
            return _table([], answer)
        a, b = table["a"].to_pylist(), table["b"].to_pylist()
        at = int(np.flatnonzero(~mine)[0])
        counts = dict(zip(unpack_words(a[at]), unpack(b[at], np.int64).tolist()))
        blocks = table["block"].to_pylist()
        return _table([(blocks[i], 2, a[i], pack(np.fromiter(map(counts.__getitem__, unpack_words(a[i])), np.int64))) for i in np.flatnonzero(mine).tolist()], answer)

    words = parts.filter("kind = 2").select("section", own, "block", "a", none.cast("binary").alias("b")).unionByName(known.select("section", every, none.cast("long").alias("block"), "a", "b"))
    told = words.groupBy("section", "g").applyInArrow(tell, answer)
    base = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (v + 1)))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(table: pa.Table) -> pa.Table:
        kind, a, b = table["kind"].to_numpy(), table["a"].to_pylist(), table["b"].to_pylist()
        at = lambda k: np.flatnonzero(kind == k).tolist()
        keys = np.concatenate([np.empty(0, np.int64), *(unpack(a[i], np.int64, True) for i in at(1))])
        cost = np.concatenate([np.empty(0), *(unpack(b[i], np.float32) for i in at(1))])
        o = np.argsort(keys)
        keys, cost, count = keys[o], cost[o], {}
        for i in at(2):
            count.update(zip(unpack_words(a[i]), unpack(b[i], np.int64).tolist()))
        out = []
        for i in at(0):
            ids, learn, lines = pickle.loads(zstandard.ZstdDecompressor().decompress(a[i]))
            for lo, hi in runs(lines):
                key, starts = positions(lines[lo:hi])
                u, inverse = np.unique(key, return_inverse=True)
                total = np.add.reduceat(cost[np.searchsorted(keys, u)][inverse], starts)
                words = [x[:-1].split() for x in lines[lo:hi]]
                cuts = np.r_[0, np.cumsum([len(w) for w in words])]
                c = np.fromiter(map(count.__getitem__, chain.from_iterable(words)), np.int64, cuts[-1])
                seen, n = np.r_[0, np.cumsum(c > 0)], np.diff(cuts)
                each = base(c)
                exact = [float(each[x:y].sum()) for x, y in zip(cuts[:-1], cuts[1:])]
                for j, (doc, flag) in enumerate(zip(ids[lo:hi], learn[lo:hi])):
                    out.append((doc, not flag, int(n[j]) + 1, int(seen[cuts[j + 1]] - seen[cuts[j]]) + (n_texts > 0), n_train, exact[j] + float(base(n_texts)), float(total[j])))
        return _table(out, result)

    texts_of = parts.filter("kind = 0").select("block", "kind", "a", "b")
    return texts_of.unionByName(priced).unionByName(told).groupBy("block").applyInArrow(finish, result)


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, common.crc_mod(F.col("doc_id"), 5) != 1)
