"""SimHash fingerprints, links between near fingerprints, and the groups these links make.

A fingerprint's bits are the majority of the XXH64 values of a text's word shingles.  Fingerprints that differ in at most
``max_bits`` = 4 bits are linked exactly: cut into three segments, two of them differ by at most one bit in some segment.
So each distinct fingerprint is indexed under every segment with one bit blanked out (64 keys); equal keys meet, and
each meeting pair is verified.  A key with many fingerprints is dealt out in chunks, each pair of chunks to one task.
A task keeps a union-find over what it has seen and passes on only links that join something new, never all pairs of a
group; every link stays implied.  Identical fingerprints are one node from the start.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a text with fewer words than a
shingle is one shingle; repeated rows are one node; ``component_id`` is the least identifier that is not null; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width); three, as 4 bits over three segments leave one with at most 1
CHUNK = 8192
NODES = 16384  # fingerprints a task indexes: each makes 64 rows, which a task holds until they are shuffled


def fingerprint(text: str | None, words_in_shingle: int = 4) -> int:
    """Majority fingerprint of one text as an unsigned integer."""
    words = common.utf8(text).lower().split()
    if not words:
        return 0
    line, k = b" ".join(words), min(words_in_shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed long."""
    common.ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                fps = np.array([fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union-find over integers that tells whether a link joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def near(a: np.ndarray, b, max_bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits  # of signed integers it would count the magnitude's bits


def link_large(fps: np.ndarray, forest: Forest, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what one group's fingerprints connect: stars round leaders first, then pairs of stars not yet joined."""
    out, stars, free = [], [], np.ones(len(fps), bool)
    while free.any():
        leader = fps[int(np.argmax(free))]
        close = near(fps, leader, max_bits)
        out += [(int(leader), int(x)) for x in fps[close] if forest.join(int(leader), int(x))]
        stars.append(fps[close & free])
        free &= ~close
    for i, s in enumerate(stars):
        for t in stars[i + 1 :]:
            for x in s:
                if forest.root(int(s[0])) == forest.root(int(t[0])):
                    break
                at = np.flatnonzero(near(t, x, max_bits))
                if len(at) and forest.join(int(x), int(t[at[0]])):
                    out.append((int(x), int(t[at[0]])))
    return out


def link_groups(batches, max_bits: int, large: int = 48):
    """From rows (key, pair, fp) sorted by (key, pair) to links; groups may span batches."""
    forest, kept = Forest(), None

    def links(group: np.ndarray, fps: np.ndarray):
        cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)])
        sizes = np.diff(np.r_[cuts, len(fps)])
        out = []
        small = np.repeat(sizes <= large, sizes)
        number, g, f = np.repeat(np.arange(len(sizes)), sizes)[small], None, fps[small]
        for d in range(1, int(sizes[sizes <= large].max(initial=1))):
            at = np.flatnonzero((number[d:] == number[:-d]) & near(f[d:], f[:-d], max_bits))
            out += [(a, b) for a, b in zip(f[at].tolist(), f[at + d].tolist()) if forest.join(a, b)]
        for start, n in zip(cuts[sizes > large].tolist(), sizes[sizes > large].tolist()):
            out += link_large(fps[start : start + n], forest, max_bits)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    for batch in batches:
        group, fps = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), batch.column(2).to_numpy()
        if kept is not None:
            group, fps = np.concatenate([kept[0], group]), np.concatenate([kept[1], fps])
        if not len(fps):
            continue
        last = len(fps) - int(np.argmax((group[::-1] != group[-1]).any(1))) if (group != group[-1]).any() else 0
        if last:
            yield links(group[:last], fps[:last])
        kept = group[last:], fps[last:]
    if kept is not None and len(kept[1]):
        yield links(*kept)


def variants(nodes: DataFrame) -> DataFrame:
    """(key, fp) for each segment of each fingerprint with one bit blanked; the key holds segment, bit and value."""
    keys = []
    for s, (low, width) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            tag = (s << 40) | (bit << 32)
            keys.append(value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))).bitwiseOR(F.lit(tag)))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(nodes: DataFrame, *, max_bits: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within ``max_bits`` (at most 4)."""
    if not 0 <= max_bits <= 4:
        raise ValueError("three segments with one blank find at most 4 differing bits")
    common.ship(nodes.sparkSession)
    index = variants(nodes.repartition(1 + nodes.count() // NODES, "fp"))
    crowded = index.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.expr(f"cast((count + {chunk - 1}) div {chunk} as int)").alias("m"))
    met = index.join(crowded, "key", "left").select("key", "fp", F.coalesce("m", F.lit(1)).alias("m"))
    c = F.pmod(F.xxhash64("fp"), F.col("m"))
    other = F.explode(F.when(F.col("m") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("m") - F.lit(1).cast("long"))))
    dealt = met.withColumn("c", c).withColumn("other", other).select("key", (F.least("c", "other") * F.lit(1 << 24) + F.greatest("c", "other")).alias("pair"), "fp")
    placed = dealt.repartition(F.col("key"), F.col("pair")).sortWithinPartitions("key", "pair")
    return placed.mapInArrow(lambda batches: link_groups(batches, max_bits), "a long, b long")


@common.owned
def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, label, component_id): ``label`` is one fingerprint of the group, equal for all its rows."""
    rows = common.cut(fingerprints(docs, id_col=id_col, text_col=text_col, words_in_shingle=words_in_shingle))
    nodes = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(nodes.select("fp"), max_bits=max_bits))
    if labels is None:
        named = nodes.withColumn("label", F.col("fp"))
    else:
        named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = common.cut(named)
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    grouped = named.select("fp", "label").join(least, "label")
    return rows.join(grouped, "fp").select("doc_id", "fp", "label", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
