"""Byte-level BPE over a public rank file.

Lookup has two tiers.  The distinct pre-tokens of a batch are first resolved together by a minimal perfect hash over the
vocabulary (hash and displace: one displacement for each bucket, exactly as many slots as tokens, the stored bytes are
compared).  What misses is merged with a heap over a doubly linked list of byte ranges, lowest rank first, leftmost first.
Both tiers fill a memo of bounded size, from pre-token to packed ids, that a worker keeps between tasks.

Defined cases: a null text encodes as the empty text (no ids, ``decoded`` is empty bytes); special-token strings are
ordinary text; very long texts are encoded whole; repeated rows give repeated results; an empty table gives an empty
table; columns other than the identifier and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MEMO_ENTRIES = 250_000


class PerfectHash:
    """Minimal perfect hash from byte strings to 0..n-1 with vectorised lookups."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n = np.uint64(max(n, 1))
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, n)
        if len(np.unique(h)) != n:
            raise ValueError("two keys share a 64-bit hash")
        self.displacement = np.zeros(int(self.n), np.int64)
        self.key_at = np.full(int(self.n), -1, np.int64)
        bucket = (h % self.n).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if n else np.empty(0, np.int64)
        groups = sorted(np.split(order, starts[1:]), key=len, reverse=True) if n else []
        free = np.ones(int(self.n), bool)
        singles = []
        for g in groups:
            if len(g) == 1:
                singles.append(g[0])
                continue
            d = 1
            while True:
                at = self._slot(h[g], np.uint64(d))
                if free[at].all() and len(set(at.tolist())) == len(g):
                    break
                d += 1
            free[at] = False
            self.key_at[at] = g
            self.displacement[bucket[g[0]]] = d
        for k, slot in zip(singles, np.flatnonzero(free)):
            self.key_at[slot] = k
            self.displacement[bucket[k]] = -slot - 1
        self.hash_at = np.where(self.key_at >= 0, h[self.key_at] if n else np.uint64(0), np.uint64(0))

    def _slot(self, h: np.ndarray, d) -> np.ndarray:
        return (common.mix64(h ^ (np.atleast_1d(d) * np.uint64(0x9E3779B97F4A7C15))) % self.n).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Key number of each word whose hash a key has, else -1; the caller compares the bytes."""
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        d = self.displacement[(h % self.n).astype(np.int64)]
        at = np.where(d < 0, -d - 1, self._slot(h, d.astype(np.uint64)))
        return np.where(self.hash_at[at] == h, self.key_at[at], -1)


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.tokens = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), np.int64, len(self.tokens))
        self.perfect = PerfectHash(self.tokens)
        self.bytes_of = [b""] * (int(self.ids.max(initial=-1)) + 1)
        for k, i in self.ranks.items():
            self.bytes_of[i] = k
        self.pretokens = regex.compile(pattern).findall
        self.memo = common.Memo(MEMO_ENTRIES)

    def merge(self, w: bytes) -> list[int]:
        """Ids of one pre-token by repeated merging of its lowest-ranked neighbours."""
        n, rank = len(w), self.ranks.get
        end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(w[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            right = end[i]
            if not live[i] or right >= n or end[right] != stop:
                continue  # one of the two has been merged meanwhile
            live[right] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := rank(w[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := rank(w[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[w[i : end[i]]])
            i = end[i]
        return out

    def learn(self, distinct: set[str]) -> None:
        """Put the packed ids of pre-tokens into the memo."""
        fresh = self.memo.unknown(distinct)
        words, known = [common.utf8(x) for x in fresh], self.memo.young
        for text, w, k in zip(fresh, words, self.perfect.find(words).tolist()):
            if k >= 0 and self.tokens[k] == w:
                known[text] = int(self.ids[k]).to_bytes(4, "little")
            else:
                known[text] = np.array(self.merge(w), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        found = self.pretokens(text or "")
        out = []
        for start in range(0, len(found), self.memo.size):
            part = found[start : start + self.memo.size]
            self.learn(set(part))
            out.append(b"".join(map(self.memo.young.__getitem__, part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    key = (rank_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(doc_id, ids binary[, decoded binary]): ids packed as little-endian unsigned 32-bit integers.

    A map over partitions without a shuffle; memory is one Arrow batch and the memo.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        common.rare_gc()
        c = codec(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([c.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, ids binary" + ", decoded binary" * decode
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
