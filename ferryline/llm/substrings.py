"""Exact removal of repeated passages by level-wise doubling.

Windows of 10 words are hashed; of the 11 in a 20-word window the one with the least hash stands for it, so equal windows
have equal stand-ins and a stand-in that occurs once rules its windows out.  Windows whose stand-in repeats, and no others, are
extended to twice the length, 20 words; of equal windows of 20 words the first in (document, start) stays, and the words the
others cover go.  The second level sends only what survived the first.  Levels start at 10 words, not at 5, as windows of 5
words repeat by chance, which grows with the square of the input and at scale rules nothing out.  Hashes of a level are summed
up before the shuffle, so a passage in very many documents is no bottleneck; a final window is told by 95 bits of hash over its
two halves.

Words are hashed over all bytes of a text at once: a word's polynomial in its bytes is the difference of two prefix sums.
Words over ``LONG`` bytes, where such sums modulo 2**64 can be made to agree, are hashed one at a time.

Defined cases: a null text has no words; texts under 20 words lose none; null identifiers come last in order, rows with one
identifier in order of their reading; long texts are read whole; repeated rows repeat each other; an empty table gives an
empty table; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, HALF = 20, 10
TURNS = 4  # the windows that survive are exchanged in so many turns, each of which frees its shuffle files
LONG, PIECE = 64, 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte; powers of a factor modulo 2**64 and of its inverse."""
    if not _POWERS:
        def row(factor: int) -> np.ndarray:
            out = np.full(PIECE, factor, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        factor = 0xD1342543DE82EF95
        _POWERS.extend([common.mix64(np.arange(1, 257, dtype=np.uint64) * _M), row(factor), row(pow(factor, -1, 1 << 64))])
    return tuple(_POWERS)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text in order."""
    if len(text) > PIECE:
        out, at = [], 0
        while at < len(text):
            stop = at + PIECE
            if stop < len(text):
                blanks = np.flatnonzero(_BLANK[np.frombuffer(text[at:stop], np.uint8)])
                stop = at + int(blanks[-1]) + 1 if len(blanks) else len(text)
            if stop - at > PIECE:  # a word of more than a piece, and what follows it
                words = text[at:].split(None, 1)
                out.append(np.array([xxhash.xxh64_intdigest(words[0])], np.uint64))
                at = len(text) - len(words[1]) if len(words) > 1 else len(text)
                continue
            out.append(word_hashes(text[at:stop]))
            at = stop
        return np.concatenate(out)
    raw = np.frombuffer(text, np.uint8)
    blank = np.r_[True, _BLANK[raw], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    value, up, down = powers()
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * up[: len(raw)], out=total[1:])
    h = common.mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M) if len(start) else np.empty(0, np.uint64)
    for i in np.flatnonzero(end - start > LONG):
        h[i] = xxhash.xxh64_intdigest(text[start[i] : end[i]])
    return h


def windows(text: bytes) -> np.ndarray:
    """Hashes of the windows of ``HALF`` words."""
    w = word_hashes(text)
    n = len(w) - HALF + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(HALF):
        h = h * _M + w[j : j + n]
    return common.mix64(h)


def sliding(h: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """Least (or what ``pick`` takes) of each ``n`` in a row."""
    width = 1
    while width < n:
        s = min(width, n - width)
        h = pick(h[:-s], h[s:])
        width += s
    return h


def stand_ins(h: np.ndarray, n: int) -> np.ndarray:
    """Positions that stand for a window of ``n`` hashes."""
    if len(h) < n:
        return np.empty(0, np.int64)
    least = sliding(h, n)
    pad = np.zeros(n - 1, np.uint64)
    return np.flatnonzero((sliding(np.r_[pad, least, pad], n, np.maximum) == h) & (h != 0))


def still(h: np.ndarray, n: int, at) -> np.ndarray:
    """For each window of ``n`` hashes whether what stands for it is at one of the positions ``at``."""
    flagged, at = np.full(len(h), np.iinfo(np.uint64).max, np.uint64), np.array(at)
    flagged[at] = h[at]
    return sliding(flagged, n) == sliding(h, n)


def mapped(docs: DataFrame, emit, schema: str, rows: int = 4096, size: int = 32 << 20) -> DataFrame:
    """Rows that ``emit(pieces as a table) -> list of columns`` makes of pieces of at most ``rows`` rows and about ``size`` bytes."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held, n, b = [], 0, 0

        def flush():
            cols = emit(pa.Table.from_batches(held))
            table = pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=names)
            yield from table.to_batches(max_chunksize=20_000)

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                if held and (n + part.num_rows > rows or b + part.nbytes > size):
                    yield from flush()
                    held, n, b = [], 0, 0
                held.append(part)
                n, b = n + part.num_rows, b + part.nbytes
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def packed(text: str | None) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(common.utf8(text))


def text_of(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def columns(table: pa.Table, *numbers: int):
    return zip(*(table.column(i).to_pylist() for i in numbers))


def groups(batches, n_keys: int, act):
    """Runs of equal leading ``n_keys`` columns in sorted rows, over batches: ``act(columns, starts, sizes)`` gets whole runs."""
    kept = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if kept is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(kept, cols)]
        n = len(cols[0])
        if not n:
            continue
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:n_keys]])]
        last = int(np.flatnonzero(new)[-1])
        if last:
            starts = np.flatnonzero(new[:last])
            yield from act([c[:last] for c in cols], starts, np.diff(np.r_[starts, last]))
        kept = [c[last:] for c in cols]
    if kept is not None and len(kept[0]):
        yield from act(kept, np.zeros(1, np.int64), np.array([len(kept[0])]))


def repeated(rows: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """The table behind it, and (row, at): the positions of keys that occur more than once, as an array for each row.

    ``keys`` gives (hashes, positions) of a row of ``rows``, whose first columns are row and doc_id.  Of a hash that a piece holds
    several times only one row is sent, with its count; the others are settled at once.
    """

    def emit(t):
        hs, rs, ps = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for row, *more in columns(t, 0, *range(2, t.num_columns)):
            h, at = keys(*more)
            hs.append(h)
            rs.append(np.full(len(at), row, np.int64))
            ps.append(at.astype(np.int32))
        h, r, p = np.concatenate(hs), np.concatenate(rs), np.concatenate(ps)
        o = np.argsort(h, kind="stable")
        h, r, p = h[o], r[o], p[o]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        n = np.diff(np.r_[np.flatnonzero(new), len(h)])
        count = np.zeros(len(h), np.int32)
        count[new] = n  # zero: settled
        return [h.view(np.int64), count, r, p]

    sent = common.cut(mapped(rows, emit, "h long, n int, row long, at int"))

    def twice(batches):
        def act(cols, starts, sizes):
            total = np.add.reduceat(cols[1], starts)
            ok = np.repeat(total > 1, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(cols[2][ok]), pa.array(cols[3][ok])], names=["row", "at"])

        return groups(batches, 1, act)

    across = sent.filter("n > 0").repartition("h").sortWithinPartitions("h").mapInArrow(twice, "row long, at int")
    return sent, across.union(sent.filter("n = 0").select("row", "at")).groupBy("row").agg(F.collect_list("at").alias("at"))


def half_keys(blob: bytes):
    """The windows of half the length that stand for the windows of a text."""
    h = windows(text_of(blob))
    at = stand_ins(h, WINDOW - HALF + 1)
    return h[at], at


@common.owned
def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string[, clean string, carried columns]): ``kept`` is the words left, joined by one blank.

    ``clean`` is the text itself where no word goes, else ``kept``.  Texts travel compressed.
    """
    common.ship(docs.sparkSession)
    raw = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    kinds = "".join(f", carried_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    rows = common.cut(mapped(raw, lambda t: [t.column(0), t.column(1), pa.array(list(map(packed, t.column(2).to_pylist())), pa.binary()), *t.columns[3:]], "row long, doc_id long, blob binary" + kinds, rows=512))
    blobs = rows.select("row", "doc_id", "blob")

    def windows_of(t):
        out = [[np.empty(0, d)] for d in (np.int64, np.int64, np.int64, np.int64, np.int32)]
        for row, doc, blob, at in columns(t, 0, 1, 2, 3):
            h = windows(text_of(blob))
            s = np.flatnonzero(still(h, WINDOW - HALF + 1, at))
            for o, c in zip(out, (h[s].view(np.int64), h[s + HALF].view(np.int64), np.full(len(s), np.iinfo(np.int64).max if doc is None else doc, np.int64), np.full(len(s), row, np.int64), s.astype(np.int32))):
                o.append(c)
        a, b, doc, row, start = map(np.concatenate, out)
        h = a.view(np.uint64) * _M + b.view(np.uint64)  # 64 bits of both halves, and 32 more
        a, b = common.mix64(h).view(np.int64), (common.mix64(h ^ common.mix64(a.view(np.uint64))) >> np.uint64(33)).astype(np.int32)
        o = np.lexsort((start, row, doc, b, a))
        a, b, doc, row, start = a[o], b[o], doc[o], row[o], start[o]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        return [a, b, doc, row, start, (~first).astype(np.int32)]  # a later window of the piece is settled: it goes

    table, halves = repeated(blobs, half_keys)
    extended = common.cut(mapped(blobs.join(halves, "row"), windows_of, "a long, b int, doc long, row long, start int, gone int"))
    common.drop(table)

    def later(batches):
        def act(cols, starts, sizes):
            ok = np.ones(len(cols[0]), bool)
            ok[starts] = False
            yield pa.RecordBatch.from_arrays([pa.array(cols[3][ok]), pa.array(cols[4][ok])], names=["row", "start"])

        return groups(batches, 2, act)

    lost = common.cut(extended.filter("gone = 1").select("row", "start"))
    for turn in range(TURNS):
        sent = extended.filter(f"gone = 0 and pmod(b, {TURNS}) = {turn}").select("a", "b", "doc", "row", "start").repartition("a", "b").sortWithinPartitions("a", "b", "doc", "row", "start")
        lost = lost.union(common.cut(sent.mapInArrow(later, "row long, start int")))
    common.drop(extended)
    gone = lost.groupBy("row").agg(F.collect_list("start").alias("starts"))

    def last(t):
        n_words, n_removed, kept, clean = [], [], [], []
        for blob, starts in columns(t, 2, 3):
            text = text_of(blob)
            words = text.split()
            n, left = len(words), words
            if starts:
                s, change = np.array(starts), np.zeros(n + 1, np.int64)
                np.add.at(change, s, 1)
                np.add.at(change, s + WINDOW, -1)
                stay = np.cumsum(change)[:-1] == 0
                left = [w for w, k in zip(words, stay.tolist()) if k]
            n_words.append(n)
            n_removed.append(n - len(left))
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            if carry:
                clean.append(kept[-1] if n > len(left) else text.decode("utf-8", "surrogatepass"))
        out = [t.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        return out + ([pa.array(clean, pa.string()), *t.columns[4:]] if carry else [])

    schema = "doc_id long, n_words long, n_removed long, kept string" + (", clean string" + kinds if carry else "")
    cleaned = mapped(rows.join(gone, "row", "left").select("row", "doc_id", "blob", "starts", *(f"carried_{c}" for c in carry)), last, schema, rows=512)
    return cleaned.withColumnsRenamed({f"carried_{c}": c for c in carry})


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
