"""What several text operators share: shipping code to executors, cutting batches by bytes, hashing, folds, memos."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import broadcast, cut, drop, owned, owning, release, shared_folder  # noqa: F401  used by the operators

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ferryline-")) / f"ferryline_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, os.path.join(package.name, p.relative_to(package)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def portions(batch: pa.RecordBatch, text: int, rows: int = 4096, size: int = 16 << 20):
    """Slices of at most ``rows`` rows and about ``size`` bytes in the column ``text``; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, done + size, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def crc_mod(id_col, modulus: int):
    """crc32 of the identifier as text, modulo ``modulus``: how rows are dealt to folds."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def rare_gc() -> None:
    """Collect cycles seldom in a worker that makes millions of small, acyclic objects."""
    gc.set_threshold(500_000, 20, 50)


class Memo:
    """What a worker remembers of words: two generations, of which the older is dropped when the younger is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def unknown(self, distinct: set) -> list:
        """Words to be put into ``young`` by the caller, who then finds all of ``distinct`` there."""
        if len(self.young) + len(distinct) > self.size:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for w in distinct.difference(young):
            if (v := old.get(w)) is None:
                out.append(w)
            else:
                young[w] = v
        return out
