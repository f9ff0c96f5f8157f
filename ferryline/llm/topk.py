"""Exact top-k inner products by aggregation of sorted lists without random access.

Candidates come in blocks; a block keeps one list for each component, sorted by value.  A query reads all its lists in step,
each from the end that its component's sign favours, to growing depths.  What has been read of a candidate gives its score so
far; what has not is bounded in two ways, by the values at which the lists stand and by the lengths of the unread parts of
candidate and query (Cauchy-Schwarz).  The k-th largest lower bound is the floor; a query brings one along from a bounded
sample of the rows (``sample``), so blocks share it without waiting for one another.  Reading stops once few candidates
reach the floor: all others cannot qualify; the final scores of those left are resolved exactly in integers.  The lists of a
block are read for many queries at once: entries read so far are masks, and sums over them are matrix products.

On vectors without structure the bounds exclude outsiders only after most of each list is read; ``with_depth`` returns how far.

Defined cases: vectors null, empty, or with a null or non-finite component take no part; vectors of several lengths are
searched apart, each among its own length; ties go to the smaller identifier; fewer candidates than k give all; null
identifiers take no part; all rows of the query's own identifier are its own; of several rows with one identifier that is a
query, the least vector is the query, and as candidates of others each counts; products beyond 2**53 are summed in exact
integers; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_ROWS, GROUP_ROWS, SAMPLE = 8192, 4096, 4096
DEPTHS = (0.6, 0.75, 0.9)  # shares of a list after which bounds are taken; beyond the last the rest is read
PANEL = 2048, 512  # rows and queries whose bounds are held at once


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of integer rows (n, d) and queries (m, d), exact at every size."""
    if len(rows) and len(queries) and float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] >= 2**53:
        return (rows.astype(object) @ queries.astype(object).T).astype(np.int64)
    return (rows.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column; minus infinity where there are fewer."""
    if len(scores) < k:
        return np.full(scores.shape[1], -np.inf)
    return np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]


class Lists:
    """The sorted lists of a panel of rows, with what is read of them to some depth."""

    def __init__(self, rows: np.ndarray):
        self.x = rows.astype(np.float64)
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(rows))[:, None], axis=0)
        self.square = self.x * self.x

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows, queries) once ``depth`` entries of each list are read."""
        n, up, down = len(self.x), np.maximum(q, 0), np.minimum(q, 0)
        head, tail = self.rank >= n - depth, self.rank < depth
        read = np.hstack([head, tail]).astype(np.float64)
        known = np.hstack([np.where(head, self.x, 0), np.where(tail, self.x, 0)]) @ np.hstack([up, down]).T
        high, low = self.values[n - 1 - depth], self.values[depth]
        best, worst = np.hstack([up * high, down * low]), np.hstack([up * self.values[0], down * self.values[-1]])
        most, least = best.sum(1) - read @ best.T, worst.sum(1) - read @ worst.T
        own = self.square.sum(1)[:, None] - np.hstack([np.where(head, self.square, 0), np.where(tail, self.square, 0)]) @ np.hstack([q > 0, q <= 0]).astype(np.float64).T
        asked = (q * q).sum(1) - read @ np.hstack([up * up, down * down]).T
        length = np.sqrt(np.maximum(own, 0) * np.maximum(asked, 0)) * (1 + 1e-9) + 1e-6
        return known + np.maximum(least, -length), known + np.minimum(most, length)


def best(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query number, scores, identifiers, share read) of each query's k best in one block, by sorted lists with bounds.

    Candidates below a query's floor may be left out, as k others reach it elsewhere.
    """
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] < 2**53
    for start in range(0, len(rows), PANEL[0]):
        x, at = rows[start : start + PANEL[0]], ids[start : start + PANEL[0]]
        lists, n = Lists(x) if exact else None, len(x)
        for first in range(0, len(queries), PANEL[1]):
            some = np.arange(first, min(first + PANEL[1], len(queries)))
            own = at[:, None] == query_ids[some]
            floor, waiting = floors[some].copy(), np.arange(len(some))
            for share in DEPTHS if exact and n > 8 * k else ():
                low, high = lists.bounds(queries[some[waiting]].astype(np.float64), min(n - 1, int(n * share)))
                low[own[:, waiting]] = -np.inf
                floor[waiting] = np.maximum(floor[waiting], kth(low, k))
                alive = (high >= floor[waiting]) & ~own[:, waiting]
                done = alive.sum(0) <= max(4 * k, n // 32)
                for j in np.flatnonzero(done):
                    left, i = np.flatnonzero(alive[:, j]), some[waiting[j]]
                    score = products(x[left], queries[i : i + 1])[:, 0]
                    top = np.lexsort((at[left], -score))[:k]
                    yield i, score[top], at[left][top], share
                waiting = waiting[~done]
                if not len(waiting):
                    break
            if len(waiting):
                score = products(x, queries[some[waiting]])
                for j, w in enumerate(waiting):
                    column = score[:, j]
                    left = np.flatnonzero(~own[:, w])
                    if len(left) > k:
                        left = left[column[left] >= np.partition(column[left], len(left) - k)[len(left) - k]]
                    top = left[np.lexsort((at[left], -column[left]))[:k]]
                    yield some[w], column[top], at[top], 1.0


def matrices(table: pa.Table | pa.RecordBatch, column: str):
    """(length, row numbers, matrix) for each length of the arrays in ``column``."""
    lists = table[column]
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    length = lists.value_lengths().to_numpy()
    for dim in sorted(set(length.tolist())):
        at = np.flatnonzero(length == dim)
        yield dim, at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@common.owned
def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, sample: int = SAMPLE, with_depth: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score[, depth]) for queries whose identifier is divisible by ``every``."""
    spark = vectors.sparkSession
    common.ship(spark)
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    ok = f"`{id_col}` is not null and `{vector_col}` is not null and size(`{vector_col}`) > 0 and forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = common.cut(vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v")))
    n = rows.count()
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // every // GROUP_ROWS))
    drawn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()  # at most ``sample`` rows
    shared = common.broadcast(spark, {dim: (drawn["id"].to_numpy()[at], x) for dim, at, x in matrices(drawn, "v")})

    def with_floors(batches):
        for batch in batches:
            floors = np.full(batch.num_rows, -np.inf)
            ids = batch["id"].to_numpy()
            for dim, at, q in matrices(batch, "v"):
                if dim in shared.value:
                    known, x = shared.value[dim]
                    for a in range(0, len(at), 512):
                        part = at[a : a + 512]
                        score = products(x, q[a : a + 512]).astype(np.float64)
                        score[known[:, None] == ids[part]] = -np.inf
                        floors[part] = np.nextafter(kth(score, k), -np.inf)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(floors)], names=["id", "v", "floor"])

    asked = rows.filter(f"id % {every} = 0").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(with_floors, "id long, v array<bigint>, floor double")
    candidates = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "id", "v", F.lit(None).cast("double").alias("floor"))
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), "id", "v", "floor")

    def run(table: pa.Table) -> pa.Table:
        is_query, ids, floor = table["floor"].is_valid().to_numpy(), table["id"].to_numpy(), table["floor"].to_numpy()
        out = []
        for _, at, x in matrices(table, "v"):
            c, q = ~is_query[at], is_query[at]
            if c.any() and q.any():
                qid = ids[at][q]
                out += [(int(qid[i]), int(a), int(b), depth) for i, s, who, depth in best(x[q], qid, floor[at][q], x[c], ids[at][c], k) for a, b in zip(s, who)]
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "score", "vec_id", "depth"])

    found = candidates.union(queries).groupBy("b", "g").applyInArrow(run, "query_id long, score long, vec_id long, depth double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *(["depth"] * with_depth))


def op5_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), p -> p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
