"""Approximate nearest neighbours over learned partitions.

A bounded sample (``sample`` rows, least hashes) gets an exact neighbour graph; the graph is cut into balanced parts by
rounds in which each vertex moves to the part most of its neighbours are in, under a capacity.  A softmax classifier learns
the parts; every row of the table is indexed by its likeliest part, and a query goes to its likeliest parts, whose rows are
ranked by exact cosine in double precision.  The number of parts grows with the root of the number of rows, up to one for each
``ROWS_A_PART`` rows of the sample.  How many parts are probed is measured, not set: the fewest with which queries of the
sample find ``target`` of their neighbours in it.  So vectors with clusters are searched in a few parts, while vectors
without structure need many, which no partition can mend.  Rows of a part are dealt to salts by the part's size, so a part
that very many rows share is many groups.

Defined cases: vectors null, zero or holding null or non-finite components take no part, nor do null identifiers; vectors of
each length are searched among their own, and a length that the sample lacks is one part; ties go to the smaller identifier;
of several rows with one identifier that is a query the least vector asks, and as candidates each counts; fewer candidates
than k give all; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .topk import matrices

SAMPLE, ROWS_A_PART, GROUP_ROWS, TARGET, SMALL = 4096, 16, 8192, 0.95, 1024


def partition_graph(x: np.ndarray, parts: int, neighbours: int = 10, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Part of each row of ``x`` (unit vectors): seeds, then capped moves to the part most neighbours are in."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    graph = np.argsort(-sims, axis=1, kind="stable")[:, : min(neighbours, max(n - 1, 0))]
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, parts, replace=False)]
    capacity = int(np.ceil(1.15 * n / parts))
    label = np.zeros(n, np.int64)
    for r in range(rounds):
        affinity = x @ centres.T
        if r:
            votes = np.zeros((n, parts))
            for j in range(graph.shape[1]):
                votes[np.arange(n), label[graph[:, j]]] += 1 / graph.shape[1]
            affinity = affinity + votes
        room = np.full(parts, capacity)
        for i in np.argsort(-affinity.max(1), kind="stable"):
            for p in np.argsort(-affinity[i], kind="stable"):
                if room[p]:
                    label[i], room[p] = p, room[p] - 1
                    break
        for p in range(parts):
            if (label == p).any():
                c = x[label == p].mean(0)
                centres[p] = c / max(np.linalg.norm(c), 1e-12)
    return label


def classifier(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    for p in range(parts):
        if (label == p).any():
            w[:, p] = 8 * x[label == p].mean(0)
    y = np.eye(parts)[label]
    for _ in range(steps):
        z = x @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        g = (z / z.sum(1, keepdims=True) - y) / len(x)
        w -= 20 * (x.T @ g + 1e-5 * w)
        b -= 5 * g.sum(0)
    return w, b


def learn(x: np.ndarray, n: int, k: int, target: float):
    """(weights, biases, probes) for a table of ``n`` rows from the unit vectors ``x`` of its sample."""
    parts = max(1, min(round(n**0.5), len(x) // ROWS_A_PART)) if n >= SMALL else 1
    if parts == 1:
        return np.zeros((x.shape[1], 1)), np.zeros(1), 1
    w, b = classifier(x, partition_graph(x, parts), parts)
    z = x @ w + b
    asked = np.arange(0, len(x), max(1, len(x) // 512))
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -2
    near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-z[asked], axis=1, kind="stable"), axis=1)
    needed = np.sort(place[np.arange(len(asked))[:, None], z.argmax(1)[near]].ravel())
    return w, b, int(needed[min(int(np.ceil(target * len(needed))), len(needed) - 1)]) + 1


def route(batch: pa.RecordBatch, models, take):
    """Rows of a batch with what ``take(logits, model)`` makes of them; a length without a model has one part."""
    for dim, at, m in matrices(batch, "v"):
        got = take(m / np.linalg.norm(m, axis=1, keepdims=True) @ models[dim][0] + models[dim][1], dim) if dim in models else [[0]] * len(at)
        rows = pa.array(at)
        yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), pa.array(got, pa.list_(pa.int32())), batch["id"].take(rows), batch["v"].take(rows)], names=["dim", "parts", "id", "v"])


def nearest(q: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query identifier, cosine, identifier) of the k nearest rows to each query; the cosines do not depend on the blocks."""
    lengths, out = np.linalg.norm(rows, axis=1), []
    for start in range(0, len(q), 512):
        part = q[start : start + 512]
        rough = (rows @ part.T) / lengths[:, None] / np.linalg.norm(part, axis=1)
        for i in range(len(part)):
            column, name = rough[:, i], query_ids[start + i]
            left = np.flatnonzero(ids != name)
            if len(left) > k:
                left = left[column[left] >= np.partition(column[left], len(left) - k)[len(left) - k] - 1e-9]
            s = (rows[left] * part[i]).sum(1) / (lengths[left] * np.linalg.norm(part[i]))
            top = np.lexsort((ids[left], -s))[:k]
            out += zip([int(name)] * len(top), s[top].tolist(), ids[left][top].tolist())
    return out


@common.owned
def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose identifier is divisible by ``every``."""
    spark = vectors.sparkSession
    common.ship(spark)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = f"`{id_col}` is not null and size(`{vector_col}`) > 0 and forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{vector_col}`, x -> x <> 0)"
    rows = common.cut(vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v")))
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()  # at most ``sample`` rows
    models = {}
    for dim, at, x in matrices(drawn, "v"):
        x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
        models[dim] = learn(x, n * len(at) // len(drawn), k, target)
    shared = common.broadcast(spark, models)

    def homes(batches):
        for batch in batches:
            yield from route(batch, shared.value, lambda z, _: z.argmax(1)[:, None].tolist())

    placed = common.cut(rows.mapInArrow(homes, "dim int, parts array<int>, id long, v array<double>").select("dim", F.col("parts")[0].alias("part"), "id", "v"))
    # at most one row for each part of each learned length, of which a sample holds no more than it has rows
    counted = placed.filter(F.col("dim").isin(list(models))).groupBy("dim", "part").count()
    sizes = {(r["dim"], r["part"]): r["count"] for r in counted.collect()} if models else {}
    salts = spark.createDataFrame([(d, p, -(-c // GROUP_ROWS)) for (d, p), c in sizes.items()], "dim int, part int, salts int")
    held = common.broadcast(spark, {d: np.array([sizes.get((d, p), 0) for p in range(m[0].shape[1])]) for d, m in models.items()})

    def probes(batches):
        def take(z, dim):
            order = np.argsort(-z, axis=1, kind="stable")
            enough = (np.cumsum(held.value[dim][order], axis=1) < 8 * k).sum(1) + 1
            return [o[: max(shared.value[dim][2], e)].tolist() for o, e in zip(order, enough)]

        for batch in batches:
            yield from route(batch, shared.value, take)

    asked = rows.filter(f"id % {every} = 0").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(probes, "dim int, parts array<int>, id long, v array<double>")
    asked = asked.select("dim", F.explode("parts").alias("part"), "id", "v").join(F.broadcast(salts), ["dim", "part"], "left")
    many = F.coalesce("salts", F.lit(max(1, -(-n // GROUP_ROWS))))
    candidates = placed.join(F.broadcast(salts), ["dim", "part"], "left").select("dim", "part", F.pmod(F.xxhash64("id", F.lit(3)), many).cast("int").alias("salt"), "id", "v", F.lit(0).alias("is_query"))
    queries = asked.select("dim", "part", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"), "id", "v", F.lit(1).alias("is_query"))

    def rerank(table: pa.Table) -> pa.Table:
        is_query, ids = table["is_query"].to_numpy() == 1, table["id"].to_numpy()
        out = []
        for _, at, x in matrices(table, "v"):
            q = is_query[at]
            if q.any() and not q.all():
                out += nearest(x[q], ids[at][q], x[~q], ids[at][~q], k)
        columns = list(zip(*out)) if out else [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "score", "vec_id"])

    found = candidates.union(queries).groupBy("dim", "part", "salt").applyInArrow(rerank, "query_id long, score double, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
