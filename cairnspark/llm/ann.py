"""Approximate nearest neighbours over learned partitions.

After Dong, Indyk, Razenshteyn and Wagner ("Learning space partitions for nearest neighbor search"):

1. A bounded sample of the vectors (SAMPLE) is joined into a k-nearest-neighbour graph.
2. The graph is cut into balanced parts: a balanced start, then moves of vertices to the part where most of their
   neighbours are, as capacity allows.
3. A small classifier (softmax regression on the vector) learns the parts. It gives every row of the table, not only the
   sample, its part, and routes each query to its most probable parts. How many is fitted on the sample: the fewest
   that find TARGET of the true neighbours of held-out queries.
4. Rows are dealt by part; parts above CELL rows are salted. Each cell compares its rows with the queries routed to it,
   block by block, in double precision, and returns 20 rows per query at most; a window over these gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import table, written

#: Rows, at most, that graph, parts and classifier are fitted on; rows of one cell; recall aimed at on the sample.
SAMPLE, CELL, TARGET = 6000, 8192, 0.97
NEIGHBOURS, TOP = 10, 20


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) without null ids and vectors that are null, empty, zero or not finite."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.where("vec_id is not null")
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    )


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex; no part exceeds its share by more than the slack."""
    rng = np.random.default_rng(7)
    n, cap = len(x), int(np.ceil(len(x) / n_parts * slack))
    centre = x[rng.choice(n, n_parts, replace=False)]
    part = np.full(n, -1)
    for _ in range(6):
        score = x @ centre.T
        part[:] = -1
        room = np.full(n_parts, cap)
        for i in np.argsort(-score.max(1)):
            for p in np.argsort(-score[i]):
                if room[p]:
                    part[i], room[p] = p, room[p] - 1
                    break
        centre = np.stack([x[part == p].mean(0) if (part == p).any() else centre[p] for p in range(n_parts)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    room = cap - np.bincount(part, minlength=n_parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[np.concatenate([graph[i], np.array(back[i], np.int64)])], minlength=n_parts)
            p = int(np.argmax(np.where(room > 0, votes, -1)))
            if p != part[i] and votes[p] > votes[part[i]]:
                room[part[i]] += 1
                room[p] -= 1
                part[i] = p
                moved += 1
        if moved < n // 200:
            break
    return part


def fit_classifier(x: np.ndarray, part: np.ndarray, n_parts: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient descent with momentum; its weights and biases."""
    w, b = np.zeros((x.shape[1], n_parts)), np.zeros(n_parts)
    scale = np.sqrt((x**2).sum(1).mean())
    goal = np.eye(n_parts)[part]
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w / scale + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - goal) / len(x)
        vw = 0.9 * vw - 8.0 * (x.T @ g / scale + 1e-5 * w)
        vb = 0.9 * vb - 1.0 * g.sum(0)
        w, b = w + vw, b + vb
    return w / scale, b


def probes_needed(x: np.ndarray, w: np.ndarray, b: np.ndarray, target: float = TARGET) -> int:
    """The fewest parts per query that hold `target` of the true neighbours of up to 500 sampled queries."""
    z = x @ w + b
    own, rank = z.argmax(1), np.argsort(-z, axis=1)
    some = np.arange(0, len(x), max(1, len(x) // 500))
    near = neighbour_graph_of(x, some, min(TOP, len(x) - 1))
    place = np.argsort(rank[some], axis=1)  # place[q, p]: when query q visits part p
    visits = np.take_along_axis(place, own[near], axis=1)
    for p in range(1, z.shape[1] + 1):
        if (visits < p).mean() >= target:
            return p
    return z.shape[1]


def neighbour_graph_of(x: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -np.inf
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def _search(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell, stored rows before queries: a cell's stored rows are held, its queries stream by."""
    cell, ids, vecs, x, stored_ids = None, [], [], None, None
    for batch in batches:
        c = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], 1).astype(np.int64)
        ask = np.asarray(batch.column(2)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]).any(1) | (ask[1:] != ask[:-1])]))
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(batch)], strict=True):
            here = tuple(c[s])
            if here != cell:
                cell, ids, vecs, x = here, [], [], None
            v = batch.column(4).slice(s, e - s)
            m = v.flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
            who, key = (np.asarray(batch.column(i))[s:e] for i in (3, 5))
            if not ask[s]:
                ids.append(who)
                vecs.append(m)
                continue
            if x is None:
                if not vecs:
                    continue
                x, stored_ids = np.concatenate(vecs), np.concatenate(ids)
            for i in range(0, len(m), 256):
                yield from _best(m[i : i + 256], who[i : i + 256], key[i : i + 256], x, stored_ids, top)


def _best(q: np.ndarray, q_ids: np.ndarray, keys: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    own = q_ids[:, None] == ids[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        s[own] = -np.inf
        k = min(top, len(ids))
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        out_q, out_k, out_v, out_s = [], [], [], []
        for i in range(len(q)):
            near = np.flatnonzero((s[i] >= least[i] - slack[i]) & ~own[i])
            exact = (x[near] * q[i]).sum(1)  # the same order of addition for every row, so equal vectors tie
            order = np.lexsort((ids[near], -exact))[:top]
            out_q.append(np.full(len(order), q_ids[i]))
            out_k.append(np.full(len(order), keys[i]))
            out_v.append(ids[near[order]])
            out_s.append(exact[order])
    if out_q:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in (out_q, out_k, out_v, out_s)], ["query_id", "key", "vec_id", "score"]
        )


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `top` nearest rows found, by inner product.

    A row with the query's own vec_id is no candidate. Ties go to the smaller vec_id. Both inputs come from usable(),
    which leaves other columns out. Vectors whose dimension differs from the most common one take no part. Repeated rows
    are candidates of their own; equal query rows are one query, and query rows of one vec_id with different vectors have
    their neighbours each. A product beyond double precision counts as infinite. Empty tables give an
    empty result.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    dims = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    vectors, queries = (t.where(F.size("v") == dims) for t in (vectors, queries))
    share = min(1_000_000, int(1_000_000 * 1.2 * SAMPLE / n) + 1)
    picked = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < share)
    x = np.array([r[0] for r in picked.select("v").limit(SAMPLE).collect()], float).reshape(-1, dims)
    n_parts = int(min(256, max(4, n // 4096), max(1, len(x) // 40)))
    if n_parts > 1:
        graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
        w, b = fit_classifier(x, balanced_parts(x, graph, n_parts), n_parts)
        probes = probes_needed(x, w, b, target)
    else:
        w, b, probes = np.zeros((dims, 1)), np.zeros(1), 1

    def route(count: int):
        def run(batches):
            for batch in batches:
                for piece in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                    m = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), dims)
                    parts = np.argsort(-(m @ w + b), axis=1, kind="stable")[:, :count].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), piece.column(1), pa.array(parts.tolist(), pa.list_(pa.int32()))],
                        ["vec_id", "v", "parts"],
                    )

        return run

    out = "vec_id long, v array<double>, parts array<int>"
    stored = written(vectors.mapInArrow(K.tidy(route(1)), out).select("vec_id", "v", F.get("parts", F.lit(0)).alias("part")), "vectors")
    salts = stored.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("salts"))  # a row per part
    stored = stored.join(F.broadcast(salts), "part").select(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("ask"), "vec_id", "v", F.lit(0).cast("long").alias("key")
    )
    asked = (
        queries.dropDuplicates(["vec_id", "v"]).mapInArrow(K.tidy(route(probes)), out)
        .select("vec_id", "v", F.explode("parts").alias("part"))
        .join(F.broadcast(salts), "part")
        .select("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("ask"), "vec_id", "v", F.xxhash64("v").alias("key"))
    )
    found = (
        stored.unionByName(asked)
        .repartition("part", "salt")
        .sortWithinPartitions("part", "salt", "ask")
        .mapInArrow(K.tidy(lambda it: _search(it, top)), "query_id long, key long, vec_id long, score double")
    )
    order = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    )


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    v = usable(table(spark, sf_dir, "embeddings"))
    return nearest(v, v.where(F.col("vec_id") % 20 == 0))
