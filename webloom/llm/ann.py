"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed in ``TABLES`` tables by ``HASHES`` Gaussian projections
each, cut into cells of ``WIDTH`` (a bucket is a tuple of cells).  A query
visits perturbed buckets in the order of their estimated success: a neighbour
at cosine c projects near c times the query's projection with spread
sqrt(1 - c^2), so each cell has a probability and buckets come best first until
they add up to the wanted coverage, for near copies and for far neighbours.
Every visited bucket is searched exactly, in double precision on the original
vectors, and the tables' candidates are merged and ranked.

The first visits expect the cosines of ``SCALES``.  A query whose k-th cosine
found is lower goes on to the buckets that cover that cosine; a query with fewer
than k found, or with a k-th cosine below ``LEAST_SCALE``, where the buckets to
visit hold nearly all rows anyhow, is compared with every row of its length.

Buckets of any size are cut into blocks of rows and of queries before they are
joined, so a vector that holds a third of all rows meets no single task, and a
block returns only its best few per query (equal scores are cut by the smaller
id, as in the end result).  Every row is indexed, every visited bucket searched
whole.  Vectors of different lengths never meet.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; equal rows (id and vector)
count once, a query id with several vectors gets the best over all of them; fewer
candidates than k are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webloom.llm.common import lean, written

TABLES, HASHES, WIDTH = 2, 8, 2.0
#: Cosines that the visiting order expects, and the probability to cover for each.
SCALES = ((0.99, 0.9), (0.43, 0.8))
#: Queries whose k-th cosine found is below this are compared with all rows.
LEAST_SCALE = 0.2
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
SEED = 20240229

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def usable(v: Column) -> Column:
    """Not null, not empty, all components present and finite, not all zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def _projections(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim, table))
    return rng.normal(size=(dim, HASHES)), rng.uniform(0.0, WIDTH, HASHES)


def _bucket(cells: np.ndarray, dim: int, table: int) -> np.ndarray:
    """64-bit names of buckets; cells: (n, HASHES) integers."""
    h = np.full(len(cells), np.uint64(dim * 131 + table), dtype=np.uint64)
    for k in range(cells.shape[1]):
        h = (h ^ cells[:, k].astype(np.int64).view(np.uint64)) * _ODD[k % 4]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of each vector length in a batch."""
    lists = batch.column(1)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, vectors in _by_length(batch):
            dim, rows = vectors.shape[1], batch.take(pa.array(at))
            for table in range(TABLES):
                a, b = _projections(dim, table)
                cells = np.floor((_unit(vectors) @ a + b) / WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(cells, dim, table)), *rows.columns],
                                                 names=["bucket", "vec_id", "v"])


def visits(p: np.ndarray, b: np.ndarray, cosine: float, cover: float) -> Iterator[tuple[int, ...]]:
    """Cells in falling order of probability that they hold a neighbour at
    this cosine, up to the wanted sum.  p: a query's projections."""
    mean, spread = cosine * p, math.sqrt(1.0 - cosine * cosine)
    normal = lambda x: 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))
    options = []
    for m, offset in zip(mean, b, strict=True):
        home = math.floor((m + offset) / WIDTH)
        reach = 2 + math.ceil(4 * spread / WIDTH)
        edges = [normal((k * WIDTH - offset - m) / spread) for k in range(home - reach, home + reach + 2)]
        costs = [(-math.log(hi - lo), home - reach + k) for k, (lo, hi) in
                 enumerate(zip(edges, edges[1:], strict=False)) if hi - lo > 1e-9]
        options.append(sorted(costs))
    start = (0,) * len(options)
    heap = [(sum(o[0][0] for o in options), start, 0)]
    total = 0.0
    while heap and total < cover:
        cost, ranks, last = heapq.heappop(heap)
        total += math.exp(-cost)
        yield tuple(options[i][r][1] for i, r in enumerate(ranks))
        for i in range(last, len(ranks)):       # each rank tuple is made once
            if ranks[i] + 1 < len(options[i]):
                more = options[i][ranks[i] + 1][0] - options[i][ranks[i]][0]
                heapq.heappush(heap, (cost + more, (*ranks[:i], ranks[i] + 1, *ranks[i + 1:]), i))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each query, by SCALES or by the cosine in a fourth column."""
    for batch in batches:
        own = batch.column(3).to_numpy() if batch.num_columns > 3 else None
        for at, vectors in _by_length(batch):
            dim = vectors.shape[1]
            unit = _unit(vectors)
            for table in range(TABLES):
                a, b = _projections(dim, table)
                projected = unit @ a
                for row, p in zip(at, projected, strict=True):
                    home = tuple(np.floor((p + b) / WIDTH).astype(np.int64).tolist())
                    scales = SCALES if own is None else ((own[row], SCALES[-1][1]),)
                    cells = dict.fromkeys([home, *(c for scale in scales for c in visits(p, b, *scale))])
                    names = np.unique(_bucket(np.array(list(cells), dtype=np.int64), dim, table))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names), batch.column(2).take(pa.array(np.full(len(names), row)))],
                        names=["bucket", "query"])


def _vectors(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = t.column(name).combine_chunks()
    n = len(lists)
    return t.column(0).to_numpy(), lists.flatten().to_numpy().reshape(n, -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in a fixed order of summation: equal pairs score equal."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _search(k: int):
    """Best k rows of a block for each of its queries, by exact cosine."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, x = _vectors(rows.select(["vec_id", "v"]), "v") if rows.num_rows else (None, None)
        if ids is None or not queries.num_rows:
            return schema.empty_table()
        qid, q = _vectors(queries.select(["query_id", "q"]), "q")
        if x.shape[1] != q.shape[1]:            # two lengths under one bucket name
            return schema.empty_table()
        near = _unit(q) @ _unit(x).T
        near[qid[:, None] == ids[None, :]] = -np.inf
        out = []
        for i in range(len(qid)):
            own = near[i]
            least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -2.0
            at = np.flatnonzero(own >= max(least, -2.0) - 1e-9)
            if len(at):
                exact = cosines(x[at], np.broadcast_to(q[i], (len(at), q.shape[1])))
                best = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(len(best), qid[i]), ids[at][best], exact[best]))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)
    return run


def _compared(index: DataFrame, probes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best k rows of each block of the probed buckets, for each query; buckets
    without rows drop out."""
    sizes = (index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
             .join(probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "bucket")
             .select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("row_blocks"),
                     F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("query_blocks")))
    sizes = written(sizes, "ann-sizes")
    left = (index.join(sizes, "bucket")
            .select("vec_id", "v", "bucket", F.expr("CAST(pmod(xxhash64(vec_id, v), row_blocks) AS INT)").alias("rb"),
                    F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("qb")))
    right = (probes.join(sizes, "bucket")
             .select("bucket", "query", F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("rb"),
                     F.expr("CAST(pmod(query, query_blocks) AS INT)").alias("qb"))
             .join(asked.select("query", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query")
             .select("query_id", "q", "bucket", "rb", "qb"))
    block = ["bucket", "rb", "qb"]
    return (left.groupBy(*block).cogroup(right.groupBy(*block))
            .applyInArrow(_search(k), "query_id long, vec_id long, score double"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.dropDuplicates(["query_id", "vec_id", "score"])
            .withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that
    ``queries`` (a condition over the column ``vec_id``) selects."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"])
    rows = written(rows, "ann-rows")
    index = rows.mapInArrow(lean(_index), "bucket long, vec_id long, v array<double>")
    asked = rows.filter(queries).withColumn("query", F.xxhash64("vec_id", "v"))
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def visited(some: DataFrame) -> DataFrame:
        return some.repartition(spread, "query").mapInArrow(lean(_probe), "bucket long, query long")

    probes = written(visited(asked), "ann-probes")
    found = written(_ranked(_compared(index, probes, asked, k), k), "ann-found")

    # Queries that found too little for the cosines expected go on, at the k-th cosine found.
    kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("scale"))
    asked = written(asked.join(kth, "vec_id", "left")
                    .filter(F.coalesce(F.col("scale") < min(c for c, _ in SCALES), F.lit(True)))
                    .select("vec_id", "v", "query", "scale"), "ann-again")
    far = F.coalesce(F.col("scale") < LEAST_SCALE, F.lit(True))
    parts = [found.drop("rank")]
    some, rest = asked.filter(~far), asked.filter(far)
    if not some.isEmpty():
        more = written(visited(some).join(probes, ["bucket", "query"], "left_anti"), "ann-more")
        parts.append(_compared(index, more, some, k))
    if not rest.isEmpty():
        whole = rows.select(F.size("v").cast("long").alias("bucket"), "vec_id", "v")
        parts.append(_compared(whole, rest.select(F.size("v").cast("long").alias("bucket"), "query"), rest, k))
    if len(parts) == 1:
        return found
    for part in parts[1:]:
        parts[0] = parts[0].union(part)
    return _ranked(parts[0], k)
