"""Operator 8: exact top-k search by inner product over vector-approximation files.

Vectors are integers floor(256 * x). The approximation file holds each vector as one byte for each
dimension: its cell in a uniform grid between the dimension's least and greatest value. For a query the
cells bound the product from both sides. Only cells meet queries, in blocks. Each block scans its cells once
and keeps, for each query, the vectors whose upper bound reaches its kth best lower bound there. Spark then
takes each query's kth best lower bound over all blocks, drops the vectors whose upper bound falls short of it,
and reads the exact vectors of those left alone, a handful for each query, by a join on their place in the file.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; only
vectors of equal dimension meet; rows with a null id take no part; rows that repeat an id are candidates
each on its own, but never of a query with that id, and a repeated query id is asked once, as its first
row in order of components. Ties go to the smaller vec_id. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalendry.llm.common import materialize, prepare

K = 5
BLOCK_QUERIES, BLOCK_VECTORS, CELLS = 16_384, 16_384, 256


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _cells(values: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.clip(((values - low) / width).astype(np.int64), 0, CELLS - 1).astype(np.uint8)


def _file(batches, grids: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds the approximation (cells) to exact integer vectors."""
    for batch in batches:
        ints, cells = [], []
        for v in batch.column("raw").to_pylist():
            x = np.floor(256 * np.array(v, np.float64))
            ints.append(x.astype("<f8").tobytes())
            cells.append(_cells(x, *grids[len(x)]).tobytes())
        columns = [batch.column("vec_id"), batch.column("dim"), pa.array(ints, pa.binary()), pa.array(cells, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "exact", "cells"])


def _bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate of each product, largest error of a query's estimates)."""
    centre = low + (cells + 0.5) * width
    error = np.abs(queries) @ (width / 2)
    size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(low + CELLS * width))
    return queries @ centre.T, error + size * 1e-12 + 1e-9


def _scanned(table: pa.Table, k: int, grids) -> pa.Table:
    """One block: of each query the vectors whose upper bound reaches its kth best lower bound among the block's cells."""
    side = np.array(table.column("side").to_pylist())
    q, v = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    found = [[], [], [], []]
    if q.num_rows and v.num_rows:
        names, others = q.column("vec_id").to_numpy(), v.column("vec_id").to_numpy()
        spots = v.column("spot").to_numpy()
        grid = grids[table.column("dim")[0].as_py()]
        queries, cells = _matrix(q.column("vector"), "<f8"), _matrix(v.column("vector"), np.uint8)
        for i in range(0, len(names), 256):
            estimate, error = _bounds(queries[i : i + 256], cells, *grid)
            estimate[names[i : i + 256, None] == others[None, :]] = -np.inf
            limit = np.full(len(estimate), -np.inf) if estimate.shape[1] <= k else np.partition(estimate, -k, axis=1)[:, -k] - error
            at, j = np.nonzero((estimate + error[:, None] >= limit[:, None]) & np.isfinite(estimate))
            for column, part in zip(found, (names[i + at], spots[j], (estimate[at, j] - error[at]), (estimate[at, j] + error[at])), strict=True):
                column.append(part)
    kinds = (np.int64, np.int64, np.float64, np.float64)
    columns = [pa.array(np.concatenate([*c, np.empty(0, t)]).astype(t)) for c, t in zip(found, kinds, strict=True)]
    return pa.table(dict(zip(("query_id", "spot", "lower", "upper"), columns, strict=True)))


def exact_products(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    if np.abs(query).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1] < 2**53:
        return (vectors @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in vectors]


def _scored(batches):
    for batch in batches:
        scores = []
        for x, y in zip(batch.column("asked").to_pylist(), batch.column("exact").to_pylist(), strict=True):
            scores += exact_products(np.frombuffer(x, "<f8"), np.frombuffer(y, "<f8")[None, :])
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, embedding) that is_query selects."""
    spark = vectors.sparkSession
    prepare(spark)
    whole = F.transform("embedding", lambda x: x.cast("double"))
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("raw")).where("vec_id is not null and size(raw) > 0 and not exists(raw, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    sound = sound.select("vec_id", F.size("raw").alias("dim"), "raw")
    edges = sound.select("dim", F.posexplode("raw").alias("j", "x")).groupBy("dim", "j").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("dim", "j").collect()  # one row for each dimension
    grids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in sorted({r.dim for r in edges}):
        low = np.floor(256 * np.array([r.low for r in edges if r.dim == dim]))
        high = np.floor(256 * np.array([r.high for r in edges if r.dim == dim]))
        grids[dim] = (low, np.maximum(high - low + 1, 1) / CELLS)
    spot = F.monotonically_increasing_id()  # made as the file is written, and read from it alone
    stored = sound.mapInArrow(lambda it: _file(it, grids), "vec_id long, dim int, exact binary, cells binary")
    # of equal vectors only the k + 1 smallest ids can be among a query's k best, k rows of each at most
    equal, own = Window.partitionBy("dim", "exact").orderBy("vec_id"), Window.partitionBy("dim", "exact", "vec_id").orderBy("dim")
    stored = stored.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= k)
    first = stored.withColumn("place", F.dense_rank().over(equal)).where(is_query | (F.col("place") <= k + 1))
    stored = materialize(first.withColumn("spot", spot), "topk-file")
    found = stored.where(F.col("place") <= k + 1)
    asked = stored.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "exact")).alias("own"))
    asked = asked.select("vec_id", "own.dim", F.col("own.exact").alias("vector"))
    sizes = {r["dim"]: r.n for r in found.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = {r["dim"]: r.n for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def blocks(rows: dict, most: int):
        """Blocks of a dimension's rows, none where it has none."""
        known = F.create_map(*[F.lit(x) for d, n in rows.items() for x in (d, -(-n // most))])
        return F.coalesce(known[F.col("dim")], F.lit(0))

    def every(n):
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))

    def place(key, n):
        return F.pmod(F.xxhash64(key), F.greatest(n, F.lit(1)).cast("long")).cast("int")

    ways, cuts = blocks(asks, BLOCK_QUERIES), blocks(sizes, BLOCK_VECTORS)
    none = F.lit(None).cast("long")
    left = asked.select("dim", F.lit(0).alias("side"), "vec_id", none.alias("spot"), "vector", place("vec_id", ways).alias("i"), every(cuts).alias("j"))
    right = found.select("dim", F.lit(1).alias("side"), "vec_id", "spot", F.col("cells").alias("vector"), every(ways).alias("i"), place("spot", cuts).alias("j"))
    schema = "query_id long, spot long, lower double, upper double"
    near = materialize(left.union(right).groupBy("dim", "i", "j").applyInArrow(lambda t: _scanned(t, k, grids), schema), "topk-near")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    limits = near.withColumn("turn", turn).where(F.col("turn") == k).select("query_id", F.col("lower").alias("limit"))
    near = near.join(limits, "query_id", "left").where(F.col("limit").isNull() | (F.col("upper") >= F.col("limit"))).select("query_id", "spot")
    met = near.join(found.select("spot", "vec_id", "exact"), "spot").join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
    best = met.select("query_id", "vec_id", "asked", "exact").mapInArrow(_scored, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
