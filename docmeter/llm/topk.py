"""Exact top-k search by tiled matrix products.

Vectors become integers floor(scale * x). Queries are dealt into waves of about `wave` rows, one broadcast at a time, whatever their number;
the candidates stay where they are, so they are neither copied nor shuffled. A task reads its shard of the candidates in
tiles, multiplies each with the tiles of the wave, selects the k best of each query in a product (partial selection, ties to the smaller
id), and keeps one running list for each query. The shards' lists are merged in a tree: first within groups of shards, then over the groups.

Products of whole numbers are exact: in double precision while no sum can reach 2^53, else in Python's integers.
Vectors that are null, or hold null or non-finite components, take no part, and vectors meet only those of equal length. A query's own row
is every row with its id. Ties go to the smaller id; repeated rows of one id are candidates each, and a query asks as often as
it has rows, for one list. A score beyond 64 bits is cut at the largest or smallest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LIMIT = 1 << 63


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T in whole numbers; q, c: whole numbers as doubles."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.vectorize(lambda x: max(-LIMIT, min(LIMIT - 1, int(x))), otypes=[np.int64])(whole(q) @ whole(c).T)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row, ties to the smaller column."""
    m = scores.shape[1]
    if m <= k:
        return np.repeat(np.arange(len(scores)), m), np.tile(np.arange(m), len(scores))
    least = np.partition(scores, m - k, axis=1)[:, m - k, None]
    above, tie = scores > least, scores == least
    return np.nonzero(above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def firsts(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best rows of each query, in order."""
    order = np.lexsort((vec, ~score, query))  # ~ turns the order of all 64-bit numbers
    query, score, vec = query[order], score[order], vec[order]
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query)))) < k
    return [query[keep], score[keep], vec[keep]]


def vectors(rows: DataFrame, id_col: str, vec: str, scale: float) -> DataFrame:
    """id, v (whole numbers as doubles) and dim, of the vectors that take part."""
    fine = F.col(vec).isNotNull() & F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # floor() of a double is a long: larger numbers are whole already.
    big = F.transform(F.col(vec), lambda x: F.when(F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(2.0**52), F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).otherwise(x.cast("double") * F.lit(float(scale))))
    return rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), big.alias("v")).withColumn("dim", F.size("v"))


def top_k(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec: str = "embedding", scale: float = 1024.0, k: int = 10, wave: int = 32_768, tile: int = 1024, shard: int = 200_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows."""
    spark = rows.sparkSession
    candidates = vectors(rows, id_col, vec, scale)
    asked = stored(vectors(rows.where(is_query), id_col, vec, scale).dropDuplicates(["id", "v"]))
    n, m = rows.count(), asked.count()
    n_waves = max(1, -(-m // wave))
    # Shards of many rows: a shard gives a list for each query.
    candidates = candidates.coalesce(max(2 * spark.sparkContext.defaultParallelism, n // shard))
    n_shards = candidates.rdd.getNumPartitions()

    def search(queries: DataFrame) -> DataFrame:
        got = queries.select("id", "v", "dim").toArrow()  # at most about a wave
        ids, dims, lists = got.column("id").to_numpy(), got.column("dim").to_numpy(), got.column("v")
        own = {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            flat = pa.chunked_array(lists.take(pa.array(at))).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            own[dim] = (ids[at], flat.reshape(len(at), dim))
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = [np.zeros(0, np.int64)] * 3

            def meet(dim: int, vec: np.ndarray, v: np.ndarray) -> None:
                nonlocal lists
                order = np.argsort(vec, kind="stable")
                vec, v = vec[order], v[order]
                query, q = shared.value[dim]
                found = [lists]
                for at in range(0, len(query), tile):
                    one = query[at : at + tile]
                    scores = product(q[at : at + tile], v)
                    # A query's own rows may be among its best: so many more are selected, then they go.
                    same = np.searchsorted(vec, one, side="right") - np.searchsorted(vec, one)
                    i, j = best(scores, k + int(same.max()))
                    other = one[i] != vec[j]
                    i, j = i[other], j[other]
                    found.append([one[i], scores[i, j], vec[j]])
                lists = firsts(*map(np.concatenate, zip(*found, strict=True)), k)

            for batch in batches:
                vec, dims, values = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1)
                for dim in np.unique(dims).tolist():
                    if dim not in shared.value:
                        continue
                    at = np.flatnonzero(dims == dim)
                    flat = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                    for lo in range(0, len(at), 4 * tile):
                        meet(dim, vec[at[lo : lo + 4 * tile]], flat[lo : lo + 4 * tile])
            number = TaskContext.get().partitionId()
            for at in range(0, len(lists[0]), 100_000):
                part = [pa.array(x[at : at + 100_000]) for x in lists]
                yield pa.RecordBatch.from_arrays([part[0], part[2], part[1], pa.array(np.full(len(part[0]), number, np.int32))], ["query_id", "vec_id", "score", "shard"])

        found = candidates.mapInArrow(run, "query_id long, vec_id long, score long, shard int")
        order = [F.col("score").desc(), F.col("vec_id")]
        for level in (["query_id", F.floor(F.col("shard") / max(2, int(n_shards**0.5)))], ["query_id"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*level).orderBy(*order))).where(F.col("rank") <= k)
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    if n_waves == 1:
        return search(asked)
    asked = asked.withColumn("wave", F.pmod(F.xxhash64("id"), F.lit(n_waves)))
    out = None
    for w in range(n_waves):
        one = stored(search(asked.where(F.col("wave") == w)))
        out = one if out is None else out.unionByName(one)
    return out
