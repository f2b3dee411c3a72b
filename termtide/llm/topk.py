"""Exact top-k inner products by block-at-a-time pruning.

Vectors are scaled to integers. A dimension stands for two terms, its positive and its negative
part. Vectors are laid out in blocks of a document range; a block keeps the largest value of every
term beside its forward index, the vectors themselves. Per query, blocks are ordered by the bound
that the sum of query weight times block maximum gives, and scored until no bound
reaches the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
BLOCK = 64
# Queries that are searched together; also what a task holds of them.
QUERIES = 1024
# Vectors of one document range, which one task searches for one group of queries.
RANGE = 8192
# Sums up to here are exact in double precision.
EXACT = 2 ** 53
LONG = 2 ** 63 - 1

_HITS = "query_id long, query_key long, copies long, own long, vec_id long, score long"


def _floor(x):
    """The whole number below x, as a double; from 2**52 on doubles are whole."""
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)


def scaled(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double> of whole numbers): floor(1024 x) of every component.

    Rows with a null id or vector, or with a null, NaN or infinite component, are left out.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) != float("inf")))
    return df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(embedding, lambda x: _floor(x.cast("double") * SCALE)).alias(
            "vector"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths),
        np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def search(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int
           ) -> Iterator[list[tuple[int, int]]]:
    """Per query its k best (score, vec_id) among ``vectors``; ties to the smaller id. Exact for
    whole numbers of any size."""
    n = len(ids)
    largest = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1]
    if largest >= EXACT:
        yield from _search_large(ids, vectors, queries, k)
        return
    starts = np.arange(0, n, BLOCK)
    highest = np.maximum.reduceat(vectors, starts).clip(min=0)  # term maxima, positive parts
    lowest = np.maximum.reduceat(-vectors, starts).clip(min=0)  # and negative parts
    bounds = queries.clip(min=0) @ highest.T + (-queries).clip(min=0) @ lowest.T
    for q, query in enumerate(queries):
        scores, found = np.empty(0), np.empty(0, np.int64)
        threshold = -np.inf
        for b in np.argsort(-bounds[q], kind="stable"):
            if bounds[q, b] < threshold:
                break  # so are all bounds after it
            lo = starts[b]
            block = vectors[lo:lo + BLOCK] @ query
            near = block >= threshold
            if not near.any():
                continue
            scores = np.concatenate([scores, block[near]])
            found = np.concatenate([found, ids[lo:lo + BLOCK][near]])
            if len(scores) > k:
                best = np.lexsort((found, -scores))[:k]
                scores, found = scores[best], found[best]
                threshold = scores[-1]
            elif len(scores) == k:
                threshold = scores.min()
        yield list(zip(scores.astype(np.int64).tolist(), found.tolist(), strict=True))


def _held(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def _search_large(ids, vectors, queries, k):
    """The same in whole numbers of Python, for components of more than some 20 million."""
    rows = [[int(x) for x in v] for v in vectors.tolist()]
    for query in queries.tolist():
        weights = [int(x) for x in query]
        every = [(_held(sum(map(int.__mul__, weights, row))), i)
                 for row, i in zip(rows, ids.tolist(), strict=True)]
        every.sort(key=lambda s: (-s[0], s[1]))
        yield every[:k]


def _own_scores(queries: np.ndarray) -> list[int]:
    """The inner product of every query with itself, exact as those of ``search``."""
    return [int(s) if s < EXACT else _held(sum(int(x) ** 2 for x in q))
            for s, q in zip(np.einsum("ij,ij->i", queries, queries).tolist(), queries.tolist(),
                            strict=True)]


def _search_range(k: int):
    """The k + 1 best of a range for every query, which itself may be one of them."""
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        hits: list[tuple[int, ...]] = []
        if len(candidates) and len(queries):
            sides = [side.sort_by("vec_id").combine_chunks() for side in (candidates, queries)]
            arrays = [side.column("vector").combine_chunks() for side in sides]
            width = max(int(np.diff(a.offsets.to_numpy()).max(initial=0)) for a in arrays)
            # Of a repeated row no more copies than places can be hits.
            times = np.minimum(sides[0].column("copies").to_numpy(), k + 1)
            ids = np.repeat(sides[0].column("vec_id").to_numpy(), times)
            vectors = np.repeat(_matrix(arrays[0], width), times, axis=0)
            asked = _matrix(arrays[1], width)
            names = zip(*(sides[1].column(c).to_pylist() for c in ("vec_id", "key", "copies")),
                        _own_scores(asked), strict=True)
            hits = [(*name, i, s) for name, best in zip(
                names, search(ids, vectors, asked, k + 1), strict=True) for s, i in best]
        columns = list(zip(*hits, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[
            "query_id", "query_key", "copies", "own", "vec_id", "score"])
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for every query its ``k`` highest inner products, exact.

    Both sides are vec_id and vector as ``scaled`` makes them; the queries are rows of the candidates.
    A query's own row is no candidate of its own, other rows with its id are. Repeated candidate
    rows each count, and repeated query rows each get ``k`` hits, also if only the id repeats
    (rows of one id are told apart by a 64-bit hash of the vector). Fewer candidates give fewer
    rows, an empty side none. Ties go to the smaller id. A vector of fewer components counts as filled
    with zeros. Scores beyond the range of a long are held at its ends.

    Equal rows are counted first, so that one repeated often is a row. The rows of both sides are
    dealt to groups of bounded size, and every group of queries meets every range of candidates in a
    task of its own: queries are sent once per range and candidates once per query group. Only
    k + 1 hits per query and range are shuffled afterwards; one that equals the query's own row
    is left out of them.
    """
    n, m = candidates.count(), queries.count()
    ranges, groups = max(1, -(-n // RANGE)), max(1, -(-m // QUERIES))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        counted = df.groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
        return counted.withColumn("key", F.xxhash64("vec_id", "vector")).select(
            "*", F.pmod("key", F.lit(own_n)).alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other)).select(
            F.col("range").cast("int"), F.col("group").cast("int"), "vec_id", "vector", "key",
            "copies")

    left = dealt(candidates, "range", ranges, "group", groups).groupBy("range", "group")
    right = dealt(queries, "group", groups, "range", ranges).groupBy("range", "group")
    hits = left.cogroup(right).applyInArrow(_search_range(k), _HITS)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    past = F.sum(itself.cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))
    others = ranked.select("*", itself.alias("itself"), past.alias("past")).where(
        ~F.col("itself") | (F.col("past") > 1)).withColumn(
        "rank", F.col("place") - F.least("past", F.lit(1))).where(F.col("rank") <= k)
    return others.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
