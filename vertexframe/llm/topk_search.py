"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised to integers, floor(scale * x).  Each block of vectors holds one list per dimension,
sorted by component.  For a query, the lists of its positive components are read from the top, those of
its negative ones from the bottom; whatever is met is scored in full.  No vector unseen at depth t can
score more than the sum of query component times list entry at depth t, so reading stops as soon as the
k-th best score is above this bound (above, not at: an unseen tie could have a smaller id).  The bound for
all depths and queries is two matrix products, and the best found so far is carried from block to block of
a partition, so that most later blocks stop early.

The stated queries are answered block by block: a block of about QUERY_BLOCK queries (a bounded
broadcast) goes to all vectors, the partitions' best k are merged by query, and the block's answers are
written to the shared folder before the next block is read, so neither the driver nor a plan ever holds
more than one block.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null id,
take no part; shorter vectors count as ending in zeros; rows that share the query's id are its own and no
candidates; repeated query ids are answered once, repeated candidate rows are kept; with fewer than k
candidates all are returned; ties go to the smaller id; an empty table gives an empty result.  Scores are
exact: components whose products could leave 53 bits are computed with Python's integers, and a score
beyond a long is returned as the nearest long.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

#: Queries sent at once, vectors of a block, first depth of reading and its growth.
QUERY_BLOCK, BLOCK, DEPTH, GROWTH = 1024, 4096, 16, 4
_LONG = (1 << 63) - 1


def quantise(vectors: list, scale: int, width: int) -> np.ndarray:
    """Rows of floor(scale * x): float64 if exact for inner products, else Python integers."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    out = np.floor(scale * out)
    if len(out) and float(np.abs(out).max(initial=0)) ** 2 * max(1, width) >= 2.0**53:
        return np.array([[int(x) for x in row] for row in out], object)
    return out


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, best: list) -> None:
    """Improves best[q], a list of at most k (-score, id) in order, by the rows of one block."""
    n, d = vectors.shape
    exact = vectors.dtype == object or queries.dtype == object
    if exact:
        vectors, queries = vectors.astype(object), queries.astype(object)
    order = np.argsort(vectors, axis=0, kind="stable")
    rising = np.take_along_axis(vectors, order, 0)
    depths = [min(DEPTH, n)]
    while depths[-1] < n:
        depths.append(min(n, depths[-1] * GROWTH))
    up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    # bound[q, j]: no vector outside the first depths[j] of all lists scores more.
    last = np.array(depths) - 1
    bound = up @ rising[n - 1 - last].T + down @ rising[last].T
    highest = up @ rising[n - 1] + down @ rising[0]
    for q in range(len(queries)):
        found = best[q]
        if len(found) == k and -found[-1][0] > highest[q]:
            continue
        query = queries[q]
        from_top, from_bottom = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        for j, depth in enumerate(depths):
            now = np.zeros(n, bool)
            if depth == n:
                now[:] = True
            else:
                now[order[n - depth :, from_top]] = True
                now[order[:depth, from_bottom]] = True
            new = np.flatnonzero(now & ~seen & (ids != query_ids[q]))
            seen |= now
            if len(new):
                scores = vectors[new] @ query
                if len(found) == k:
                    held = scores >= -found[-1][0]
                    new, scores = new[held], scores[held]
                if len(new) > 4 * k and not exact:
                    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                    new, scores = new[scores >= edge], scores[scores >= edge]
                found = sorted(found + [(-int(s), int(i)) for s, i in zip(scores, ids[new])])[:k]
            if len(found) == k and -found[-1][0] > bound[q, j]:
                break
        best[q] = found


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(df: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k highest scores among all other rows."""
    rows = df.where(col(id_col).isNotNull() & usable(col(vector_col))).select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    asked = cut(rows.where("q").groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // query_block))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    answers = []
    for b in range(blocks):
        local = sorted((r.id, list(r.v)) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toLocalIterator())
        found = rows.select("id", "v").mapInArrow(_searcher([i for i, _ in local], [v for _, v in local], k, scale), "query_id long, id long, score long")
        answers.append(cut(found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)))
    return reduce(DataFrame.unionByName, answers).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _searcher(query_ids: list[int], query_vectors: list[list[float]], k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in query_ids]
        ids, vectors = [], []
        asked = np.array(query_ids, np.int64)

        def search() -> None:
            width = max([len(v) for v in vectors] + [len(v) for v in query_vectors] + [1])
            search_block(quantise(vectors, scale, width), np.array(ids, np.int64), quantise(query_vectors, scale, width), asked, k, best)

        for batch in batches:
            for key, vector in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                ids.append(key)
                vectors.append(vector)
                if len(ids) == BLOCK:
                    search()
                    ids, vectors = [], []
        if ids:
            search()
        out = [(q, i, max(-_LONG - 1, min(_LONG, -s))) for q, found in zip(query_ids, best) for s, i in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "id", "score"])

    return run
