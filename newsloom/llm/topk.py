"""Exact top-k search by inner product: branch and bound over vectors stored by dimension."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import ship

EXACT = float(1 << 53)  # sums of whole numbers up to here are exact in a double
LARGEST = (1 << 63) - 1


def vertical(vectors: pd.Series, scale: float) -> np.ndarray:
    """Whole-number components, one row a dimension; shorter vectors end in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return np.floor(out * scale)


def _exact_scores(query: np.ndarray, columns: np.ndarray) -> list[int]:
    """Products of whole numbers too large for doubles, held to the range of a long."""
    q = [int(x) for x in query]
    found = (sum(a * int(b) for a, b in zip(q, column)) for column in columns.T)
    return [max(-LARGEST - 1, min(LARGEST, x)) for x in found]


def block_top(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, step: int):
    """For each query the positions and scores of its ``k`` best candidates of the block, ties to smaller ids.

    ``queries`` and ``columns`` hold a row for each dimension. Products are accumulated ``step`` dimensions at a time.
    What the dimensions to come can add or take away is at most the product of the remaining lengths, so a candidate
    whose upper bound is below the k-th largest lower bound is out, and the survivors are compacted.
    """
    width = max(len(queries), len(columns))
    queries = np.pad(queries, ((0, width - len(queries)), (0, 0)))
    columns = np.pad(columns, ((0, width - len(columns)), (0, 0)))
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(width, 1)
    cuts = list(range(0, width, step)) + [width]
    if most < EXACT:
        mass = [np.sqrt((columns[c:] ** 2).sum(axis=0)) * (1 + 1e-9) for c in cuts[1:]]
        query_mass = [np.sqrt((queries[c:] ** 2).sum(axis=0)) * (1 + 1e-9) for c in cuts[1:]]
        opening = queries[: cuts[min(1, len(cuts) - 1)]].T @ columns[: cuts[min(1, len(cuts) - 1)]]
    for q in range(queries.shape[1]):
        alive = np.flatnonzero(ids != own[q])
        if most >= EXACT:
            score = np.array(_exact_scores(queries[:, q], columns[:, alive]), dtype=object)
        else:
            score = opening[q, alive]
            for b in range(len(cuts) - 1):
                if b:
                    score = score + queries[cuts[b] : cuts[b + 1], q] @ columns[cuts[b] : cuts[b + 1], alive]
                if len(alive) > k:
                    rest = mass[b][alive] * query_mass[b][q]
                    low = score - rest
                    bar = np.partition(low, len(low) - k)[len(low) - k]
                    stays = score + rest >= bar
                    alive, score = alive[stays], score[stays]
        order = sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]]))[:k]
        yield q, alive[order], [int(score[i]) for i in order]


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, scale: float = 256.0, key: str = "vec_id",
    embedding: str = "embedding", query_block: int = 4096, vector_block: int = 8192, step: int = 16,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the largest inner product with each query.

    Components are scaled and rounded down to whole numbers first; scores are exact (beyond the range of a long they
    stay at its end). Rows with the query's own id are not its candidates; ties go to the smaller id; a query with
    fewer than ``k`` candidates gets them all. Rows with a null id or vector, or with a component that is null or not
    finite, take no part; shorter vectors, the empty one included, count as ending in zeros. Rows repeated with the
    same id and vector count once. An empty table gives no rows.

    Queries and vectors are dealt by hash into blocks of a bounded number of rows; every block of vectors meets every
    block of queries in a task of its own, which keeps its ``k`` best for each query; those are ranked at the end.
    """
    ship(vectors.sparkSession)

    def valid(df: DataFrame) -> DataFrame:
        fine = F.forall(
            F.col("embedding"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
        )
        return (
            df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("embedding"))
            .select("id", F.col("embedding").cast("array<double>").alias("embedding"))
            .filter(F.col("id").isNotNull() & F.col("embedding").isNotNull() & fine)
            .distinct()
        )

    asked, all_rows = valid(queries), valid(vectors)
    n_query = max(1, math.ceil(queries.count() / query_block))
    n_vector = max(1, math.ceil(vectors.count() / vector_block))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = all_rows.withColumn("_v", F.pmod(F.xxhash64("id"), F.lit(n_vector)).cast("int")).withColumn("_q", every(n_query))
    right = asked.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int")).withColumn("_v", every(n_vector))

    def best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        ids, own = mine["id"].to_numpy(np.int64), theirs["id"].to_numpy(np.int64)
        found = block_top(
            vertical(theirs["embedding"], scale), own, ids, vertical(mine["embedding"], scale), k, step
        ) if len(ids) and len(own) else ()
        for q, places, scores in found:
            rows += [(own[q], ids[p], s) for p, s in zip(places, scores)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    pairs = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInPandas(
        best, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
