"""Exact top-k inner products by the threshold algorithm.

Candidates and queries are cut into blocks of bounded size and every block of queries meets
every block of candidates in a task. Such a task sorts its candidates once per dimension and
walks all lists from the good end for each query, scoring what it meets, until the bound on
anything not yet met is below the kth score. The best of each block are then ranked per query.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do null ids as queries; a null id is a candidate and comes last among ties; a shorter vector
counts as filled with zeros; equal rows are separate candidates; an empty table gives no rows.
Scaled components are integers whose inner products must fit in 63 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.session import materialize

BLOCK = 4096  # candidates of a block, about
QUERIES = 512  # queries of a block, about
FIRST_DEPTH = 4


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def threshold_search(matrix: np.ndarray, lists: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the best k rows but ``own``. ``lists``: rows by rising value, per dimension."""
    n = len(matrix)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(n, bool)
    if own >= 0:
        seen[own] = True
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, depth = 0, FIRST_DEPTH
    while at < n:
        to = min(n, at + depth)
        if len(up) + len(down):
            met = np.concatenate([lists[up, n - to : n - at].ravel(), lists[down, at:to].ravel()])
        else:
            met, to = np.arange(n), n  # a query of zeros: all score 0
        new = np.zeros(n, bool)
        new[met] = True
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, matrix[new] @ query])
        best = np.lexsort((ids[rows], -scores))[:k]
        rows, scores = rows[best], scores[best]
        bound = query[up] @ matrix[lists[up, n - to], up] + query[down] @ matrix[lists[down, to - 1], down]
        if len(rows) == k and bound < scores[-1]:  # an equal score may still win by its id
            break
        at, depth = to, depth * 2
    return rows, scores


def top_k(df: DataFrame, k: int, query_every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` other rows for each row whose id divides by ``query_every``."""
    wide = F.col(vector).cast("array<double>")
    fine = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.filter(F.col(vector).isNotNull() & fine).select(
        F.col(key).cast("bigint").alias("id"), F.transform(wide, lambda x: F.floor(x * scale).cast("bigint")).alias("v")
    )
    rows = materialize(rows, "scaled-vectors").withColumn("row", F.monotonically_increasing_id())
    asked = F.col("id") % query_every == 0
    total = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).first()
    blocks, query_blocks = -(-max(total.n, 1) // BLOCK), -(-max(total.q, 1) // QUERIES)
    place = lambda many: F.pmod(F.xxhash64("row"), F.lit(many))
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<bigint>"))
    candidates = rows.withColumn("c", place(blocks)).withColumn("q", every(query_blocks))
    queries = rows.filter(asked).withColumn("q", place(query_blocks)).withColumn("c", every(blocks))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            width = max(left.v.map(len).max(), right.v.map(len).max())
            matrix, wanted = _matrix(left.v, width), _matrix(right.v, width)
            lists = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T)
            absent = left.id.isna().to_numpy()
            # place in the order of ids, absent ones last
            order = np.empty(len(left), np.int64)
            order[np.lexsort((left.row.to_numpy(), left.id.fillna(0).astype(np.int64), absent))] = np.arange(len(left))
            where = {row: i for i, row in enumerate(left.row)}
            for i in range(len(right)):
                got, scores = threshold_search(matrix, lists, order, wanted[i], where.get(right.row.iloc[i], -1), k)
                found.append(pd.DataFrame({"query_row": right.row.iloc[i], "query_id": right.id.iloc[i], "vec_id": left.id.to_numpy()[got], "row": left.row.to_numpy()[got], "score": scores}))
        out = pd.concat(found) if found else pd.DataFrame({c: [] for c in ("query_row", "query_id", "vec_id", "row", "score")})
        return out.astype({"query_row": "int64", "query_id": "int64", "vec_id": "Int64", "row": "int64", "score": "int64"})

    found = candidates.groupBy("c", "q").cogroup(queries.groupBy("c", "q")).applyInPandas(
        best, "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
