"""Exact top-k search by inner product, with columnar branch and bound.

Vectors are dealt into candidate blocks and queries into query blocks, both of bounded size, by a hash of the
row; every query block meets every candidate block in a task of its own. Inside a task the candidates are
stored dimension block by dimension block. A query adds up one dimension block after the other over the
candidates still alive. What the dimensions to come can add is at most the product of the remaining masses
(the norms of the remaining parts); candidates whose sum and bound fall below the k-th best score known are
compacted away. The k best of each task go to one merge per query, which keeps k rows of each task at most.

The queries are a stated part of the table and all rows are candidates, so the work is queries times rows;
no other pair is made, and neither queries nor candidates reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8192, 4096
DIMENSIONS = 16
SEEDS = 256
LEAST_CANDIDATES = 256


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds finite numbers only."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, id, score) of each query's ``k`` best among ``vectors``, ties to the smaller id.

    A vector with the query's own id is no candidate. Sums are exact: doubles where they stay below 2^53,
    Python integers otherwise.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    width = vectors.shape[1]
    top = max(1, int(np.abs(vectors.astype(float)).max(initial=0))) * max(1, int(np.abs(queries.astype(float)).max(initial=0)))
    kind = np.float64 if top * max(1, width) < 1 << 52 else object
    columns, q = np.ascontiguousarray(vectors.T).astype(kind), queries.astype(kind)
    # Dimensions with the largest spread first, so that the remaining mass shrinks fast.
    mass = (vectors.astype(float) ** 2).sum(axis=0)
    dims = np.argsort(-mass, kind="stable")
    columns, q = columns[dims], q[:, dims]
    cuts = [*range(0, width, DIMENSIONS), width]
    rest_c = np.zeros((len(cuts), len(ids)))
    rest_q = np.zeros((len(cuts), len(q)))
    for b in range(len(cuts) - 2, -1, -1):
        block = slice(cuts[b], cuts[b + 1])
        rest_c[b] = rest_c[b + 1] + (columns[block].astype(float) ** 2).sum(axis=0)
        rest_q[b] = rest_q[b + 1] + (q[:, block].astype(float) ** 2).sum(axis=1)
    rest_c, rest_q = np.sqrt(rest_c), np.sqrt(rest_q)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), 256):
        part = q[start : start + 256]
        # The k-th best of the first candidates is a lower bound of the k-th best of all.
        seeds = min(SEEDS, len(ids))
        known = part @ columns[:, :seeds]
        own = query_ids[start : start + 256, None] == ids[None, :seeds]
        head = cuts[1] if width else 0
        first = part[:, :head] @ columns[:head] if width else np.zeros((len(part), len(ids)), kind)
        for i in range(len(part)):
            seen = known[i][~own[i]]
            least = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else None
            alive = np.flatnonzero(ids != query_ids[start + i])
            total = first[i][alive]
            for b in range(1, len(cuts)):
                if least is not None:
                    bound = total + rest_c[b][alive] * rest_q[b][start + i] * (1 + 1e-9) + 0.5
                    live = bound >= least
                    if not live.all():
                        alive, total = alive[live], total[live]
                if b < len(cuts) - 1:
                    block = slice(cuts[b], cuts[b + 1])
                    total = total + part[i, block] @ columns[block][:, alive]
            best = np.lexsort((ids[alive], -total))[:k]
            out.append((np.full(len(best), query_ids[start + i]), ids[alive[best]], total[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    query, found, score = (np.concatenate(x) for x in zip(*out))
    return query, found, score.astype(np.int64)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 20,
    scale: float = 64.0,
) -> DataFrame:
    """(``query_id``, ``rank`` from 1, ``vec_id``, ``score``) of each query's ``k`` best vectors.

    Components are ``floor(scale * x)``; a score is the integer inner product of two vectors of the same
    length. ``is_query`` marks the queries; every other row is a candidate for them, a row with the query's
    own id is not. Ties go to the smaller id; a query with fewer candidates gets all of them.

    Rows whose id or vector is null, or whose vector holds a null or a number that is not finite, take no
    part. Repeated rows count once. Of several vectors under one id each is a candidate, and the one that is
    first in array order is the query. If the largest component could give a score beyond 64 bits, an error says so
    before the search. Vectors without components score 0 with each other. An empty table
    gives an empty table.
    """
    spark = vectors.sparkSession
    numbers = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    rows = (
        vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("id"), numbers.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .groupBy("id", "v")
        .agg(F.max("q").alias("q"))
    )
    reach = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    total, asked, most = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v") * reach * reach)).first()
    if (most or 0.0) >= 2.0**63:
        raise ValueError("components are so large that inner products do not fit 64 bits; use a smaller scale")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounded blocks; smaller ones where that gives every task of the session one.
    blocks = max(1, -(-total // CANDIDATES), min(slots, -(-total // LEAST_CANDIDATES)))
    groups = max(1, -(-asked // QUERIES))
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    key = F.xxhash64("id", "v")
    left = rows.select(
        "id", "v", F.lit(False).alias("q"),
        F.pmod(key, F.lit(blocks).cast("bigint")).alias("block"),
        F.explode(_numbers(groups)).alias("part"),
    )
    right = queries.select(
        "id", "v", F.lit(True).alias("q"),
        F.explode(_numbers(blocks)).alias("block"),
        F.pmod(key, F.lit(groups).cast("bigint")).alias("part"),
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        length = rows["v"].map(len).to_numpy()
        ids, asked = rows["id"].to_numpy(), rows["q"].to_numpy()
        for size in np.unique(length[asked]):
            same = length == size
            pick = lambda m: np.array(rows["v"][m].tolist(), np.int64).reshape(int(m.sum()), size)
            found.append(search_block(ids[same & asked], pick(same & asked), ids[same & ~asked], pick(same & ~asked), k))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        query, vec, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})

    best = (
        left.unionByName(right)
        .groupBy("block", "part")
        .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
