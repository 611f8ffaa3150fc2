"""Exact top-k search by inner product over quantised vectors, pruned by segment statistics from coarse to fine.

A vector is cut into segments; the mean and the deviation of each bound the distance of two vectors from below (the
means' part is exact, the rest follows from Cauchy and Schwarz), which with the vectors' norms bounds the inner product
from above. Levels of 1, 4 and 16 segments are tried in turn: rows whose bound is under the k-th best exact score seen
so far are dropped, and what survives the last level is computed exactly, in integers.

Queries and rows are dealt into blocks, every block of queries against every block of rows, so a task's size is fixed
and each returns k rows for a query; the best of those are chosen by Spark. A row is sent once for each QUERY_BLOCK queries.
Null vectors, and those that hold null or non-finite components, take no part; vectors of another length than the query's are no candidates. Ties go to the
smaller vec_id; a row repeated under the query's own vec_id is not a candidate; of several query rows of one vec_id one
is asked, the least by its components. Pairs of vectors too long for exact sums in doubles are scored in 64-bit or, beyond
these, Python integers; such a score is null where it exceeds a long, and ranked by its value. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.vector_codes import finite, whole

#: Queries of a block are searched SLICE at a time.
LEVELS, ROW_BLOCK, QUERY_BLOCK, SLICE = (1, 4, 16), 4096, 4096, 512
#: Vectors of at most this length have products below 2**53.
SHORT = 2.0**26


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment: root of its length times its mean, and root of its summed squared deviations. The inner
    product of two feature rows bounds that of the vectors from above."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of each query's k best rows; x_ids ascend. Sums stay below 2**53, so doubles are exact."""
    coarse = [segment_features(q, s) for s in levels], [segment_features(x, s) for s in levels]
    bound0 = coarse[0][0] @ coarse[1][0].T
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero(x_ids != q_ids[i])
        exact = np.full(len(x), -np.inf)
        for level in range(len(levels)):
            bound = bound0[i, alive] if level == 0 else coarse[1][level][alive] @ coarse[0][level][i]
            bound += 1e-9 * (1 + np.abs(bound)) + 1e-6
            if len(alive) > k:
                best = alive[np.argpartition(-bound, k - 1)[:k]]
                todo = best[exact[best] == -np.inf]
                exact[todo] = x[todo] @ q[i]
                line = np.partition(exact[exact > -np.inf], -k)[-k]
                alive = alive[bound >= line]
        todo = alive[exact[alive] == -np.inf]
        exact[todo] = x[todo] @ q[i]
        top = alive[np.lexsort((x_ids[alive], -exact[alive]))[:k]]
        out += [(int(q_ids[i]), int(x_ids[j]), int(exact[j])) for j in top]
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole rows: in 64 bits where those suffice, else in Python integers."""
    most = lambda m: max(1, int(np.abs(m).max(initial=0)) if m.dtype != object else max(abs(v) for v in m.ravel()))
    if q.dtype != object and x.dtype != object and q.shape[1] * most(q) * most(x) < 1 << 62:
        return q @ x.T
    return q.astype(object) @ x.astype(object).T


def search_rows(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, scale: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of each query's k best rows, of any finite components; x_ids ascend."""
    long_q, long_x = (np.abs(m).max(axis=1, initial=0) * scale * np.sqrt(m.shape[1]) >= SHORT for m in (q, x))
    found = []
    short = whole(x[~long_x], scale).astype(np.float64), x_ids[~long_x]
    for rows in np.array_split(np.flatnonzero(~long_q), max(1, -(-len(q) // SLICE))):
        if len(rows) and len(short[1]):
            found += search_block(whole(q[rows], scale).astype(np.float64), q_ids[rows], *short, k)
    for own, other in ((np.flatnonzero(~long_q), np.flatnonzero(long_x)), (np.flatnonzero(long_q), np.arange(len(x)))):
        for i in range(0, len(own), 64) if len(other) else []:
            scores = exact_scores(whole(q[own[i : i + 64]], scale), whole(x[other], scale))
            for n, row in zip(own[i : i + 64], scores.tolist()):
                ranked = sorted((-s, v) for s, v in zip(row, x_ids[other].tolist()) if v != q_ids[n])
                found += [(int(q_ids[n]), v, -s) for s, v in ranked[:k]]
    return found


MOST = (1 << 63) - 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors, queries: vec_id, embedding. Returns query_id, rank (from 1), vec_id, score."""

    def usable(df: DataFrame) -> DataFrame:
        kind = df.schema["embedding"].dataType.simpleString()
        x = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
        return df.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.size("embedding").alias("length"))

    rows, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min(F.struct("x", "length")).alias("least")).select("vec_id", "least.x", "least.length")
    n_rows, n_asked = rows.count(), asked.count()
    r, q = max(1, -(-n_rows // row_block)), max(1, -(-n_asked // query_block))
    deal = lambda df, own, n_own, other, n_other, is_query: df.select("*", F.lit(is_query).alias("is_query"), F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
    both = deal(rows, "rb", r, "qb", q, False).unionByName(deal(asked, "qb", q, "rb", r, True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flag, names = pdf["is_query"].to_numpy(), ["query_id", "vec_id", "score", "beyond", "big"]
        if flag.all() or not flag.any():
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        a, b = pdf[flag], pdf[~flag].sort_values("vec_id")
        found = search_rows(*(m for part in (a, b) for m in (np.stack(part["x"].to_numpy()).astype(np.float64), part["vec_id"].to_numpy())), k, scale)
        # Scores beyond a long are ranked by their sign and their digits, padded to the longest that finite vectors can have.
        out = [(n, v, s, 0, None) if abs(s) <= MOST else (n, v, None, 1 if s > 0 else -1, f"{s + (1 << 2400):0602x}") for n, v, s in found]
        return pd.DataFrame(out, columns=names, dtype=object).astype({"query_id": "int64", "vec_id": "int64", "score": "Int64", "beyond": "int32"})

    # As many partitions as asked for: by their bytes, Spark would put pairs of blocks together that take long.
    spark = vectors.sparkSession
    both = both.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), "length", "rb", "qb")
    found = both.groupBy("length", "rb", "qb").applyInPandas(run, "query_id long, vec_id long, score long, beyond int, big string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("beyond").desc(), F.col("big").desc(), F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
