"""Joins and searches of vectors: few rows, repeated ids, large components."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import embedding_join, topk_search

VECTORS = "vec_id long, embedding array<double>"


def brute_links(rows):
    """Counter of (vec_id, links, component): one for each row, by the vector of the row."""
    unit = [np.array(v) / np.abs(v).max() for _, v in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    linked = [{j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in range(len(rows))]
    out = Counter()
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        out[(rows[i][0], len(linked[i]), min(rows[j][0] for j in seen))] += 1
    return out


@pytest.mark.parametrize("n", range(1, 10))
def test_join_of_few_vectors(spark, n):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=6)
    rows = [(i, (centre + 0.2 * rng.normal(size=6)).tolist() if i % 2 else rng.normal(size=6).tolist()) for i in range(n)]
    got = embedding_join.join(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_join_of_repeated_ids_with_other_vectors(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 8))
    rows = [(1, a.tolist()), (1, b.tolist()), (2, (a + 0.01).tolist()), (3, (b + 0.01).tolist()), (0, (b - 0.01).tolist()), (1, a.tolist()), (4, c.tolist()), (4, (c * 2).tolist())]
    got = embedding_join.join(spark.createDataFrame(rows, VECTORS).withColumns({x: F.lit(1) for x in ("number", "id", "node", "class_id")})).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)


def brute_search(rows, k=5, scale=256):
    whole = lambda v: [math.floor(c * scale) if abs(c) < 1e290 else int(c) * scale for c in v]
    x = [(i, whole(v)) for i, v in rows]
    asked = {}
    for i, v in rows:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = Counter()
    for i, v in asked.items():
        q = whole(v)
        found = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in x if j != i and len(w) == len(q))
        for rank, (s, j) in enumerate(found[:k], 1):
            out[(i, rank, j, -s if abs(s) < 1 << 63 else None)] += 1
    return out


@pytest.mark.parametrize("blocks", [(4096, 4096), (20, 2)])
@pytest.mark.parametrize("large", [1e5, 1e7, 1e12, 1e300])
def test_search_among_large_components(spark, blocks, large):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(130, 8)), 2).tolist()
    x[7], x[50], x[60][3], x[61][3], x[62] = [large] * 8, [large / 3] * 8, large, -large, [-large] * 8
    rows = [(i, v) for i, v in enumerate(x)] + [(100, x[9]), (100, [0.1] * 8), (33, x[2]), (33, x[3]), (200, [1.0] * 3), (201, [2.0] * 3)]
    bad = [(250, None), (300, [float("nan")] * 8), (350, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({c: F.lit(1) for c in ("x", "length", "rank", "score", "rb", "qb", "query_id", "big")})
    got = topk_search.search(df, df.filter("vec_id % 50 = 0"), row_block=blocks[0], query_block=blocks[1]).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows)


def test_one_large_vector_among_sixty(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.round(rng.normal(size=64), 2).tolist()) for i in range(60)] + [(60, [1e5] * 64)]
    df = spark.createDataFrame(rows, VECTORS)
    got = topk_search.search(df, df.filter("vec_id % 50 = 0")).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows)
