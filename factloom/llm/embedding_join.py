"""Near-duplicates among embeddings: an exact range join by cosine, through pivots in the metric of unit vectors.

Cosine c is distance sqrt(2 - 2c) between unit vectors. Pivots come from a bounded sample, far from each other; a vector
lives in the cell of its nearest pivot. A pair of two cells meets in the one with the smaller number: a vector is copied
there unless the triangle inequality (distances to the two pivots differ by over twice the radius) or the distance to
the plane between the pivots rules a partner out. Cells join independently, hot cells as pairs of blocks of BLOCK rows;
a task returns link counts and one edge for each linked vector, never pairs. The number of pivots is the one, among a
few, whose sampled cost is least: where no bound holds (unclustered vectors of many dimensions) all pairs are compared.

Vectors that are null, zero or hold null or non-finite components link with nothing and are components of their own, and
so do rows without a vec_id, whose component is null;
vectors of different length don't link. Equal vectors travel as one row. Repeated rows of a vec_id count as copies; rows of
one vec_id with different vectors stand each for itself: each has the links and the component of its own vector.
Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut
from factloom.llm.components import components

THRESHOLD, BLOCK, SAMPLE = 0.9, 4096, 2048
PIVOTS = (8, 32, 128)


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, matrix of the smaller cells that a row is copied to)."""
    d = distances(x, pivots)
    home = d.argmin(axis=1)
    near = d[np.arange(len(x)), home][:, None]
    apart = np.maximum(distances(pivots, pivots)[home], 1e-12)
    reach = (d - near <= 2 * radius) & ((d**2 - near**2) / (2 * apart) <= radius)
    return home, reach & (np.arange(len(pivots)) < home[:, None])


def choose_pivots(sample: np.ndarray, n: int, radius: float, numbers: tuple[int, ...]) -> np.ndarray:
    """Farthest-first pivots; their number is that of the fewest comparisons and copies, as far as the sample tells."""
    order, far = [0], distances(sample, sample[:1])[:, 0]
    while len(order) < min(max(numbers), len(sample)):
        order.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[order[-1:]])[:, 0])

    def cost(k: int) -> float:
        k = min(k, len(order))
        home, copied = cells_of(sample, sample[order[:k]], radius)
        own, more = np.bincount(home, minlength=k) / len(sample), copied.sum(axis=0) / len(sample)
        return float((own * (own / 2 + more)).sum() * n + 1e-3 * (1 + more.sum()) * n + k)

    return sample[order[: min((k for k in numbers if k <= max(numbers[0], n // 64)), key=cost)]]


def block_links(x: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, smallest row reachable) of unit rows x, comparing rows left with rows right (once, if they are the same).

    Products in single precision decide but for pairs near the threshold, which double precision decides: a product of n
    terms of unit vectors is off by less than n + 8 units of 2**-24."""
    near = max(2e-5, (x.shape[1] + 8) * 2.0**-24)
    n, small = len(x), x.astype(np.float32)
    links, low = np.zeros(n, np.int64), np.arange(n)
    same, columns = left is right, small[right]
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        s = small[rows] @ columns.T
        hit = s >= threshold + near
        for a, b in zip(*np.nonzero((s >= threshold - near) & ~hit)):
            hit[a, b] = x[rows[a]] @ x[right[b]] >= threshold
        if same:
            hit[np.arange(len(rows)), i + np.arange(len(rows))] = False
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            continue
        links[rows] += hit @ copies[right]
        if not same:
            links[right] += copies[rows] @ hit
        for a in some:
            met = np.append(right[hit[a]], rows[a])
            labels = np.unique(low[met])
            if len(labels) > 1:
                low[np.isin(low, labels)] = labels[0]
    return links, low


def join(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE, numbers: tuple[int, ...] = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding)."""
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("embedding")), F.col("embedding")).alias("embedding"))
    rows = rows.withColumn("key", F.md5(F.to_json(F.struct("embedding"))))
    ids = cut(rows.select("vec_id", F.when(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull(), F.col("key")).alias("key")))
    # number tells classes of one vec_id apart; written once, it stays.
    classes = rows.filter("embedding is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("number", F.monotonically_increasing_id()))
    some = classes.orderBy(F.xxhash64(F.lit("pivots"), "class_id"), "class_id", "key").limit(sample).select("embedding").collect()  # at most sample rows
    total = classes.count()
    pivots: dict[int, np.ndarray] = {}
    for size in {len(r.embedding) for r in some}:
        x = unit(np.array([r.embedding for r in some if len(r.embedding) == size]))
        pivots[size] = choose_pivots(x, max(1, total * len(x) // len(some)), radius, numbers)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most 128 for each length in the sample

    def place(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            sizes = pdf["embedding"].map(len).to_numpy()
            for size in np.unique(sizes):
                part = pdf[sizes == size]
                p = shared.value.get(int(size))
                x = unit(np.stack(part["embedding"].to_numpy()))
                home, copied = (np.zeros(len(x), np.int64), np.zeros((len(x), 1), bool)) if p is None else cells_of(x, p, radius)
                r, c = np.nonzero(copied)
                at = np.concatenate([np.arange(len(x)), r])
                out = part.iloc[at].assign(length=int(size), cell=np.concatenate([home, c]).astype(np.int32), is_home=np.concatenate([np.ones(len(x), bool), np.zeros(len(r), bool)]))
                yield pa.RecordBatch.from_pandas(out[["class_id", "number", "copies", "embedding", "length", "cell", "is_home"]], preserve_index=False)

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = cut(classes.select("class_id", "number", "copies", "embedding").mapInArrow(place, f"class_id long, number long, copies long, embedding {kind}, length long, cell int, is_home boolean"))
    counts = placed.groupBy("length", "cell").agg(F.ceil(F.count_if("is_home") / block).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("is_home")) / block).cast("int").alias("guests"))
    split = placed.join(counts, ["length", "cell"]).filter("homes > 0")
    own = F.when(F.col("is_home"), F.pmod(F.xxhash64("class_id", "number"), "homes")).otherwise(F.pmod(F.xxhash64("class_id", "number"), F.greatest("guests", F.lit(1)))).cast("int")
    of = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(of(F.col("homes")), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y"), F.lit(False).alias("with_guests")))
    beside = F.transform(of(F.col("guests")), lambda o: F.struct(F.col("own").alias("x"), o.alias("y"), F.lit(True).alias("with_guests")))
    visit = F.transform(of(F.col("homes")), lambda o: F.struct(o.alias("x"), F.col("own").alias("y"), F.lit(True).alias("with_guests")))
    tasks = split.withColumn("own", own).withColumn("t", F.explode(F.when(F.col("is_home"), F.concat(among, beside)).otherwise(visit))).select("*", "t.*").drop("t", "homes", "guests")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["class_id", "number"])
        x = unit(np.stack(pdf["embedding"].to_numpy()))
        if pdf["with_guests"].iloc[0]:
            first = pdf["is_home"].to_numpy()
        else:
            first = (pdf["own"] == pdf["x"]).to_numpy()
        left = np.flatnonzero(first)
        right = left if first.all() else np.flatnonzero(~first)
        if pdf["with_guests"].iloc[0] and first.all():
            right = np.zeros(0, np.int64)
        links, low = block_links(x, pdf["copies"].to_numpy(), left, right, threshold)
        ids, numbers, keep = pdf["class_id"].to_numpy(), pdf["number"].to_numpy(), links > 0
        return pd.DataFrame({"class_id": ids[keep], "number": numbers[keep], "links": links[keep], "low": ids[low][keep], "low_number": numbers[low][keep]})

    # As many partitions as asked for: by their bytes, Spark would put pairs of blocks together that take long.
    keys, spark = ["length", "cell", "x", "y", "with_guests"], vectors.sparkSession
    tasks = tasks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
    found = cut(tasks.groupBy(*keys).applyInPandas(run, "class_id long, number long, links long, low long, low_number long"))
    node = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("number"))
    groups = components(found.select(node("class_id", "number").alias("a"), node("low", "low_number").alias("b"))).select(F.col("node.number").alias("number"), F.col("component.id").alias("component"))
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    known = classes.select("key", "class_id", "copies", "number").join(links, "number", "left").join(groups, "number", "left")
    out = ids.join(known, "key", "left")
    component = F.coalesce("component", "class_id", "vec_id")
    return out.select("vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


#: All pairs in DuckDB, components by a recursive closure of the smallest label.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.a = e.vec_id
"""
