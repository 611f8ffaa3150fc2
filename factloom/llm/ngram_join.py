"""Near-duplicate join of texts by the Jaccard similarity of their word n-grams, through an LSH forest.

Every text has TREES signatures of DEPTH MinHashes, 16 bits of each, as strings whose prefixes are the nodes of sorted
tries. Matching begins with the whole signatures and shortens their prefixes by one hash a round, until the links found
so far tell that enough of all are found: of pairs of similarity s a round at depth d finds p = 1 - (1 - s**d)**TREES, so
each one found stands for (1 - p) / p that were missed. One more pair at the threshold counts as found, so without links
to learn from the prefix shortens until the formula gives RECALL at the threshold itself.

A node links its texts to the smallest one (never all pairs), and the connected sets of that are cells. Within a cell
every pair is verified exactly by counting common n-grams, but for pairs that one cell of a round before held already.
Cells above BLOCK texts are split into pairs of blocks, so no task holds more than two blocks. Exact means: by the 64-bit
hashes of n-grams; two n-grams of one hash count as one (at a million of them, with probability 3e-8). Ids of documents
are unique: rows of one doc_id with different texts are one node of the links, named by it.

Words are runs of other than ASCII blanks, lower-cased; a text of fewer than n words has one n-gram of all its words.
Texts of equal n-gram sets are one class (similarity 1) and travel as one row. Null texts and texts without words link
with nothing; very long texts are blocks of their own. Repeated rows of a doc_id count as copies; a null doc_id has no class. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, cut, slices
from factloom.llm.components import components

N, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.999
#: Texts of a block; a task of the verification holds two blocks at most.
BLOCK = 1024
#: Member tables of at most this many rows are broadcast (16 bytes each).
FEW = 1_000_000
BASE = 0x9DDFEA08EB382D69
INVERSE = pow(BASE, -1, 1 << 64)


def missed(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """How many pairs of this similarity are missed at a depth for each one that is found."""
    q = (1 - similarity**depth) ** trees
    return q / np.maximum(1 - q, 1e-12)


def _powers(n: int, base: int) -> np.ndarray:
    """base to the powers 0 to n - 1 modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n]


_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text); sums of powers over the bytes, no word objects."""
    data = [t.lower().encode() for t in texts]
    joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    if not _POWERS or len(_POWERS[0]) < len(joined):
        tables = [_powers(max(1 << 21, len(joined)), base) for base in (BASE, INVERSE)]
        if len(joined) <= 1 << 22:  # those for a very long text aren't kept
            _POWERS[:] = tables
    else:
        tables = _POWERS
    up, down = tables
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    word = ~blank
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)])])
    hashes = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.cumsum([0] + [len(d) + 1 for d in data])
    return hashes, np.diff(np.searchsorted(start, first))


def shingles(texts: list[str], n: int = N) -> list[np.ndarray]:
    """The set of n-grams of each text, as sorted 64-bit hashes."""
    out = []
    for i, j in blocks(texts, 1 << 20):
        hashes, counts = word_hashes(texts[i:j])
        at = 0
        grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            grams = _mix(grams * np.uint64(BASE) + hashes[k : k + len(grams)])
        for c in counts.tolist():
            if c >= n:
                out.append(np.unique(grams[at : at + c - n + 1]))
            elif c:
                h = np.uint64(c)
                for w in hashes[at : at + c]:
                    h = _mix(np.array([h]) * np.uint64(BASE) + w)[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
    return out


def forest(sets: list[np.ndarray], depth: int, trees: int = TREES) -> np.ndarray:
    """For each non-empty set a row of trees * depth MinHashes of 16 bits, big-endian, tree by tree."""
    rng = np.random.Generator(np.random.PCG64(20_240_229))
    multiply = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
    joined = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), trees * depth), ">u2")
    for k in range(trees * depth):
        out[:, k] = _mix(np.minimum.reduceat(joined * multiply[k] + add[k], first) >> np.uint64(16)) & np.uint64(0xFFFF)
    return out


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int, depth: int, trees: int) -> DataFrame:
    """doc_id, set_key, forest (binary): one row for each row of docs; key and forest are null without n-grams."""

    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for i, j in blocks(texts, 1 << 20):
                sets = shingles(texts[i:j], n)
                rows = [k for k, s in enumerate(sets) if len(s)]
                keys, signed = [None] * len(sets), [None] * len(sets)
                if rows:
                    for k, row in zip(rows, forest([sets[k] for k in rows], depth, trees)):
                        keys[k], signed[k] = set_key(sets[k]), row.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "set_key", "forest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, set_key binary, forest binary")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections of the given sets: few rows, of a cell or two blocks.

    N-grams of one set only are dropped; rare ones add to pairs one by one, frequent ones by a matrix product."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[column] > 1
    row, column = row[keep], column[keep]
    out = np.zeros((n, n), np.int64)
    rare = df[column] <= 32
    order = np.argsort(column[rare], kind="stable")
    r, c = row[rare][order], column[rare][order]
    k = 1
    while len(c) > k:
        same = np.flatnonzero(c[:-k] == c[k:])
        if not len(same):
            break
        out += np.bincount(r[same] * n + r[same + k], minlength=n * n).reshape(n, n)
        k += 1
    out += out.T
    r, c = row[~rare], np.unique(column[~rare], return_inverse=True)[1]
    for start in range(0, int(c.max()) + 1 if len(c) else 0, 4096):
        here = (c >= start) & (c < start + 4096)
        dense = np.zeros((n, min(4096, int(c.max()) + 1 - start)), np.float32)
        dense[r[here], c[here] - start] = 1
        out += (dense @ dense.T).astype(np.int64)
    return out


def link_rows(sets: list[np.ndarray], copies: np.ndarray, was: np.ndarray, first: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row, smallest row reachable, similarities of the linked pairs). Rows are in class order; those that
    were together in a cell before don't count again; with first > 0 only pairs of one row below and one at or above first
    count (two blocks)."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    inter = common(sets)
    linked = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    linked &= was[:, None] != was[None, :]
    if first:
        linked[:first, :first] = False
        linked[first:, first:] = False
    i, j = np.nonzero(np.triu(linked))
    similar = inter[i, j] / (size[i] + size[j] - inter[i, j])
    links, low = linked @ copies, np.arange(n)
    while True:
        now = np.minimum(low, np.where(linked, low[None, :], n).min(axis=1))
        now = now[now]
        if (now == low).all():
            return links, low, similar
        low = now


def verify(members: DataFrame, docs: DataFrame, n: int, threshold: float, block: int, depth: int, trees: int) -> DataFrame:
    """members: class_id, set_key, copies, cell, was. Returns class_id, links, low (the smallest class met) for each task,
    and with is_sum a row of its linked pairs: their number (links) and how many each depth would have missed."""
    sizes = members.groupBy("cell").agg(F.count("*").alias("cell_size"))
    n_members = members.count()
    bins = max(1, n_members // block)
    small = F.broadcast if n_members <= FEW else (lambda x: x)
    placed = members.join(small(sizes), "cell")
    n_blocks = F.ceil(F.col("cell_size") / block).cast("int")
    own = F.pmod(F.xxhash64("class_id"), n_blocks).cast("int")
    # Pairs of blocks (x <= y) that a row of block b takes part in; small cells share a task with others.
    tasks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    alone = F.struct(F.pmod(F.xxhash64("cell"), F.lit(bins)).cast("int").alias("x"), F.lit(-1).alias("y"))
    placed = placed.select("class_id", "set_key", "copies", "cell", "was", own.alias("own"), F.when(n_blocks > 1, F.col("cell")).otherwise(F.lit(None)).alias("big"), F.when(n_blocks > 1, tasks).otherwise(F.array(alone)).alias("tasks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), "text").filter("doc_id is not null and text is not null").join(small(placed), "class_id")
    rows = texts.select("class_id", "set_key", "copies", "cell", "was", "own", "big", "text", F.explode("tasks").alias("t")).select("*", "t.x", "t.y").drop("t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, similar = [], [np.zeros(0)]
        y = pdf["y"].iloc[0]
        for _, part in pdf.sort_values(["cell", "class_id"]).groupby("cell", sort=False):
            sets = shingles(part["text"].tolist(), n)
            good = [set_key(s) == k for s, k in zip(sets, part["set_key"])]  # a doc_id may stand on rows of other texts
            part = part.assign(s=pd.Series(sets, index=part.index, dtype=object))[good].drop_duplicates("class_id")
            first = 0
            if y >= 0 and part["x"].iloc[0] != y:
                part = part.sort_values(["own", "class_id"])
                first = int((part["own"] == part["x"]).sum())
                if first in (0, len(part)):
                    continue
            if len(part) < 2:
                continue
            links, low, some = link_rows(part["s"].tolist(), part["copies"].to_numpy(), part["was"].to_numpy(), first, threshold)
            similar.append(some)
            ids = part["class_id"].to_numpy()
            keep = links > 0
            out.append(pd.DataFrame({"is_sum": False, "class_id": ids[keep], "links": links[keep], "low": ids[low][keep], "missed": None}))
        pairs = np.concatenate(similar)
        if len(pairs):
            out.append(pd.DataFrame({"is_sum": [True], "class_id": [0], "links": [len(pairs)], "low": [0], "missed": [[float(missed(pairs, d, trees).sum()) for d in range(1, depth + 1)]]}))
        return pd.concat(out) if out else pd.DataFrame({"is_sum": [], "class_id": [], "links": [], "low": [], "missed": []})

    return rows.groupBy("big", "x", "y").applyInPandas(run, "is_sum boolean, class_id long, links long, low long, missed array<double>")


def cells_at(classes: DataFrame, n_classes: int, at: int, depth: int, trees: int) -> DataFrame:
    """class_id, cell of the classes that share a node of this depth with another one, or are connected through such."""
    prefix = lambda tree: F.xxhash64(tree, F.substring(F.col("forest"), tree * (2 * depth) + 1, F.lit(2 * at)))
    nodes = classes.select("class_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), prefix)).alias("node"))
    shared = nodes.groupBy("node").agg(F.min("class_id").alias("low"), F.count("*").alias("n")).filter("n > 1").select("node", "low")
    # At most half as many as nodes. Where those are many they are written out, so that Spark can split a frequent node's
    # rows in the join.
    shared = F.broadcast(shared) if n_classes * trees <= 2 * FEW else cut(shared)
    edges = nodes.join(shared, "node").filter("class_id <> low").select(F.col("class_id").alias("a"), F.col("low").alias("b")).distinct()
    found = components(edges)
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots).select(F.col("node").alias("class_id"), F.col("component").alias("cell"))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the same n-gram set), n_links (other rows at the threshold or above),
    component_id (smallest doc_id reachable by links), kept (doc_id = component_id): one row for each row of docs."""
    signed = cut(signatures(docs, n, depth, trees))
    classes = signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("forest").alias("forest")).filter("class_id is not null")
    classes = cut(classes)
    n_classes = classes.count()
    rounds, before = [], classes.select("class_id", F.col("class_id").alias("was")).limit(0)
    pairs, lost = 1.0, [float(missed(np.array([threshold]), d, trees)[0]) for d in range(1, depth + 1)]
    for at in range(depth, 0, -1):
        cells = cut(cells_at(classes, n_classes, at, depth, trees))
        members = cells.join(before, "class_id", "left").withColumn("was", F.coalesce("was", "class_id"))
        grown = members.groupBy("cell").agg(F.min("was").alias("a"), F.max("was").alias("b")).filter("a <> b").select("cell")
        grown = members.join(grown, "cell", "left_semi")
        grown = cut(classes.select("class_id", "set_key", "copies").join(grown, "class_id"))
        rounds.append(cut(verify(grown, docs, n, threshold, block, depth, trees)))
        sums = rounds[-1].filter("is_sum").agg(F.sum("links"), *[F.sum(F.col("missed")[d]) for d in range(depth)]).first()
        pairs += sums[0] or 0
        lost = [x + (y or 0.0) for x, y in zip(lost, sums[1:])]
        if pairs / (pairs + lost[at - 1]) >= recall:
            break
        before = cells.select("class_id", F.col("cell").alias("was"))
    found = rounds[0]
    for r in rounds[1:]:
        found = found.unionByName(r)
    found = found.filter("not is_sum")
    groups = components(found.select(F.col("class_id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    known = classes.select("set_key", "class_id", "copies").join(links, "class_id", "left").join(groups.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    out = signed.select("doc_id", "set_key").join(known, "set_key", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


#: All pairs in DuckDB, by their common n-grams; components by a recursive closure of the smallest label.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
s AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS twin FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM d JOIN m ON m.a = doc_id LEFT JOIN s ON s.a = doc_id
"""
