"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry, by exact k-means over
integers whose nearest entries are searched in vantage-point trees.

Components x become floor(SCALE * x). A tree over the entries of each part position splits them by their distance from a
vantage entry into a nearer and a farther half; a half keeps the range of its distances, rounded down and up to whole
numbers. A search visits a half unless the range rules it out, also where the bound equals the best distance so far, as
ties go to the lower index; distances are whole numbers throughout, so no rounding decides. Rows of a batch walk through a tree together.

A round reads the vectors once: a task assigns its rows and returns sums and counts of each entry, which Spark adds up;
only codebooks (PARTS * ENTRIES entries of a vector's length) go to the driver and back. Sums travel as limbs of 32 bits, so
they are exact for any finite component; parts whose squares could pass 2**62 are computed in Python integers.

Vectors that are null or hold null or non-finite components are dropped. A null vec_id is the largest; of rows of one
vec_id among the first the least vector is an entry. Vectors of another length have codebooks of their own (with
codebooks_sha256 of their own): the driver holds those of all lengths. Parts of a length that PARTS does not divide differ
by one component at most, and may be empty: their error is 0 and their code 00. Fewer ids than ENTRIES make fewer entries;
entries that no part is nearest to stay. error and label_error are null where they exceed a long. Repeated rows have
repeated results, extra columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMB = 32
#: Tables of at most this many labels are broadcast.
FEW = 200_000
#: Rows that walk through the trees together.
BATCH = 8192


def finite(embedding: Column) -> Column:
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def edges(length: int, parts: int) -> list[int]:
    return [length * k // parts for k in range(parts + 1)]


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where all fit with room, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if not x.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[math.floor(c * scale) if abs(c) < 1e290 else int(c) * scale for c in row] for row in x.tolist()], object).reshape(x.shape)


def small(x: np.ndarray) -> bool:
    """Whether squared distances of such rows fit in 62 bits."""
    return x.dtype != object and (not x.size or 4 * x.shape[1] * int(np.abs(x).max()) ** 2 < 1 << 62)


def squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(x), x.dtype)


def root(d: np.ndarray) -> np.ndarray:
    """Whole numbers at most 1 from the square root."""
    if d.dtype == object:
        return np.array([math.isqrt(v) for v in d], object)
    return np.sqrt(d.astype(np.float64)).astype(np.int64)


class Tree:
    """A vantage-point tree: an entry, and its two halves, each with the least and the largest distance from the entry."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(entries)) if numbers is None else numbers
        self.number, self.entry, self.halves = int(numbers[0]), entries[numbers[0]], []
        rest = numbers[1:]
        if len(rest):
            d = root(squares(entries[rest], self.entry))
            order = np.argsort(d, kind="stable")
            for half in (order[: (len(rest) + 1) // 2], order[(len(rest) + 1) // 2 :]):
                if len(half):
                    self.halves.append((max(0, int(d[half[0]]) - 1), int(d[half[-1]]) + 1, Tree(entries, np.sort(rest[half]))))

    def visit(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
        """Betters best (squared distance) and code of rows; returns the number of distances computed."""
        d = squares(x[rows], self.entry)
        better = (d < best[rows]) | ((d == best[rows]) & (self.number < code[rows]))
        best[rows[better]], code[rows[better]] = d[better], self.number
        seen = len(rows)
        if not self.halves:
            return seen
        r = root(d)
        gaps = [np.maximum(np.maximum(low - (r + 1), (r - 1) - high), 0) for low, high, _ in self.halves]
        inner = gaps[0] <= gaps[-1]
        for turn, mask in ((range(len(self.halves)), inner), (range(len(self.halves) - 1, -1, -1), ~inner)):
            for k in turn:
                here = rows[mask]
                go = here[gaps[k][mask] ** 2 <= best[here]]  # not strict: an equal distance of a lower index counts
                if len(go):
                    seen += self.halves[k][2].visit(x, go, best, code)
        return seen


def nearest(x: np.ndarray, entries: np.ndarray, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of each row's nearest entry, squared distance, distances computed); ties go to the lower index."""
    if not (small(x) and small(entries)):
        x, entries, tree = x.astype(object), entries.astype(object), None
    best = np.full(len(x), (1 << 63) - 1, np.int64) if x.dtype != object else np.array([math.inf] * len(x), object)
    code = np.full(len(x), len(entries), np.int64)
    seen = (tree or Tree(entries)).visit(x, np.arange(len(x)), best, code) if len(x) else 0
    return code, best, seen


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2**LIMB; digits have its sign."""
    sign, left, place = (-1 if value < 0 else 1), abs(value), 0
    while left:
        if digit := left & ((1 << LIMB) - 1):
            yield place, sign * digit
        left, place = left >> LIMB, place + 1


def packed(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if not entries.size or max(abs(int(v)) for v in entries.ravel()) < 1 << 62 else entries


def batches_of(batches: Iterator[pa.RecordBatch], scale: int, column: str = "embedding") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, matrix) of the rows of one length each."""
    for big in batches:
        for i in range(0, big.num_rows, BATCH):
            batch = big.slice(i, BATCH)
            vectors = batch.column(batch.schema.get_field_index(column))
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                at = (ends[rows] - size)[:, None] + np.arange(size)
                x = flat[at]
                # Rows of large components go by themselves, so that the others stay in 64 bits.
                large = (np.abs(x).max(axis=1, initial=0) >= 2.0**27 / scale) if size else np.zeros(len(rows), bool)
                for some in (rows[~large], rows[large]):
                    if len(some):
                        yield batch, some, whole(x[np.searchsorted(rows, some)], scale)


class Codebooks:
    """Entries of each length: a list of matrices (entries by components of the part), one for each part."""

    def __init__(self, first: dict[int, np.ndarray], parts: int):
        self.parts = parts
        self.of = {n: [packed(x[:, a:b]) for a, b in zip(edges(n, parts)[:-1], edges(n, parts)[1:])] for n, x in first.items()}

    def trees(self) -> dict[int, list[Tree | None]]:
        return {n: [Tree(e) if small(e) else None for e in parts] for n, parts in self.of.items()}

    def encode(self, x: np.ndarray, trees: list[Tree | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: (its rows of x, code, squared distance)."""
        cuts = edges(x.shape[1], self.parts)
        for a, b, entries, tree in zip(cuts[:-1], cuts[1:], self.of[x.shape[1]], trees):
            code, d, _ = nearest(x[:, a:b], entries, tree)
            yield x[:, a:b], code, d

    def update(self, totals: dict[tuple[int, int, int, int], int]) -> None:
        """totals: by length, part, entry and position (-1: the count)."""
        for n, parts in self.of.items():
            for p, entries in enumerate(parts):
                new = entries.astype(object)
                for e in range(len(entries)):
                    if count := totals.get((n, p, e, -1), 0):
                        new[e] = [totals.get((n, p, e, k), 0) // count for k in range(entries.shape[1])]
                parts[p] = packed(new)

    def digest(self, length: int) -> str:
        """SHA-256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(str(int(v)) for part in self.of[length] for v in part.ravel()).encode()).hexdigest()


def first_entries(kept: DataFrame, entries: int, scale: int, parts: int) -> Codebooks:
    """The vectors of the smallest vec_ids of each length."""
    ids = kept.select(F.size("embedding").alias("length"), "vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last()))
    ids = ids.withColumn("rank", rank).filter(F.col("rank") <= entries)
    some = kept.alias("k").join(F.broadcast(ids.alias("i")), (F.size("k.embedding") == F.col("i.length")) & F.col("k.vec_id").eqNullSafe(F.col("i.vec_id")))
    rows = some.groupBy("length", "rank").agg(F.min("embedding").alias("embedding")).orderBy("length", "rank").collect()  # entries for each length
    first: dict[int, list] = {}
    for r in rows:
        first.setdefault(r.length, []).append(r.embedding)
    return Codebooks({n: whole(np.array(x, np.float64).reshape(len(x), n), scale).astype(object) for n, x in first.items()}, parts)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after the rounds. kept: vec_id, embedding, all of it finite."""
    books, spark = first_entries(kept, entries, scale, parts), kept.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # parts * entries entries for each length

        def sums(batches):
            books, totals = shared.value, {}
            trees = books.trees()
            for _, _, x in batches_of(batches, scale):
                n = x.shape[1]
                for p, (part, code, _) in enumerate(books.encode(x, trees[n])):
                    for e in np.unique(code):
                        own = part[code == e]
                        for k, v in enumerate([len(own), *own.sum(axis=0).tolist()]):
                            key = (n, p, int(e), k - 1)
                            totals[key] = totals.get(key, 0) + v
            out = [(*key, place, digit) for key, v in totals.items() for place, digit in limbs(int(v))]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["length", "part", "entry", "position", "place", "digit"])

        keys = ["length", "part", "entry", "position", "place"]
        found = kept.select("embedding").mapInArrow(sums, ", ".join(f"{k} long" for k in [*keys, "digit"]))
        totals: dict[tuple[int, int, int, int], int] = {}
        for r in found.groupBy(*keys).agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect():  # a codebook's size
            key = (r.length, r.part, r.entry, r.position)
            totals[key] = totals.get(key, 0) + (int(r.digit) << (LIMB * r.place))
        books.update(totals)
        shared.unpersist()
    return books


def encode(kept: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """The columns of kept but its embedding, and code, error, codebooks_sha256."""
    if any(len(part) > 256 for parts in books.of.values() for part in parts):
        raise ValueError("codes of two hex digits hold 256 entries at most")
    shared = kept.sparkSession.sparkContext.broadcast((books, {n: books.digest(n) for n in books.of}))
    names = [c for c in kept.columns if c != "embedding"]

    def codes(batches):
        books, digests = shared.value
        trees = books.trees()
        for batch, rows, x in batches_of(batches, scale):
            found = list(books.encode(x, trees[x.shape[1]]))
            text = np.stack([c for _, c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            size = 2 * books.parts
            total = [sum(map(int, d)) for d in zip(*[d.tolist() for _, _, d in found])]
            out = batch.select(names).take(pa.array(rows))
            more = [pa.array([text[i : i + size] for i in range(0, len(text), size)]), pa.array([v if v < 1 << 63 else None for v in total], pa.int64()), pa.array([digests[x.shape[1]]] * len(rows))]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], [*names, "code", "error", "codebooks_sha256"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "embedding")
    return kept.mapInArrow(codes, f"{fields}code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each kept row of vectors (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), embedding.alias("embedding"))
    kept = cut(rows.filter(finite(F.col("embedding"))))
    coded = encode(kept, fit(kept, parts, entries, rounds, scale), scale)
    coded = cut(coded)
    sums = cut(coded.groupBy("label").agg(F.count("error").alias("known"), F.count("*").alias("rows"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total")))
    total = F.when((F.col("known") == F.col("rows")) & (F.col("total") <= (1 << 63) - 1), F.col("total").cast("long"))
    sums = sums.select(F.col("label").alias("of"), total.alias("label_error"))
    # A hot label is one row of sums; where labels are many, Spark may split their rows in the join.
    sums = F.broadcast(sums) if sums.count() <= FEW else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """For vectors of one length that parts divides."""
    size = f"(len(e) // {parts})"
    out = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, part, e[part * {size} + 1 : (part + 1) * {size}] AS x FROM v, range({parts}) AS r(part))",
        f"c0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::BIGINT AS entry, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})",
    ]
    for k in range(rounds + 1):
        out.append(
            f"a{k} AS (SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x, min(256 * list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + entry) AS m FROM p JOIN c{k} USING (part) GROUP BY vec_id, part)"
        )
        if k < rounds:
            out.append(f"u{k} AS (SELECT part, m % 256 AS entry, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM a{k}, range(1, (SELECT max(len(x)) + 1 FROM p)) AS r(i) GROUP BY ALL)")
            out.append(f"n{k} AS (SELECT part, entry, list(y ORDER BY i) AS c FROM u{k} GROUP BY ALL)")
            out.append(f"c{k + 1} AS (SELECT part, entry, coalesce(n{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN n{k} USING (part, entry))")
    last = f"a{rounds}"
    out += [
        f"z AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (m % 256)::BIGINT), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM {last} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM z, h"


SQL = _sql()
