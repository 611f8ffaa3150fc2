"""Merkle manifest of a table: a tree of arity 8 over the rows of each language, one over the languages' roots, and a proof of
inclusion for every row.

Each row is hashed where it is read, so texts are never shuffled; (language, doc_id, leaf) are range-sorted, which splits a
large language, and counts of each partition and language give positions. Each partition builds the complete aligned
subtrees of its own positions; nodes of runs that it shares with its neighbours are shuffled by (language, level, position)
and finished level by level, at most 8 to a group. The proof pass brings the shared runs back to the partitions that need
them, at most two for each level, language and partition.

Nulls are hashed as `-`; a null lang comes first, a null doc_id first in its language and is never tampered with. Rows of one
doc_id are ordered by their leaf, so equal rows are leaves of their own, interchangeable. Empty texts are values of 0 bytes,
very long ones are hashed whole. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Nodes of a run; rows of a range partition.
BITS, ROWS = 3, 100_000
ARITY = 1 << BITS
#: At most this many languages have their tree made on the driver (64 bytes each).
FEW = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of columns, each as its length in bytes and its value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]).cast("binary"), 256)


def leaves(docs: DataFrame, changes: bool = True) -> DataFrame:
    """grp (the language), key (doc_id), leaf, changed: the leaf of a row that was tampered with, else null."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & F.lit(changes)
    columns = [F.col(c) for c in FIELDS]
    changed = F.when(tampered, leaf([*columns[:-1], F.translate("text", UPPER, LOWER)]))
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf(columns).alias("leaf"), changed.alias("changed"))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def local_nodes(start: int, total: int, hashes: list[str]) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """(for each level: position of the first node known here, and the nodes; (level, position, hash) of those whose parent is not).

    hashes are the leaves from position start on, of a tree of total leaves. A node is known where all below it are."""
    levels, shared, size, first = [(start, hashes)], [], total, start
    while size > 1 and hashes:
        last = first + len(hashes)
        low = -(-first // ARITY)  # the first run that begins here
        high = last // ARITY if last < size else -(-size // ARITY)  # the first that does not end here
        up = [digest(*hashes[max(0, ARITY * r - first) : ARITY * (r + 1) - first]) for r in range(low, high)]
        level = len(levels) - 1
        kept = range(min(ARITY * low, last), min(ARITY * high, last)) if up else range(0)
        shared += [(level, first + i, h) for i, h in enumerate(hashes) if first + i not in kept]
        size, first, hashes = -(-size // ARITY), low, up
        levels.append((first, hashes))
    if hashes:
        shared += [(len(levels) - 1, first, hashes[0])]
    return levels, shared


def ordered(rows: DataFrame, rows_each: int) -> DataFrame:
    """rows (grp, key, leaf, ...) with part, their range partition, and at, which grows within it; sorted by grp, key, leaf."""
    rows = cut(rows.withColumn("tie", F.monotonically_increasing_id()))
    total, spark = rows.count(), rows.sparkSession
    n = max(1, -(-total // rows_each), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2000))
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "leaf", "tie")]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    return cut(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))


def siblings(level: tuple[int, list[str]], idx: int, shared: list[str] | None) -> tuple[str, str]:
    """What stands before and after node idx in its run: a shared one, or one of this partition's nodes."""
    first, nodes = level
    run = idx >> BITS << BITS
    members = shared if shared is not None else nodes[run - first : run - first + ARITY]
    return "".join(members[: idx - run]), "".join(members[idx - run + 1 :])


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for before, after in path:
        node = digest(before, node, after)
    return node


def paths(hashes: list[str]) -> tuple[list[list[tuple[str, str]]], str]:
    """(siblings of each leaf up to the root, the root) of a tree held whole."""
    levels = local_nodes(0, len(hashes), hashes)[0]
    known = range(len(levels) - 1)
    return [[siblings(levels[k], i >> BITS * k, None) for k in known] for i in range(len(hashes))], levels[-1][1][0]


PATH = "array<struct<before:string,after:string>>"


class Forest:
    """A tree for each group of rows (grp, key, leaf, changed).

    placed: part, grp, start, n, total of each group's share of a partition; runs: grp, level, run, hashes of the runs that
    partitions share (None where there are none); tops: grp, hash of each group's root."""

    def __init__(self, rows: DataFrame, rows_each: int = ROWS):
        self.rows, by = ordered(rows, rows_each), Window.partitionBy("grp")
        n = self.rows.groupBy("part", "grp").agg(F.count("*").alias("n"))
        before = F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        self.placed = cut(n.select("part", "grp", F.coalesce(before, F.lit(0).cast("long")).alias("start"), "n", F.sum("n").over(by).alias("total")))
        # At most two groups of a partition go on in another one.
        offsets = {(r.part, r.grp): (r.start, r.total) for r in self.placed.filter("total > n").collect()}
        self.levels = max((height(total) for _, total in offsets.values()), default=0)
        shared = rows.sparkSession.sparkContext.broadcast(offsets)

        def build(batches):
            where, held, out = None, [], []

            def nodes():
                start, total = shared.value.get(where, (0, len(held)))
                return [(where[1], level, i, h, height(total)) for level, i, h in local_nodes(start, total, held)[1]]

            for batch in batches:
                for part, group, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if held and (part, group) != where:
                        out += nodes()
                        held = []
                    where = part, group
                    held.append(h)
                if len(out) > 10_000:
                    yield _batch(out)
                    out = []
            if held:
                out += nodes()
            if out:
                yield _batch(out)

        nodes = cut(self.rows.select("part", "grp", "leaf").mapInArrow(build, "grp string, level int, idx long, hash string, top int"))
        tops, self.runs, made = nodes.filter("level = top"), None, None
        for level in range(self.levels):
            here = nodes.filter((F.col("level") == level) & (F.col("top") > level))
            here = here if made is None else here.unionByName(made.filter(F.col("top") > level))
            found = here.groupBy("grp", F.shiftright("idx", BITS).alias("run"), "top").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x"))
            found = cut(found.select("grp", F.lit(level).alias("level"), "run", "top", F.col("x.hash").alias("hashes")))
            made = found.select("grp", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), F.sha2(F.array_join("hashes", "").cast("binary"), 256).alias("hash"), "top")
            here = found.select("grp", "level", "run", "hashes")
            self.runs, tops = here if self.runs is None else self.runs.unionByName(here), tops.unionByName(made.filter("level = top"))
        self.tops = tops.select("grp", "hash")

    def needs(self, above: DataFrame) -> DataFrame:
        """part, grp, start, total, shared (level, run, hashes of shared runs that the part's rows lie below), subroot, path,
        root. above: grp, subroot, path (siblings of the group's root), root."""
        p, a = self.placed.alias("p"), above.alias("a")
        out = p.join(a, F.col("p.grp").eqNullSafe(F.col("a.grp"))).select("p.*", "a.subroot", "a.path", "a.root")
        if self.runs is None:
            return out.select("*", F.lit(None).cast("array<struct<level:int,run:bigint,hashes:array<string>>>").alias("shared"))
        run_of = lambda at: F.call_function("shiftright", at, (F.col("level") + 1) * BITS)
        asked = self.placed.filter("total > n").select("*", F.explode(F.sequence(F.lit(0), F.lit(self.levels - 1))).alias("level"))
        asked = asked.select("part", "grp", "level", F.explode(F.array_distinct(F.array(run_of(F.col("start")), run_of(F.col("start") + F.col("n") - 1)))).alias("run"))
        q, r = asked.alias("q"), self.runs.alias("r")
        met = q.join(r, F.col("q.grp").eqNullSafe(F.col("r.grp")) & (F.col("q.level") == F.col("r.level")) & (F.col("q.run") == F.col("r.run")))
        met = met.groupBy("q.part", "q.grp").agg(F.collect_list(F.struct("r.level", "r.run", "r.hashes")).alias("shared")).alias("m")
        o = out.alias("o")
        return o.join(met, (F.col("o.part") == F.col("m.part")) & F.col("o.grp").eqNullSafe(F.col("m.grp")), "left").select("o.*", "m.shared")

    def prove(self, above: DataFrame, key_type: str, proofs: bool) -> DataFrame:
        """grp, key, leaf, subroot, root, proof_sha256, folded_root of each row, and proof if asked for."""

        def of_group(rows: pd.DataFrame, start: int, total: int, shared: dict, subroot: str, path: list, root: str) -> list[tuple]:
            hashes, changed = rows["leaf"].tolist(), rows["changed"].tolist()
            levels, top, out = local_nodes(start, total, hashes)[0], height(total), []
            run, upper, below, known = None, path, "", {}
            for k, (key, h, c) in enumerate(zip(rows["key"].tolist(), hashes, changed)):
                i = start + k
                if i >> BITS != run:
                    run, known = i >> BITS, {}
                    upper = [siblings(levels[level] if level < len(levels) else (0, []), i >> BITS * level, shared.get((level, i >> BITS * (level + 1)))) for level in range(1, top)] + path
                    below = "".join(b + a for b, a in upper)
                own = [siblings(levels[0], i, shared.get((0, run)))] if top else []
                first = fold(h if c is None else c, own)
                if first not in known:
                    known[first] = fold(first, upper)
                out.append((key, h, subroot, root, digest(*(x for pair in own for x in pair), below), known[first]) + (([{"before": b, "after": a} for b, a in own + upper],) if proofs else ()))
            return out

        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["proof"] if proofs else [])]

        def of_part(rows: pd.DataFrame, needs: pd.DataFrame) -> pd.DataFrame:
            rows, found = rows.sort_values("at"), []
            groups = {r.need_grp: r for r in needs.itertuples()}
            group = rows["grp"].tolist()
            cuts = [k for k in range(len(group)) if k == 0 or group[k] != group[k - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(group)]):
                n = groups[group[a]]
                shared = {} if n.need_shared is None else {(x["level"], x["run"]): list(x["hashes"]) for x in n.need_shared}
                found += of_group(rows.iloc[a:b], n.need_start, n.need_total, shared, n.need_subroot, [(x["before"], x["after"]) for x in n.need_path], n.need_root)
            out = pd.DataFrame(found, columns=names, dtype=object)
            out["key"] = out["key"].astype("Int64" if key_type == "long" else object)
            return out

        kinds = f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", proof {PATH}" if proofs else "")
        needs = self.needs(above)
        needs = needs.select(*[F.col(c).alias(f"need_{c}") for c in needs.columns])
        return self.rows.groupBy("part").cogroup(needs.groupBy("need_part")).applyInPandas(of_part, kinds)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["grp", "level", "idx", "hash", "top"])


def above(tops: DataFrame, few: int = FEW) -> DataFrame:
    """grp, subroot, path, root: the tree over the groups' roots. Few groups are joined on the driver, else as a forest of one."""
    tops, spark, schema = cut(tops), tops.sparkSession, f"grp string, subroot string, path {PATH}, root string"
    if tops.count() <= few:
        found = sorted(((r.grp, r.hash) for r in tops.collect()), key=lambda r: (r[0] is not None, (r[0] or "").encode()))
        if not found:
            return spark.createDataFrame([], schema)
        each, root = paths([h for _, h in found])
        return spark.createDataFrame([(g, h, path, root) for (g, h), path in zip(found, each)], schema)
    one = Forest(tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("hash").alias("leaf"), F.lit(None).cast("string").alias("changed")))
    top = one.tops.select("grp", F.col("hash").alias("subroot"), F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    return one.prove(top, "string", True).select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), F.col("proof").alias("path"), "root")


def manifest(docs: DataFrame, proofs: bool = False, rows_each: int = ROWS, few: int = FEW) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs (FIELDS), and with proofs the
    siblings of each level, as what stands before and after the node. folded_root comes from the tampered leaf, where a row
    was tampered with."""
    forest = Forest(leaves(docs), rows_each)
    out = forest.prove(above(forest.tops, few), "long", proofs)
    return out.select(F.col("key").alias("doc_id"), *[c for c in out.columns if c != "key"], (F.col("folded_root") == F.col("root")).alias("verified"))


def verify(docs: DataFrame, proof: str = "proof", root: str = "root") -> Column:
    """Whether a row of docs (FIELDS, its proof and the root) is in the tree of that root."""
    step = lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]).cast("binary"), 256)
    return F.aggregate(proof, leaf([F.col(c) for c in FIELDS]), step) == F.col(root)


def _sql(levels: int = 8, forest: int = 4) -> str:
    """For at most ARITY**levels rows of a language and ARITY**forest languages, without repeated doc_ids."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    whole = lambda text: "sha256(" + " || ".join([field(c) for c in FIELDS[:-1]] + [f"CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || {text} END"]) + ")"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: list_reduce(list_prepend(xor(a, x), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda c, one: xor(c >> 1, 3988292384 * (c & one))), 4294967295::BIGINT), 4294967295)"
    out = [
        f"d AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {whole('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {whole(f'translate(text, {UPPER!r}, {LOWER!r})')} END AS changed FROM documents)",
        "n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d)",
        "f0 AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS i, leaf, coalesce(changed, leaf) AS f, '' AS p FROM d)",
    ]

    def climb(name: str, k: int, at: str) -> None:
        """Nodes of level k + 1, and rows one level up; the level of a tree that has reached its top stays as it is."""
        run = f"PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN"
        s = f"CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} {{}}), '') ELSE '' END"
        out.append(f"{name}s{k} AS (SELECT *, {s.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {s.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT g, i // {ARITY} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + {ARITY - 1}) // {ARITY} AS n FROM {name}{k} GROUP BY g, i // {ARITY})")
        out.append(f"{at}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN n > 1 THEN sha256(b || f || a) ELSE f END AS f, p || b || a AS p, f.i // {ARITY} AS i) FROM {at}{k} AS f JOIN {name}s{k} AS s USING (g, i))")

    for k in range(levels):
        climb("n", k, "f")
    out.append(f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS own FROM n{levels})")
    out.append(f"e0 AS (SELECT doc_id, 0 AS g, t0.i, leaf, h AS subroot, f, p FROM f{levels} AS f JOIN t0 ON t0.own = f.g)")
    for k in range(forest):
        climb("t", k, "e")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM e{forest}, t{forest}"


SQL = _sql()
