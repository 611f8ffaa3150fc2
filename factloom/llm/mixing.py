"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's cap is max_epochs times its size. Every source gets a share of the whole size in proportion to its weight;
sources whose share exceeds their cap are clamped to it and the excess goes to the others by weight, until none exceeds.
Only the two sums that set the level (size left, weight left) come to the driver in each round.

A source's target is met by whole repetitions of all its documents and one fractional repetition: documents fall into
BUCKETS by a seeded hash, and the fraction takes whole buckets in order up to the point nearest to what is left. So the
choice is the same in every run, at most one bucket off, and needs no sort of a source's documents.

Null sources are a source of their own, the last one; null texts have size 0; very long texts are counted whole. Rows of
one id, or without one, share a bucket, so a source made of such rows can't be parted: it is taken whole or not at all in
the fractional repetition. Repeated rows are counted and taken alike. Extra columns are ignored. Of an empty table nothing is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Source tables of at most this many rows are broadcast.
FEW_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weigh(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights by rank of the source in code point order, null last, repeating. One row for each source is sorted."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))


def targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """source, source_size, weight -> with target, and repeats (whole) and rest (words of the fractional repetition)."""
    cap = max_epochs * F.col("source_size")
    left, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total = left
    while True:
        over = F.col("weight") * F.lit(left) > cap * F.lit(weight)
        clamped, rest = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if (total - clamped, rest) == (left, weight) or rest == 0:
            break
        left, weight = total - clamped, rest
    share = F.col("weight") * F.lit(left)
    over = share > cap * F.lit(weight)
    target = F.when(over, cap.cast("double")).otherwise(F.when(F.lit(weight) > 0, share / F.lit(max(weight, 1))).otherwise(0.0))
    whole = F.when(over, F.lit(max_epochs)).when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("long")
    return sources.withColumn("target", target).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, repeats, taken (= repeats * size) of each row of docs, and the columns in keep."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 3), 16, 10).cast("int")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), bucket.alias("bucket"), *(keep or []))
    counted = sized if keep else cut(sized)
    sums = cut(counted.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = cut(weigh(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights))
    aimed = targets(sources, max_epochs)
    n_sources = sources.count()
    small = F.broadcast if n_sources <= FEW_SOURCES else (lambda x: x)
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    lines = sums.withColumn("upto", upto).alias("l").join(small(aimed).alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")))
    last = lines.groupBy(F.col("s.source").alias("source"), "source_size", "target", "whole").agg(F.coalesce(F.max(F.when((2 * F.col("upto") - F.col("words") <= 2 * F.col("rest")) & (F.col("rest") > 0), F.col("bucket"))), F.lit(-1)).alias("last_bucket"))
    out = counted.alias("d").join(small(last).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    repeats = F.col("whole") + F.when(F.col("bucket") <= F.col("last_bucket"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), *[f"d.{c}" for c in (keep or [])])


#: The same in DuckDB: the level is found by sorting sources by cap over weight instead of by rounds.
SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 3))::INT AS bucket FROM documents),
b AS (SELECT source, bucket, sum(size)::BIGINT AS words FROM d GROUP BY source, bucket),
s AS (SELECT source, sum(words)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS k,
             coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
             sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
             sum(source_size) OVER ()::BIGINT AS total FROM w),
f AS (SELECT total - capped AS lft, rest FROM o WHERE weight * (total - capped) <= 3 * source_size * rest ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight * lft > 3 * source_size * f.rest THEN (3 * source_size)::DOUBLE ELSE (weight * lft) / f.rest::DOUBLE END AS target,
             weight * lft > 3 * source_size * f.rest AS clamped FROM o, f),
g AS (SELECT *, CASE WHEN clamped THEN 3 WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT b.source, b.bucket, words, sum(words) OVER (PARTITION BY b.source ORDER BY b.bucket) AS upto FROM b),
l AS (SELECT g.source, g.source_size, g.target, g.whole,
             coalesce(max(CASE WHEN 2 * upto - words <= 2 * (target - whole * source_size) AND target - whole * source_size > 0 THEN bucket END), -1) AS last_bucket
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source GROUP BY ALL)
SELECT doc_id, size, source_size, target, (whole + (bucket <= last_bucket)::INT)::BIGINT AS repeats, ((whole + (bucket <= last_bucket)::INT) * size)::BIGINT AS taken
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""
