"""Selections: first by order, one per key, quotas, interleaving, allocation, as-of and year-over-year lookups."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.core import order_key
from factloom.sources.shared import kept


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order; order must leave no ties to be the same at every run."""
    return top_by(df, keys, 1, *order)


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key. Spark limits within each task before it shuffles."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).filter(F.col("_at") <= k).drop("_at")


#: Rows that are looked at for each key that is wanted, before all are.
AHEAD = 8


def first_keys(df: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    """The first row of each of the n keys that come first, all by one order of the rows.

    Rows that come first hold the first row of each of their keys, so they are enough where they have n keys, or are all
    rows there are: each task keeps AHEAD * n of them, and these are written once; no other row is shuffled. Where some keys
    have so many rows that they aren't enough, all rows are looked at."""
    near = kept(df.orderBy(*order).limit(AHEAD * n))
    rows, keys = near.agg(F.count("*"), F.count_distinct(F.coalesce(key, F.lit("")), F.col(key).isNull())).first()
    return first_by(near if keys >= n or rows < AHEAD * n else df, [key], *order).orderBy(*order).limit(n)


def ranked(df: DataFrame, keys: list[str], name: str, *order: Column | str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def interleave(df: DataFrame, keys: list[str], tier_rank: str, weight: str, *order: Column | str, limit: int | None = None) -> DataFrame:
    """Weighted round-robin over tiers: in each cycle a tier gives as many rows as its weight. Adds cycle and position.

    A row's cycle is its rank within the tier divided by the weight, so the loop is an ordering."""
    within = F.row_number().over(Window.partitionBy(*keys, tier_rank).orderBy(*order))
    out = df.withColumn("_within", within)
    if limit is not None:  # no tier can give more, and Spark cuts it off before the shuffle
        out = out.filter(F.col("_within") <= limit)
    out = out.withColumn("cycle", F.floor((F.col("_within") - 1) / F.col(weight)).cast("long"))
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("cycle", tier_rank, "_within"))).drop("_within")
    return out if limit is None else out.filter(F.col("position") <= limit)


def previous_nonzero(df: DataFrame, keys: list[str], order: str, value: str, name: str = "previous") -> DataFrame:
    """As-of lookup: the last earlier value of the series that isn't zero."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(F.col(value) != 0, F.col(value)), ignorenulls=True).over(before))


def argmax_unique(df: DataFrame, keys: list[str], value: str, of: str) -> DataFrame:
    """keys, best, at: the row of the greatest value of each key; keys whose greatest value ties are left out."""
    best = df.groupBy(*keys).agg(F.max(value).alias("best"), F.max_by(of, value).alias("at"))
    ties = df.join(best, keys).filter(F.col(value) == F.col("best")).groupBy(*keys).agg(F.count("*").alias("n")).filter("n = 1")
    return best.join(ties.select(*keys), keys)


def allocate_rows(groups: DataFrame, weight: str, total: int, least: int = 0) -> DataFrame:
    """Seats of each group by largest remainder, total in all; with least, every positive weight has as many at the
    least if total allows. groups' first column is their key, and settles ties.

    Two sums come to the driver; the seats left over go to the groups of the greatest remainders, and seats given beyond
    total are taken back from the highest, seat by seat: both are sorted limits, so no task sees all groups."""
    key = groups.columns[0]
    n, whole = groups.filter(F.col(weight) > 0).agg(F.count("*"), F.sum(weight)).first()
    if not n or total <= 0:
        return groups.withColumn("seats", F.lit(0).cast("long"))
    low = least if total >= least * n else 0
    share = F.coalesce(F.greatest(F.lit(total) * F.col(weight) / F.lit(whole), F.lit(0)), F.lit(0))
    rows = groups.withColumn("_rest", share - F.floor(share)).withColumn("_seats", F.greatest(F.floor(share), F.when(F.col(weight) > 0, F.lit(low)).otherwise(0)).cast("long"))
    over = rows.agg(F.sum("_seats")).first()[0] - total
    if over <= 0:
        change = rows.orderBy(F.col("_rest").desc(), key).limit(-over).select(key, F.lit(1).alias("_change"))
    else:
        seats = rows.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_seats"))).alias("seat")) if low else None
        change = seats.orderBy(F.col("seat").desc(), F.col(key).desc()).limit(over).groupBy(key).agg((-F.count("*")).alias("_change"))
    return rows.join(change, key, "left").withColumn("seats", (F.col("_seats") + F.coalesce("_change", F.lit(0))).cast("long")).drop("_rest", "_seats", "_change").select(*groups.columns, "seats")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def override(df: DataFrame, changes: DataFrame, key: str, column: str, allowed: Column) -> DataFrame:
    """column replaced where changes has the key. Unknown keys, and rows that allowed doesn't hold for, are an error."""
    if changes.join(df, key, "left_anti").limit(1).count():
        raise ValueError(f"overrides of unknown {key}")
    if changes.select(key).join(df.filter(~allowed), key).limit(1).count():
        raise ValueError("overrides of rows that need none")
    new = changes.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def pending(order: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return order.join(done, key, "left_anti")


def accounting(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, status (ok, missing, extra, duplicate) of a full outer join of expected and seen rows."""
    e, s = expected.groupBy(key).agg(F.count("*").alias("n_expected")), seen.groupBy(key).agg(F.count("*").alias("n_seen"))
    status = F.when(F.col("n_seen").isNull(), "missing").when(F.col("n_expected").isNull(), "extra").when(F.col("n_seen") > 1, "duplicate").otherwise("ok")
    return e.join(s, key, "full_outer").select(key, status.alias("status"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, fields: which common columns differ (null-safe) between two versions of a table."""
    common = [c for c in old.columns if c in new.columns and c != key and c not in ignore]
    both = old.alias("o").join(new.alias("n"), key)
    fields = F.filter(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in common]), lambda x: x.isNotNull())
    return both.select(key, fields.alias("fields")).filter(F.size("fields") > 0)


def few_values(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct values of a column of few values, in order; an error beyond most, so that none is dropped unseen."""
    rows = df.select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted((r[0] for r in rows), key=lambda v: (v is None, v))


def examples(df: DataFrame, kind: str, group: str, key: str) -> DataFrame:
    """One row of each kind, that of the least key, of a group that no earlier kind has taken where there is one. Both
    columns have few values; one row for each pair of them comes to the driver."""
    kinds, groups = few_values(df, kind), few_values(df, group)
    firsts = {(r[kind], r[group]): r["_key"] for r in df.groupBy(kind, group).agg(F.min(key).alias("_key")).limit(len(kinds) * len(groups) + 1).collect()}
    taken, out = set(), []
    for k in kinds:
        offered = [g for g in groups if (k, g) in firsts]
        best = next((g for g in offered if g not in taken), offered[0])
        taken.add(best)
        out.append((k, best, firsts[k, best]))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.sparkSession.createDataFrame(out, f"`{kind}` {types[kind]}, `{group}` {types[group]}, `{key}` {types[key]}")


def reuse(rows: DataFrame, frozen: DataFrame, key: str, content: str, value: str) -> DataFrame:
    """rows with the frozen value of their key where the content is still the same, and status: frozen, stale or open."""
    old = frozen.select(key, F.col(content).alias("_content"), F.col(value).alias("_value"))
    same = F.col("_content").eqNullSafe(F.col(content))
    status = F.when(F.col("_content").isNull(), "open").when(same, "frozen").otherwise("stale")
    return rows.join(old, key, "left").select(*rows.columns, F.when(same, F.col("_value")).alias(value), status.alias("status"))


def agreement(old: DataFrame, new: DataFrame, keys: list[str], before: str, after: str, by: list[str]) -> DataFrame:
    """by, n, agree, lost, won: outcomes of two runs on the keys that both have."""
    both, a, b = old.join(new, keys), F.col(before), F.col(after)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a == b).alias("agree"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("won"))


def positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with position, from 1, in the given order; order must leave no ties to be the same at every run.

    Rows are sorted in ranges, numbered within theirs, and moved on by the number of rows in the ranges before, of which
    there is one count each: no task sees more than a range. The sorted rows are written once."""
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place within it in the lower 33
    placed = kept(df.orderBy(*order).select("*", at.alias("_at")))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    n = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = n.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a partition
    return placed.join(F.broadcast(before), part == F.col("_part")).select(*df.columns, (place + F.col("_before") + 1).alias("position"))


def unique_ids(df: DataFrame, key: str, seed: str, digits: int = 10, step: int = 2, most: int = 64) -> DataFrame:
    """key and unique_id of each key of df: R and so many digits of its SHA-256 that no smaller key has the same id; an error
    where most digits don't do. Only keys that still collide are looked at again."""
    digest = F.upper(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"), 256))
    left, out = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", digest), None
    while True:
        if digits > most:
            raise ValueError(f"ids of {most} digits still collide")
        rank = F.row_number().over(Window.partitionBy(F.substring("_h", 1, digits)).orderBy(key))
        ranked = kept(left.withColumn("_r", rank))
        own = ranked.filter("_r = 1").select(key, F.concat(F.lit("R"), F.substring("_h", 1, digits)).alias("unique_id"))
        out, left = own if out is None else out.unionByName(own), ranked.filter("_r > 1").drop("_r")
        if left.isEmpty():
            return out
        digits += step


#: Kinds by domains of a coverage sample; more are an error.
STRATA = 5000


def coverage_sample(df: DataFrame, key: str, kind: str, domain: str, answerable: str, total: int, seed: str, least: int = 2) -> DataFrame:
    """key, pick: total rows, coverage first and balance second. In seeded order one row of every kind is picked, then one of
    every domain without any, then rows that can't be answered until there are least; the rest, by turns, are of the
    domain and kind picked least so far (their sum, then the kind), the smallest key first. Rows without a key are left out.

    All of this asks for no more than total rows of each stratum (kind, domain, answerable) in either order, which Spark
    picks; only those come to the driver."""
    h = order_key(seed, F.col(key))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(domain).alias("domain"), F.coalesce(F.col(answerable), F.lit(False)).alias("ok"), h.alias("h"))
    strata = ["kind", "domain", "ok"]
    if rows.select(strata).distinct().limit(STRATA + 1).count() > STRATA:
        raise ValueError(f"more than {STRATA} kinds by domains")
    some = top_by(rows, strata, total, "h", "key").unionByName(top_by(rows, strata, 2 * total, "key")).distinct().collect()
    groups: dict[tuple, list] = {}
    for r in some:
        groups.setdefault((r.kind, r.domain, r.ok), []).append(r)
    by_hash = {g: sorted(rs, key=lambda r: (r.h, r.key)) for g, rs in groups.items()}
    by_key = {g: sorted(rs, key=lambda r: r.key) for g, rs in groups.items()}
    used: dict = {}

    def first(ordered: dict, wanted, cost) -> bool:
        """Picks the unused row of least cost among the strata that are wanted."""
        best = min((x for g, rs in ordered.items() if wanted(*g) for x in ((cost(g, r), g, r) for r in rs if r.key not in used)), key=lambda x: x[0], default=None)
        if best is None or len(used) >= total:
            return False
        used[best[2].key] = best[1]
        return True

    text = lambda v: (v is not None, str(v))
    seeded = lambda g, r: (r.h, r.key)
    for k in sorted({g[0] for g in groups}, key=text):
        first(by_hash, lambda kind, domain, ok, k=k: kind == k, seeded)
    for d in sorted({g[1] for g in groups}, key=text):
        if d not in {g[1] for g in used.values()}:
            first(by_hash, lambda kind, domain, ok, d=d: domain == d, seeded)
    while sum(not g[2] for g in used.values()) < least and first(by_hash, lambda kind, domain, ok: not ok, seeded):
        pass
    while True:
        kinds, domains = Counter(g[0] for g in used.values()), Counter(g[1] for g in used.values())
        if not first(by_key, lambda *g: True, lambda g, r: (domains[g[1]] + kinds[g[0]], kinds[g[0]], r.key)):
            break
    return df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(used, 1)], f"{key} {df.schema[key].dataType.simpleString()}, pick int")
