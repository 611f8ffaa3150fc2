"""Statistics over scored rows: rates, percentiles, paired tests, bootstrap, transitions, regressions.

Rows are reduced to small sufficient tables by Spark (per cluster and condition, cross-products of columns); only those
of fixed size come to the driver."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.core import rank_key
from factloom.operators.selection import few_values


def _distinct_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, times, first and last rank (from 0) of its rows, n: equal values are summed up before they are ranked."""
    at = Window.partitionBy(*keys)
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times"))
    last = F.sum("times").over(at.orderBy(value)) - 1
    return v.withColumn("last", last).withColumn("first", F.col("last") - F.col("times") + 1).withColumn("_n", F.sum("times").over(at))


def describe_nearest_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, p25, median, p75, max, mean; a percentile is the value at rank round(p * (n - 1)), halves to even."""
    v = _distinct_values(df, keys, value)

    def pick(p: float) -> Column:
        rank = F.bround(F.lit(p) * (F.col("_n") - 1))
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col(value)))

    return v.groupBy(*keys).agg(F.sum("times").alias("n"), F.min(value).alias("min"), pick(0.25).alias("p25"), pick(0.5).alias("median"), pick(0.75).alias("p75"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("mean"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v, middle = _distinct_values(df, keys, value), F.floor(F.col("_n") / 2)
    return v.groupBy(*keys).agg(F.max(F.when((F.col("first") <= middle) & (middle <= F.col("last")), F.col(value))).alias("upper_median"))


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, median, p90, p95, p99 (interpolated), sum and max."""
    p = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.sum(value).alias("sum"), F.max(value).alias("max"))


def rates(df: DataFrame, keys: list[str], **outcomes: Column) -> DataFrame:
    """n, and for each outcome its count and rate."""
    parts = [x for name, c in outcomes.items() for x in (F.count_if(c).alias(f"n_{name}"), F.avg(c.cast("int")).alias(f"rate_{name}"))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def dense_grid(df: DataFrame, a: str, b: str, a_values: list[str], b_values: list[str]) -> DataFrame:
    """Counts of every combination, zeros as well. The values are closed lists."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} string, {b} string")
    return grid.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def _stirling_error(x: Column) -> Column:
    """ln x! less Stirling's (x + 1/2) ln x - x + ln(2 pi) / 2, for x from 1 on."""
    table = [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)]
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.when(x < 16, F.element_at(F.array(*map(F.lit, table)), F.greatest(x, F.lit(1.0)).cast("int"))).otherwise(series)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs, twice the binomial tail.

    The tail's greatest term by its saddle-point form, whose parts don't cancel, times a sum of running quotients: they fall
    off like a normal curve, so some multiples of the root of the number of pairs are all that count."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    apart = (n - 2 * k) / n
    distance = k * F.log1p(-apart) + (n - k) * F.log1p(apart)
    saddle = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - distance - 0.5 * F.ln(2 * math.pi * k * (n - k) / n)
    greatest = F.when(k == 0, -n * math.log(2.0)).otherwise(saddle)
    terms = F.least(k, F.ceil(6 * F.sqrt(n)) + 64).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i + 1) / (n - k + i)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    rest = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(greatest) * rest))


def discordant(df: DataFrame, cluster: str, condition: str, outcome: Column, base: str) -> DataFrame:
    """condition, n_pairs, base_only, other_only, p: each condition against base over clusters that have both."""
    one = df.groupBy(cluster, condition).agg(F.max(outcome.cast("int")).alias("y"))
    first = one.filter(F.col(condition) == base).select(cluster, F.col("y").alias("y0"))
    both = one.filter(F.col(condition) != base).join(first, cluster)
    out = both.groupBy(condition).agg(F.count("*").alias("n_pairs"), F.count_if((F.col("y0") == 1) & (F.col("y") == 0)).alias("base_only"), F.count_if((F.col("y0") == 0) & (F.col("y") == 1)).alias("other_only"))
    return out.withColumn("p", mcnemar_p(F.col("base_only"), F.col("other_only")))


def holm(df: DataFrame, p: str, keys: list[str] | None = None) -> DataFrame:
    """Adds p_holm: step-down adjusted values, monotone; null p are left out of the family."""
    at = Window.partitionBy(*(keys or []), F.col(p).isNotNull())
    r = df.withColumn("_r", F.row_number().over(at.orderBy(p))).withColumn("_m", F.count(p).over(at))
    step = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_r") + 1))
    return r.withColumn("_s", step).withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("_s").over(at.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))).drop("_r", "_m", "_s")


# Multipliers and increment of the splitmix64 generator.
MIX, GOLDEN = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), 0x9E3779B97F4A7C15
#: The upper 32 bits from which on a Poisson(1) draw is 1, 2 and so on, up to 8.
EDGES = [math.ceil(e * 2**32) for e in accumulate(math.exp(-1) / math.factorial(k) for k in range(8))]
#: Clusters of a partition, where there are many, and repetitions of a block, in bootstraps.
CLUSTERS, BLOCK = 200_000, 500


def poisson_draws(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Poisson(1) draws of each key in each repetition, from the counter key + rep * GOLDEN mixed to 64 bits: its upper half
    against the distribution's sums. No state, so draws are the same wherever they are made."""
    x = keys.astype(np.uint64)[:, None] + reps.astype(np.uint64)[None, :] * np.uint64(GOLDEN)
    for shift, factor in zip((30, 27), MIX):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(u.shape, np.uint8)
    for edge in EDGES:
        out += u >= np.uint32(edge)
    return out


def bootstrap(df: DataFrame, cluster: str, condition: str, outcome: Column, reps: int = 10_000, seed: str = "boot") -> DataFrame:
    """condition, rate, low, high: percentile interval of the rate under resampling of clusters.

    A cluster's number of draws in a repetition is Poisson(1) by its key (the limit of the multinomial draw for many
    clusters), so repetitions need no list of clusters and each cluster's row is drawn where it lies. Clusters are first
    summed by condition; a task multiplies the matrices of its clusters' sums and draws, a block of repetitions at a
    time, and gives a row for each condition and repetition. Rows without a cluster or a condition are left out."""
    own = df.filter(F.col(cluster).isNotNull() & F.col(condition).isNotNull()).groupBy(cluster, condition).agg(F.count("*").alias("den"), F.count_if(outcome).alias("num"))
    keyed = own.select(F.col(condition).cast("string").alias("condition"), rank_key(seed, F.col(cluster)).alias("key"), "den", "num")

    def run(batches):
        totals: dict[str, np.ndarray] = {}  # of each condition: numerators and denominators by repetition
        for batch in batches:
            pdf = batch.to_pandas()
            names, at = np.unique(pdf["condition"].to_numpy(dtype=object).astype(str), return_inverse=True)
            keys, place = np.unique(pdf["key"].to_numpy(), return_inverse=True)
            sums = np.zeros((2 * len(names), len(keys)))
            np.add.at(sums, (2 * at, place), pdf["num"].to_numpy(np.float64))
            np.add.at(sums, (2 * at + 1, place), pdf["den"].to_numpy(np.float64))
            for first in range(0, reps, BLOCK):
                numbers = np.arange(first, min(first + BLOCK, reps))
                out = sum(sums[:, i : i + 2048] @ poisson_draws(keys[i : i + 2048], numbers).astype(np.float64) for i in range(0, len(keys), 2048))
                for k, name in enumerate(names):
                    totals.setdefault(str(name), np.zeros((2, reps)))[:, first : first + len(numbers)] += out[2 * k : 2 * k + 2]
        for name, (num, den) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * reps, pa.string()), pa.array(np.arange(reps), pa.int32()), pa.array(num), pa.array(den)], ["condition", "rep", "num", "den"])

    spark, n = df.sparkSession, keyed.select("key").distinct().count()
    # Few tasks, as each gives a row for each condition and repetition, but enough to share the draws.
    parts = max(1, -(-n // CLUSTERS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 500))
    drawn = keyed.repartition(parts, "key").mapInArrow(run, "condition string, rep int, num double, den double")
    each = drawn.groupBy("condition", "rep").agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0.0))).alias("rate"))
    ends = each.groupBy(F.col("condition").alias("_name")).agg(F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"))
    point = own.groupBy(condition).agg((F.sum("num") / F.sum("den")).alias("rate"))
    return point.join(ends, F.col(condition).cast("string") == F.col("_name"), "left").select(condition, "rate", "low", "high")


def transitions(df: DataFrame, cluster: str, rank: str, outcome: Column, ladder: int) -> DataFrame:
    """cluster, states (one of 1, 0, - for each rung), klass: missing, never, always, first_at_k or non_monotonic."""
    one = df.groupBy(cluster, rank).agg(F.max(outcome.cast("int")).alias("y"))
    m = one.groupBy(cluster).agg(F.map_from_entries(F.collect_list(F.struct(F.col(rank).cast("int"), "y"))).alias("m"))
    states = F.transform(F.sequence(F.lit(0), F.lit(ladder - 1)), lambda i: F.coalesce(F.try_element_at("m", i).cast("string"), F.lit("-")))
    s = F.array_join(states, "")
    klass = F.when(s.contains("-"), "missing").when(~s.contains("1"), "never").when(~s.contains("0"), "always").when(s.rlike("^0+1+$"), F.concat(F.lit("first_at_"), (F.instr(s, "1") - 1).cast("string"))).otherwise("non_monotonic")
    return m.select(cluster, s.alias("states"), klass.alias("klass"))


def ols(df: DataFrame, y: Column, xs: dict[str, Column]) -> dict[str, float]:
    """Least squares by normal equations: one aggregation of cross-products, solved on the driver. Adds r2 and n."""
    names = ["intercept", *xs]
    cols = {"intercept": F.lit(1.0), **xs, "y": y}
    data = df.select(*[c.cast("double").alias(n) for n, c in cols.items()]).dropna()
    pairs = [(a, b) for i, a in enumerate(cols) for b in list(cols)[i:]]
    row = data.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]).first()
    at = lambda a, b: row[f"{a}*{b}"] if f"{a}*{b}" in row else row[f"{b}*{a}"]
    xx, xy = np.array([[at(a, b) for b in names] for a in names]), np.array([at(a, "y") for a in names])
    beta = np.linalg.solve(xx, xy)
    n, sy = at("intercept", "intercept"), at("intercept", "y")
    rest = at("y", "y") - beta @ xy
    return dict(zip(names, beta.tolist())) | {"r2": float(1 - rest / (at("y", "y") - sy**2 / n)), "n": float(n)}


def gee_logit(df: DataFrame, cluster: str, y: str, xs: list[str], exchangeable: bool = True, steps: int = 50, tol: float = 1e-8) -> pd.DataFrame:
    """name, coef, se, z, p, odds_ratio, low, high: logistic GEE with sandwich errors; attrs has alpha (the common
    correlation), scale, converged and separated (names).

    Rows stand sorted by cluster; each step sums the clusters' score and information matrices in segments of batches, and
    then over tasks in Spark; a few numbers come to the driver, which takes the Newton step and updates the common
    correlation: products of residuals, over pairs less the number of coefficients and over the scale (squared residuals
    over rows less the coefficients).

    Where data don't tell a coefficient (a group whose outcomes are all alike, columns that depend on each other) the
    information has a direction of next to nothing: all coefficients with a part in it are null, the others keep their
    values. A fit that has not settled after steps gives nulls alone."""
    names, k = ["intercept", *xs], len(xs) + 1
    data = df.select(F.xxhash64(cluster, F.col(cluster).cast("string")).alias("_c"), F.col(y).cast("double").alias("_y"), *[F.col(f"`{x}`").cast("double").alias(x) for x in xs]).dropna()
    data = data.repartition("_c").sortWithinPartitions("_c").persist()
    size = k + 2 * k * k + 4

    def sums(beta: np.ndarray, alpha: float) -> np.ndarray:
        def add(c: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
            """The sums over whole clusters, whose rows stand together."""
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            n = np.diff(np.append(first, len(c)))
            total = lambda z: np.add.reduceat(z, first, axis=0)
            mu = 1 / (1 + np.exp(-(x @ beta)))
            v = np.maximum(mu * (1 - mu), 1e-10)
            e, w = (y - mu) / np.sqrt(v), x * np.sqrt(v)[:, None]
            # inverse of (1 - a) I + a J in closed form
            share = alpha / (1 + (n - 1) * alpha)
            inner = lambda z: (z - np.repeat(share[:, None] * total(z), n, axis=0)) / (1 - alpha)
            u = total(w * inner(e[:, None]))
            return np.concatenate([u.sum(axis=0), (w.T @ inner(w)).ravel(), (u.T @ u).ravel(), [(total(e) ** 2 - total(e * e)).sum() / 2, (n * (n - 1)).sum() / 2, len(c), (e * e).sum()]])

        def run(batches):
            held, out = None, np.zeros(size)
            for batch in batches:
                cols = [batch.column(i).to_numpy() for i in range(len(xs) + 2)]
                rows = cols[0], cols[1], np.column_stack([np.ones(batch.num_rows), *cols[2:]])
                if held is not None:
                    rows = tuple(np.concatenate(p) for p in zip(held, rows))
                last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # where the last cluster begins
                if last:
                    out += add(*(r[:last] for r in rows))
                held = tuple(r[last:] for r in rows)
            if held is not None and len(held[0]):
                out += add(*held)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], [f"c{i}" for i in range(size)])

        each = data.mapInArrow(run, ", ".join(f"c{i} double" for i in range(size)))
        return np.array(each.agg(*[F.sum(f"c{i}") for i in range(size)]).first(), float)

    beta, alpha, scale, converged, known = np.zeros(k), 0.0, 1.0, False, np.ones(k, bool)
    try:
        for _ in range(steps):
            s = sums(beta, alpha)
            info, pairs, n = s[k : k + k * k].reshape(k, k), s[-3], s[-2]
            known, inverse = identified(info)
            step = inverse @ s[:k]
            scale = s[-1] / max(n - k, 1)
            # Correlations below -1 / (m - 1) are none for clusters of m rows.
            now = float(np.clip(s[-4] / scale / max(pairs - k, 1), -0.9, 0.95)) if exchangeable and scale > 0 and pairs > k else 0.0
            beta = np.clip(beta + step, -LARGE, LARGE)
            known = known & (np.abs(beta) < LARGE)
            moved, alpha = max(np.abs(step[known]).max(initial=0), abs(now - alpha)), now
            if moved < tol or n == 0:
                converged = n > 0
                break
        s = sums(beta, alpha)
    finally:
        data.unpersist()
    known, bread = identified(s[k : k + k * k].reshape(k, k))
    known = known & (np.abs(beta) < LARGE) & converged
    covariance = bread @ s[k + k * k : k + 2 * k * k].reshape(k, k) @ bread
    se = np.sqrt(np.maximum(np.diag(covariance), 0))
    known = known & (se > 0) & np.isfinite(se)
    z = np.divide(beta, se, out=np.zeros(k), where=known)
    with np.errstate(over="ignore"):
        columns = {"coef": beta, "se": se, "z": z, "p": np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z]), "odds_ratio": np.exp(beta), "low": np.exp(beta - 1.959963984540054 * se), "high": np.exp(beta + 1.959963984540054 * se)}
    out = pd.DataFrame({"name": names} | {c: pd.Series([float(x) if ok else None for x, ok in zip(v, known)], dtype=float if known.all() else object) for c, v in columns.items()})
    out.attrs.update(alpha=alpha, scale=scale, covariance=covariance, converged=bool(converged), separated=[n for n, ok in zip(names, known) if not ok])
    return out


#: Coefficients of this size mean odds that no data tell; directions of less than FLAT of the information's greatest one are none.
LARGE, FLAT = 15.0, 1e-7


def identified(info: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which coefficients the information tells, its inverse over the directions that it has)."""
    own = np.sqrt(np.maximum(np.diag(info), 1e-300))
    values, vectors = np.linalg.eigh(info / np.outer(own, own))  # of one scale, so that rare groups aren't taken for none
    kept = values > FLAT * max(values.max(initial=0), 1e-300)
    told = (np.abs(vectors[:, ~kept]) < 1e-3).all(axis=1) & (own**2 > FLAT * (own**2).max(initial=0))
    half = vectors[:, kept] / np.sqrt(values[kept])
    return told, (half @ half.T) / np.outer(own, own)


def dummies(df: DataFrame, column: str, base, values: list | None = None) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each value but base of a column of few values, and their names."""
    values = [v for v in (few_values(df, column) if values is None else values) if v is not None and v != base]
    names = [f"{column}={v}" for v in values]
    return df.select("*", *[(F.col(column) == v).cast("double").alias(n) for v, n in zip(values, names)]), names


def interactions(df: DataFrame, left: list[str], right: list[str]) -> tuple[DataFrame, list[str]]:
    """df with the products of all columns of left and right, and their names."""
    names = [f"{a}:{b}" for a in left for b in right]
    return df.select("*", *[(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}:{b}") for a in left for b in right]), names


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by the series or the continued fraction of the incomplete gamma."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * lead
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def wald(fit: pd.DataFrame, names: list[str]) -> tuple[float | None, int, float | None]:
    """(chi-squared, degrees of freedom, p) of the joint test that the named coefficients are zero; of those that the data
    tell nothing about it has nothing to say, and without any others it is null."""
    at = [i for i in (fit["name"].tolist().index(n) for n in names) if fit["coef"].iloc[i] is not None]
    if not at:
        return None, 0, None
    b, cov = fit["coef"].to_numpy()[at].astype(float), fit.attrs["covariance"][np.ix_(at, at)]
    chi = float(b @ np.linalg.pinv(cov, hermitian=True) @ b)
    rank = int(np.linalg.matrix_rank(cov, hermitian=True))
    return chi, rank, chi2_sf(chi, rank)


def composition(df: DataFrame, cluster: str, outcome: str, among: Column, condition: str, base, values: list | None = None) -> tuple[pd.DataFrame, list[str]]:
    """(the logistic GEE of outcome on the conditions against base among the rows that hold, names of its coefficients): how what
    went wrong is made up, rather than how often."""
    coded, names = dummies(df.filter(F.coalesce(among, F.lit(False))), condition, base, values)
    return gee_logit(coded, cluster, outcome, names), names


def sensitivity(df: DataFrame, cluster: str, condition: str, conditions: list, subsets: dict[str, Column], **outcomes: Column) -> DataFrame:
    """subset, condition, n, and n_ and rate_ of each outcome, for all rows, for clusters that have every condition, and for each
    named subset of rows. A row is read once, whatever the number of subsets."""
    own = df.groupBy(cluster).agg(F.countDistinct(F.when(F.col(condition).isin(*conditions), F.col(condition))).alias("_seen"))
    whole = {"all": F.lit(True), "complete": F.col("_seen") == len(conditions), **subsets}
    names = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in whole.items()]))
    rows = df.join(own, cluster).withColumn("subset", F.explode(names))
    return rates(rows, ["subset", condition], **outcomes)


def by_model(df: DataFrame, model: str, condition: str, conditions: list, outcome: Column) -> DataFrame:
    """model, n, rate_0 and so on for each condition in order, delta: the last condition's rate less the first one's. Conditions
    that a model has no rows of are null."""
    rate = lambda c: F.avg(F.when(F.col(condition) == c, outcome.cast("double")))
    out = df.groupBy(model).agg(F.count("*").alias("n"), *[rate(c).alias(f"rate_{i}") for i, c in enumerate(conditions)])
    return out.withColumn("delta", F.col(f"rate_{len(conditions) - 1}") - F.col("rate_0"))
