"""Queries of grading and statistics over the driver's tables.

Events stand for scored rows: cluster user_id, condition event_type, outcome value > 100; the first event of a user and
type counts. Conversations give (conv_id, turn) ladders, documents and labels binary outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import selection, stats
from factloom.plans import grading
from factloom.plans.registry import query
from factloom.sources import tables
from factloom.sources.envelope import read

SCORED = "scored AS (SELECT user_id, event_type, value, value > 100 AS bad FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)"
TYPES = "(SELECT DISTINCT event_type FROM events)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = selection.first_by(read(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")
    return e.select("user_id", "event_type", "value", (F.col("value") > 100).alias("bad"))


ANSWERS = """a AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ANSWER: $' || round(o_totalprice, 2) WHEN 1 THEN '  ANSWER:  ' || o_orderstatus || '  ' || o_orderpriority WHEN 2 THEN 'the answer is 5' WHEN 3 THEN 'ANSWER: INSUFFICIENT_EVIDENCE' ELSE 'ANSWER: ' || strftime(o_orderdate, '%m/%d/%Y') END AS raw,
  CASE o_orderkey % 5 WHEN 0 THEN 'NUMERIC' WHEN 4 THEN 'DATE' ELSE 'STRING' END AS kind, round(o_totalprice, 2) AS price, o_orderdate, o_orderstatus, o_orderpriority FROM orders)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    price = F.round("o_totalprice", 2)
    raw = F.when(k == 0, F.concat(F.lit("ANSWER: $"), price.cast("decimal(18,2)").cast("string"))).when(k == 1, F.concat(F.lit("  ANSWER:  "), "o_orderstatus", F.lit("  "), "o_orderpriority")).when(k == 2, F.lit("the answer is 5")).when(k == 3, F.lit("ANSWER: INSUFFICIENT_EVIDENCE")).otherwise(F.concat(F.lit("ANSWER: "), F.date_format("o_orderdate", "MM/dd/yyyy")))
    kind = F.when(k == 0, "NUMERIC").when(k == 4, "DATE").otherwise("STRING")
    return o.select("o_orderkey", raw.alias("raw"), kind.alias("kind"), price.alias("price"), "o_orderdate", "o_orderstatus", "o_orderpriority")


@query(f"WITH {ANSWERS} SELECT o_orderkey, raw LIKE '%ANSWER:%' AS valid FROM a")
def parse_answer_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C19"""
    return _answers(spark, sf_dir).select("o_orderkey", core.parse_answer_line(F.col("raw")).isNotNull().alias("valid"))


@query(f"""WITH {ANSWERS} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN 'INSUFFICIENT_EVIDENCE' ELSE kind END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN price END AS num,
  CASE o_orderkey % 5 WHEN 1 THEN lower(o_orderstatus || ' ' || o_orderpriority) WHEN 3 THEN 'insufficient_evidence' WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS txt FROM a""")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 to C17"""
    a = _answers(spark, sf_dir)
    return a.select("o_orderkey", core.normalize_answer(core.parse_answer_line(F.col("raw")), F.col("kind")).alias("n")).select("o_orderkey", "n.kind", "n.num", "n.txt")


@query(f"WITH {ANSWERS} SELECT o_orderkey, o_orderkey % 5 <> 2 AS equal FROM a")
def answers_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed answers against the gold answers of the same orders; outputs without an answer line equal nothing."""
    a, k = _answers(spark, sf_dir), F.col("o_orderkey") % 5
    gold = F.when(k == 0, F.col("price").cast("string")).when(k == 1, F.concat_ws(" ", "o_orderstatus", "o_orderpriority")).when(k == 4, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("INSUFFICIENT_EVIDENCE")
    m, g = core.normalize_answer(core.parse_answer_line(F.col("raw")), F.col("kind")), core.normalize_answer(gold, F.col("kind"))
    return a.select("o_orderkey", m.alias("m"), g.alias("g"), "kind").select("o_orderkey", core.answers_equal(F.col("m"), F.col("g"), F.col("kind"), F.lit(0.005)).alias("equal"))


LINES = "l AS (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS answer FROM lineitem)"


@query(f"WITH {LINES} SELECT l_orderkey, min(l_linenumber) AS first_line FROM l WHERE abs(l_quantity - answer) <= 0.5 GROUP BY 1")
def context_value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of a context whose value is the answer's."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    li = li.withColumn("answer", F.max("l_quantity").over(Window.partitionBy("l_orderkey")))
    return li.filter(F.abs(F.col("l_quantity") - F.col("answer")) <= 0.5).groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"))


@query("""WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) AS r FROM lineitem),
l AS (SELECT l_orderkey, max(l_quantity) AS most, max(CASE WHEN r = 1 THEN l_quantity END) AS gold FROM r GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN 'FORMAT_FAILURE' WHEN l_orderkey % 7 = 1 THEN 'UNNECESSARY_ABSTENTION' WHEN most = gold THEN 'CORRECT' ELSE 'WRONG_PERIOD' END AS error_type FROM l""")
def grade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: orders as instances; the answer is the greatest quantity, right is the first line's, the others are distractors."""
    li = selection.ranked(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey"], "l_linenumber", "l_linenumber", "l_quantity", "l_partkey")
    name = F.concat(F.lit("R"), F.col("l_linenumber").cast("string"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("display_id"), F.col("l_quantity").cast("string").alias("value")))).alias("r"), F.max("l_quantity").alias("most"), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("gold"))
    k = F.col("l_orderkey") % 7
    raw = F.when(k == 0, F.lit("no idea")).when(k == 1, F.lit("ANSWER: insufficient_evidence")).otherwise(F.concat(F.lit("ANSWER: "), F.col("most").cast("string")))
    records = F.transform("r", lambda x: F.struct(x["display_id"].alias("display_id"), x["value"].alias("value")))
    foils = F.map_from_entries(F.transform(F.filter("r", lambda x: x["l_linenumber"] > 1), lambda x: F.struct(x["display_id"], F.lit("WRONG_PERIOD"))))
    none = F.lit(None).cast("double")
    i = g.select("l_orderkey", raw.alias("raw_output_text"), records.alias("records"), foils.alias("distractors"), F.col("gold").cast("string").alias("gold_answer"), F.lit("NUMERIC").alias("answer_type"), F.lit("DIRECT_RETRIEVAL").alias("question_type"), F.lit(True).alias("answerable"), F.lit(0.0).alias("tolerance"), none.alias("raw_result"), none.alias("rounded_result"), F.lit(None).cast("int").alias("round_decimals"))
    return grading.grade_answer_only(i).select("l_orderkey", "error_type")


@query(f"WITH {SCORED} SELECT t.event_type, b.bad AS outcome, count(s.user_id)::BIGINT AS n FROM {TYPES} t CROSS JOIN (VALUES ('true'), ('false'), ('unknown')) b(bad) LEFT JOIN scored s ON s.event_type = t.event_type AND s.bad::VARCHAR = b.bad GROUP BY ALL")
def error_grid_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: every combination, zeros as well."""
    s = _scored(spark, sf_dir).select("event_type", F.col("bad").cast("string").alias("outcome"))
    types = selection.few_values(s, "event_type")
    return stats.dense_grid(s, "event_type", "outcome", types, ["true", "false", "unknown"])


@query(f"WITH {SCORED} SELECT event_type, count(*)::BIGINT AS n, count_if(bad)::BIGINT AS n_bad, avg(bad::INT) AS rate_bad FROM scored GROUP BY 1")
def rates_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, T1"""
    return stats.rates(_scored(spark, sf_dir), ["event_type"], bad=F.col("bad"))


@query("SELECT source, lang, count(*)::BIGINT AS n, count_if(toxic = 1)::BIGINT AS n_toxic, avg((toxic = 1)::INT) AS rate_toxic FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def subgroup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, T13"""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return stats.rates(d, ["source", "lang"], toxic=F.col("toxic") == 1)


@query("SELECT event_type, count(value)::BIGINT AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, sum(value) AS sum, max(value) AS max FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A7, A23, T12"""
    return stats.latency(read(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, count(*)::BIGINT AS n, min(v) AS min, max(CASE WHEN r = round_even(0.25 * (n - 1), 0) THEN v END) AS p25, max(CASE WHEN r = round_even(0.5 * (n - 1), 0) THEN v END) AS median, max(CASE WHEN r = round_even(0.75 * (n - 1), 0) THEN v END) AS p75, max(v) AS max, avg(v) AS mean FROM r GROUP BY 1""")
def describe_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4"""
    return stats.describe_nearest_rank(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")


@query("SELECT event_type, (list_sort(list(value)))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6"""
    return stats.upper_median(read(spark, sf_dir, "events"), ["event_type"], "value")


PAIRED = f"""{SCORED}, base AS (SELECT min(event_type) AS b FROM scored), pr AS (SELECT s.event_type, count(*)::BIGINT AS n_pairs, count_if(z.bad AND NOT s.bad)::BIGINT AS base_only, count_if(NOT z.bad AND s.bad)::BIGINT AS other_only
  FROM scored s JOIN scored z ON s.user_id = z.user_id AND z.event_type = (SELECT b FROM base) AND s.event_type <> z.event_type GROUP BY 1),
mc AS (SELECT *, CASE WHEN base_only + other_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(base_only, other_only) + 1), lambda i: exp(lgamma(base_only + other_only + 1) - lgamma(i + 1) - lgamma(base_only + other_only - i + 1) - (base_only + other_only) * ln(2))))) END::DOUBLE AS p FROM pr)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    base = s.agg(F.min("event_type")).first()[0]
    return stats.discordant(s, "user_id", "event_type", F.col("bad"), base)


@query(f"WITH {PAIRED} SELECT event_type, n_pairs, base_only, other_only, round(p, 9) AS p FROM mc")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3"""
    return _paired(spark, sf_dir).withColumn("p", F.round("p", 9))


@query(f"""WITH {PAIRED}, h AS (SELECT event_type, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, event_type) + 1)) AS s FROM mc)
SELECT event_type, round(p, 9) AS p, round(max(s) OVER (ORDER BY p, event_type ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM h""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, W16"""
    return stats.holm(_paired(spark, sf_dir), "p").select("event_type", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


_WRAP = 1 << 64
_STEPS = [f"x1 AS (SELECT event_type, rep, num, den, (key::UHUGEINT + rep::UHUGEINT * {stats.GOLDEN}) % {_WRAP} AS x0 FROM c, range(0, 10000) r(rep))"]
for _i, (_shift, _factor) in enumerate(zip((30, 27), stats.MIX)):
    _STEPS.append(f"x{_i + 2} AS (SELECT event_type, rep, num, den, (xor(x{_i}, x{_i} >> {_shift}) * {_factor}) % {_WRAP} AS x{_i + 1} FROM x{_i + 1})")


@query(f"""WITH {SCORED}, c AS (SELECT event_type, ('0x' || substr(md5('boot|' || user_id), 1, 15))::BIGINT AS key, count_if(bad) AS num, count(*) AS den FROM scored GROUP BY event_type, user_id), {', '.join(_STEPS)},
d AS (SELECT event_type, rep, num, den, xor(x2, x2 >> 31) >> 32 AS u FROM x3), w AS (SELECT event_type, rep, num, den, {' + '.join(f'(u >= {e})::INT' for e in stats.EDGES)} AS w FROM d),
e AS (SELECT event_type, rep, sum(num * w) / nullif(sum(den * w), 0) AS rate FROM w GROUP BY ALL)
SELECT event_type, (SELECT sum(num) / sum(den) FROM c WHERE c.event_type = e.event_type) AS rate, quantile_cont(rate, 0.025) AS low, quantile_cont(rate, 0.975) AS high FROM e GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster bootstrap of rates, 10,000 repetitions."""
    return stats.bootstrap(_scored(spark, sf_dir), "user_id", "event_type", F.col("bad"))


@query(f"""WITH {SCORED}, k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS r FROM {TYPES}), s AS (SELECT u.user_id, string_agg(coalesce(s.bad::INT::VARCHAR, '-'), '' ORDER BY k.r) AS states FROM (SELECT DISTINCT user_id FROM scored) u CROSS JOIN k LEFT JOIN scored s ON s.user_id = u.user_id AND s.event_type = k.event_type GROUP BY 1)
SELECT user_id, states, CASE WHEN states LIKE '%-%' THEN 'missing' WHEN states NOT LIKE '%1%' THEN 'never' WHEN states NOT LIKE '%0%' THEN 'always' WHEN regexp_full_match(states, '0+1+') THEN 'first_at_' || (instr(states, '1') - 1) ELSE 'non_monotonic' END AS klass FROM s""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each cluster along the ladder of conditions."""
    s = _scored(spark, sf_dir)
    types = selection.few_values(s, "event_type")
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1
    return stats.transitions(s.withColumn("rank", rank), "user_id", "rank", F.col("bad"), len(types))


@query(f"WITH {SCORED} SELECT user_id, event_type, value FROM scored WHERE user_id IN (SELECT user_id FROM scored GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(*) FROM {TYPES}))")
def complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with every condition."""
    s = _scored(spark, sf_dir)
    n = s.select("event_type").distinct().count()
    whole = F.count("*").over(Window.partitionBy("user_id"))
    return s.withColumn("n", whole).filter(F.col("n") == n).select("user_id", "event_type", "value")


@query("""WITH a AS (SELECT user_id, event_type, arg_min(value, event_id) > 50 AS x FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, arg_max(value, event_id) > 50 AS x FROM events GROUP BY ALL)
SELECT event_type, count(*)::BIGINT AS n, count_if(a.x = b.x)::BIGINT AS agree, count_if(a.x AND NOT b.x)::BIGINT AS lost, count_if(NOT a.x AND b.x)::BIGINT AS won FROM a JOIN b USING (user_id, event_type) GROUP BY 1""")
def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old and a new run, joined on their common ids."""
    e = read(spark, sf_dir, "events")
    run = lambda pick, name: e.groupBy("user_id", "event_type").agg((pick("value", "event_id") > 50).alias(name))
    return selection.agreement(run(F.min_by, "a"), run(F.max_by, "b"), ["user_id", "event_type"], "a", "b", ["event_type"])


@query("SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN -1 ELSE quality END AS quality FROM labels")
def override_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual decisions replace what rules left open."""
    la = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    changes = la.filter("toxic = 1 and quality = 0").select("doc_id", F.lit(-1).cast(la.schema["quality"].dataType).alias("quality"))
    return selection.override(la, changes, "doc_id", "quality", F.col("toxic") == 1).select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do."""
    return selection.pending(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT 'log_log' AS model, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 8) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 8) AS intercept, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 8) AS r2 FROM lineitem UNION ALL SELECT 'linear', round(regr_slope(l_extendedprice, l_quantity), 8), round(regr_intercept(l_extendedprice, l_quantity), 6), round(regr_r2(l_extendedprice, l_quantity), 8) FROM lineitem")
def ols_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear and log-log least squares, both from one pass each of cross-products."""
    li = read(spark, sf_dir, "lineitem")
    rows = []
    for name, f, digits in (("log_log", F.ln, 8), ("linear", lambda c: F.col(c), 6)):
        fit = stats.ols(li, f("l_extendedprice"), {"x": f("l_quantity")})
        rows.append((name, round(fit["x"], 8), round(fit["intercept"], digits), round(fit["r2"], 8)))
    return spark.createDataFrame(rows, "model string, slope double, intercept double, r2 double")


@query()
def gee_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchangeable logistic GEE of the outcome on the condition's rank."""
    s = _scored(spark, sf_dir)
    types = selection.few_values(s, "event_type")
    d = s.select("user_id", F.col("bad").cast("double").alias("y"), F.array_position(F.array(*map(F.lit, types)), F.col("event_type")).cast("double").alias("rank"))
    fit = stats.gee_logit(d, "user_id", "y", ["rank"])
    return spark.createDataFrame([tuple(r) for r in fit.itertuples(index=False)], "name string, " + ", ".join(f"{c} double" for c in fit.columns[1:]))


def _with_wald(spark: SparkSession, fit, names: list[str]) -> DataFrame:
    """A fit's rows, and one for the joint test of the named coefficients: chi-squared as coef, its freedom as se. What the
    data don't tell is null."""
    chi, freedom, p = stats.wald(fit, names)
    rows = [(r.name, r.coef, r.se, r.p) for r in fit[["name", "coef", "se", "p"]].itertuples(index=False)]
    return spark.createDataFrame([*rows, ("joint", chi, float(freedom), p)], "name string, coef double, se double, p double")


@query()
def gee_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coefficient for each condition against the first, and their joint Wald test."""
    s = _scored(spark, sf_dir)
    types = selection.few_values(s, "event_type")
    d, names = stats.dummies(s.select("user_id", F.col("bad").cast("double").alias("y"), "event_type"), "event_type", types[0], types)
    return _with_wald(spark, stats.gee_logit(d, "user_id", "y", names), names)


@query()
def gee_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions by halves of the users, and the joint Wald test of the interactions."""
    s = _scored(spark, sf_dir)
    types = selection.few_values(s, "event_type")
    d = s.select("user_id", F.col("bad").cast("double").alias("y"), "event_type", (F.col("user_id") % 2).cast("double").alias("odd"))
    d, names = stats.dummies(d, "event_type", types[0], types)
    d, both = stats.interactions(d, names, ["odd"])
    return _with_wald(spark, stats.gee_logit(d, "user_id", "y", [*names, "odd", *both]), both)


@query()
def gee_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a high value is very high, among the high ones, by condition, and the joint Wald test."""
    s = _scored(spark, sf_dir)
    types = selection.few_values(s, "event_type")
    fit, names = stats.composition(s.withColumn("y", F.col("bad").cast("double")), "user_id", "y", F.col("value") > 50, "event_type", types[0], types)
    return _with_wald(spark, fit, names)


@query(f"""WITH {SCORED}, c AS (SELECT user_id, count(DISTINCT event_type) AS k FROM scored GROUP BY 1), s AS (SELECT s.*, k, unnest(list_filter(['all', CASE WHEN k = (SELECT count(*) FROM {TYPES}) THEN 'complete' END, CASE WHEN value > 10 THEN 'answerable' END, CASE WHEN user_id <= 25 THEN 'original' ELSE 'added' END], lambda x: x IS NOT NULL)) AS subset FROM scored s JOIN c USING (user_id))
SELECT subset, event_type, count(*)::BIGINT AS n, count_if(bad)::BIGINT AS n_bad, avg(bad::INT) AS rate_bad FROM s GROUP BY ALL""")
def sensitivity_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by condition for all rows, complete clusters, answerable rows, and original and added families."""
    s = _scored(spark, sf_dir).withColumn("family", F.concat(F.lit("U_"), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    original = core.family_number(F.col("family")) <= 25
    return stats.sensitivity(s, "user_id", "event_type", selection.few_values(s, "event_type"), {"answerable": F.col("value") > 10, "original": original, "added": ~original}, bad=F.col("bad"))


@query(f"""WITH {SCORED}, k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS r FROM {TYPES}), m AS (SELECT 'model_' || user_id % 3 AS model, r, bad FROM scored JOIN k USING (event_type))
SELECT model, count(*)::BIGINT AS n, {', '.join(f'avg(bad::INT) FILTER (WHERE r = {i}) AS rate_{i}' for i in range(5))}, avg(bad::INT) FILTER (WHERE r = 4) - avg(bad::INT) FILTER (WHERE r = 0) AS delta FROM m GROUP BY 1""")
def model_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by conditions, and how far the last one is from the first."""
    s = _scored(spark, sf_dir).withColumn("model", F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")))
    return stats.by_model(s, "model", "event_type", selection.few_values(s, "event_type"), F.col("bad"))


@query("""SELECT doc_id, CASE WHEN len(text) > 0 THEN log2(len(text)::DOUBLE) END AS log2_chars, (doc_id % 40)::INT AS number, doc_id % 40 <= 25 AS original FROM documents""")
def log2_and_family_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logarithm of a length, and the number of a family's id against the first families' last one."""
    d = read(spark, sf_dir, "documents")
    number = core.family_number(F.concat(F.lit("DOC_X_"), F.lpad((F.col("doc_id") % 40).cast("string"), 4, "0")))
    return d.select("doc_id", core.log2_tokens(F.char_length("text")).alias("log2_chars"), number.alias("number"), (number <= 25).alias("original"))


_PARTS = " || '|' || ".join(f"coalesce(sum(('0x' || substr(h, {1 + 13 * i}, 13))::HUGEINT), 0)" for i in range(5))


@query(f"""SELECT sha256(count(*) || '|' || {_PARTS}) AS digest FROM (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":' || coalesce('"' || o_orderstatus || '"', 'null') || '}}') AS h FROM orders)""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's hash, whatever the order of its rows and the values of its volatile columns."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumns({c: F.rand() for c in tables.VOLATILE})
    return spark.createDataFrame([(tables.content_hash(o),)], "digest string")


@query("SELECT doc_id, CASE WHEN n_l IS NULL THEN 'missing' WHEN n_d IS NULL THEN 'extra' WHEN n_l > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM (SELECT doc_id, count(*) AS n_d FROM documents GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS n_l FROM labels GROUP BY 1) x(doc_id, n_l) USING (doc_id)")
def chk_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against seen rows."""
    return selection.accounting(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A11"""
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return o.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def provenance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted id lists by source."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(ids.alias("ids"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 2 WHEN p_size > 25 THEN 1 ELSE 0 END::INT AS n_leaks FROM part")
def question_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, Z: wordings that give away answerability, in questions made of part names."""
    more = F.when(F.col("p_size") > 40, " rather than a guess; do not fabricate it").when(F.col("p_size") > 25, " rather than a guess").otherwise("")
    question = F.concat(F.lit("What size is "), "p_brand", more)
    return read(spark, sf_dir, "part").select("p_partkey", F.size(core.leaks(question)).alias("n_leaks"))
