"""Audit samples, merges of candidate families, prompts and their budgets, run gates and output diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import selection
from factloom.plans import grading

SYSTEM = "Answer from the records alone. Reply with one line: ANSWER: <value>, or ANSWER: INSUFFICIENT_EVIDENCE."


def quota_sample(df: DataFrame, key: str, strata: list[str], total: int, seed: str) -> DataFrame:
    """total rows: every stratum of the first column in turn, then of the next, rarest values first by rank within the
    stratum; the rest by hash. A row's place is its best rank over the strata, so one ordering does all passes. key tells rows
    apart. No stratum gives more than total rows, and Spark cuts them off before the shuffle."""
    rows = df.withColumn("_h", core.order_key(seed, F.col(key)))
    ranked = None
    for s in strata:
        own = selection.ranked(selection.top_by(rows, [s], total, "_h"), [s], "_rank", "_h")
        ranked = own if ranked is None else ranked.unionByName(own)
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns]), "_rank").alias("_row"), F.min("_rank").alias("_best"))
    return best.orderBy("_best", "_row._h").limit(total).select("_row.*").drop("_h")


def round_robin(df: DataFrame, group: str, kind: str, n: int, *order: Column | str) -> DataFrame:
    """n rows of each group, taking its kinds in turn."""
    df = selection.top_by(df, [group, kind], n, *order)
    within = F.row_number().over(Window.partitionBy(group, kind).orderBy(*order))
    return selection.top_by(df.withColumn("_w", within), [group], n, "_w", kind).drop("_w")


def first_per_stratum(df: DataFrame, strata: list[str], total: int, *order: Column | str) -> DataFrame:
    """The first row of each stratum, then the best of the others up to total. No stratum gives more, which Spark cuts off
    before the shuffle."""
    df = selection.top_by(df, strata, total, *order)
    r = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("_first", r == 1).orderBy(F.desc("_first"), *order).limit(total).drop("_first")


def merge_families(kept: DataFrame, offered: DataFrame, want: DataFrame, signature: Column, seed: str) -> DataFrame:
    """kept families, and of the offered ones those of new questions and signatures until (domain, question_type) has
    what want (domain, question_type, n) asks."""
    have = kept.groupBy("domain", "question_type").agg(F.count("*").alias("have"))
    fresh = offered.withColumn("_s", signature).join(kept.select("question").distinct(), "question", "left_anti").join(kept.select(signature.alias("_s")).distinct(), "_s", "left_anti")
    fresh = selection.first_by(fresh, ["_s"], "question").join(want, ["domain", "question_type"]).join(have, ["domain", "question_type"], "left")
    at = F.row_number().over(Window.partitionBy("domain", "question_type").orderBy(core.order_key(seed, F.col("question"))))
    chosen = fresh.withColumn("_k", at).filter(F.col("_k") <= F.col("n") - F.coalesce("have", F.lit(0)))
    return kept.unionByName(chosen.select(*kept.columns))


def prompt(context: Column, question: Column, system: str = SYSTEM) -> Column:
    return F.concat(F.lit(f"<|system|>\n{system}\n<|user|>\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\n<|assistant|>\n"))


def rendered(instances: DataFrame, limit: int, reserve: int) -> DataFrame:
    """Adds prompt_sha256, prompt_tokens, prompt_budget, prompt_margin."""
    text = prompt(F.col("context"), F.col("question"))
    out = instances.withColumn("prompt_sha256", F.sha2(text, 256)).withColumn("prompt_tokens", core.token_count(text)).withColumn("prompt_budget", F.lit(limit - reserve).cast("long"))
    return out.withColumn("prompt_margin", F.col("prompt_budget") - F.col("prompt_tokens"))


def rerendered(frozen: DataFrame, now: DataFrame, key: str, kinds: dict[str, str], limit: int, reserve: int) -> DataFrame:
    """now (key, context, question, question_type) rendered again, incrementally: key, status (kept, changed or new),
    question_type after reclassification by kinds, input_sha256, prompt_sha256, prompt_tokens, prompt_margin.

    frozen has the same columns of an earlier call. Only rows whose inputs have another hash than there are rendered and
    counted; the others keep what they have, but their margin follows the present limit. A prompt over its budget is an error
    that names its row."""
    raw = F.to_json(F.struct("context", "question"), {"ignoreNullFields": "false"})
    budget, was = F.lit(limit - reserve).cast("long"), F.col("question_type")
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[was], was) if kinds else was
    rows = now.withColumn("input_sha256", F.sha2(raw, 256)).withColumn("question_type", named)
    old = frozen.select(F.col(key), F.col("input_sha256").alias("_old"), F.col("prompt_sha256").alias("_sha"), F.col("prompt_tokens").alias("_tokens"))
    both = rows.join(old, key, "left")
    same = F.col("_old").eqNullSafe(F.col("input_sha256"))
    text = F.when(~same, prompt(F.col("context"), F.col("question")))  # null, so neither hashed nor counted, where nothing changed
    out = both.select(
        key, F.when(same, "kept").when(F.col("_old").isNull(), "new").otherwise("changed").alias("status"), "question_type", "input_sha256",
        F.when(same, F.col("_sha")).otherwise(F.sha2(text, 256)).alias("prompt_sha256"), F.when(same, F.col("_tokens")).otherwise(core.token_count(text)).alias("prompt_tokens"),
    )
    over = F.raise_error(F.concat(F.lit("prompt budget overflow: "), F.col(key).cast("string"), F.lit(" has "), F.col("prompt_tokens").cast("string"), F.lit(" of "), budget.cast("string"), F.lit(" tokens")))
    return out.withColumn("prompt_margin", F.when(F.col("prompt_tokens") > budget, over).otherwise(budget - F.col("prompt_tokens")))


def budget_report(frozen: DataFrame, again: DataFrame, key: str, group: str) -> DataFrame:
    """Counts again against frozen ones by group: n, mismatches, overflows, least, mean and greatest tokens, their deviation."""
    both = frozen.select(key, group, F.col("prompt_tokens").alias("stated")).join(again.select(key, "prompt_tokens", "prompt_budget"), key)
    return both.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("stated") != F.col("prompt_tokens")).alias("mismatches"), F.count_if(F.col("prompt_tokens") > F.col("prompt_budget")).alias("overflows"), F.min("prompt_tokens").alias("least"), F.avg("prompt_tokens").alias("mean"), F.max("prompt_tokens").alias("greatest"), F.stddev_samp("prompt_tokens").alias("sd"))


def gate(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """key, expected, actual of all that differs, or is on one side alone."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def answer_flags(raw: Column, n_tokens: Column, limit: int) -> Column:
    """How an output departs from one answer line: JSON, record ids, extra lines, repetition (of at least 20 words one
    stands there 12 times or more), cut off."""
    text = F.coalesce(raw, F.lit(""))
    words = F.array_sort(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_.:-]+"), F.lit(0)))
    # Equal words stand together: the longest run is the most frequent one's.
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    run = lambda a, w: F.when(w == a["last"], a["run"] + 1).otherwise(1)
    most = F.aggregate(words, start, lambda a, w: F.struct(w.alias("last"), run(a, w).alias("run"), F.greatest(a["most"], run(a, w)).alias("most")), lambda a: a["most"])
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return F.struct(core.parse_answer_line(raw).isNotNull().alias("answer_line"), text.rlike(r"[{}\[\]]").alias("json"), text.rlike(r"\bR[A-F0-9]{8,12}\b").alias("record_id"), (lines > 1).alias("extra_lines"), ((F.size(words) >= 20) & (most >= 12)).alias("repeats"), F.coalesce(n_tokens >= limit, F.lit(False)).alias("hit_limit"))


def output_structure(results: DataFrame, group: str) -> DataFrame:
    """By group: outputs, strictly valid, recovered by method, degenerate, invalid."""
    r = results.withColumn("r", grading.recovered(F.col("raw_output_text")))
    method = F.col("r.method")
    return r.groupBy(group).agg(F.count("*").alias("n"), F.count_if(method == "strict").alias("strict"), F.count_if(method.isNotNull() & (method != "strict")).alias("recovered"), F.count_if("r.degenerate").alias("degenerate"), F.count_if(method.isNull()).alias("invalid"))


def missing_by_length(instances: DataFrame, unavailable: DataFrame) -> DataFrame:
    """For each length: instances, and those unavailable by reason."""
    ok = instances.groupBy("nominal").agg(F.count("*").alias("n_instances"))
    gone = unavailable.groupBy("nominal", "status").agg(F.count("*").alias("n")).groupBy("nominal").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("unavailable"))
    return ok.join(gone, "nominal", "full_outer").select("nominal", F.coalesce("n_instances", F.lit(0)).alias("n_instances"), "unavailable")
