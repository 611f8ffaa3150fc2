"""The thirty data-quality checks, each a table of violations (key, problem), and their report.

Tables (DataFrames by name):
  facts       record_id, domain, entity_id, concept, unit, period, version, value [, label, family, variant]
  families    family_id, domain, question, question_type, template, answerable, gold_answer, gold_num, answer_type, unit,
              tolerance, gold_ids, provenance_ids, metadata (map), operation, operand_ids (map role -> record_id),
              operands (map role -> double), stated_result, conditions (array of structs of the five keys), aliases,
              missing_entity, missing_period, version_required
  instances   family_id, nominal, label, question, gold_answer, gold_ids, record_ids, display_ids, context, gold_block,
              tokens, relative_position, parent_nominal, prompt_tokens, prompt_budget, gold_display_ids
  placements  family_id, nominal, record_id, side, position, tier, flags
  unavailable family_id, nominal, status
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import calc, conditions, distractors, selection
from factloom.sources.shared import kept

Tables = dict[str, DataFrame]
CHECKS: dict[str, tuple[str, str, Callable[[Tables], DataFrame]]] = {}
# Fixed values.
QUESTION_TYPES = ("DIRECT_RETRIEVAL", "RETRIEVAL_CALCULATION", "TEMPORAL_VERSION", "ENTITY_UNIT_BINDING", "UNANSWERABLE")
VERSION_TEMPLATES = ("SEC_QUARTER_VS_ANNUAL_FRAME", "SEC_FILING_VERSION_SELECTION", "FDA_ORIGINAL_VS_SUPPLEMENT", "FRED_VINTAGE_SELECTION", "WB_TEMPORAL_MAX_YEAR")
CAP = 25


def check(check_id: str, name: str, severity: str = "error"):
    def add(f):
        CHECKS[check_id] = (name, severity, f)
        return f

    return add


def _bad(df: DataFrame, key: Column | str, problem: str | Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.cast("string").alias("key"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))


def _inst(df: DataFrame) -> Column:
    return F.concat_ws("_", F.col("family_id"), F.col("label"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


@check("A", "unique ids, no orphans")
def unique_ids(t: Tables) -> DataFrame:
    orphans = t["instances"].join(t["families"], "family_id", "left_anti")
    return _union(_bad(_duplicates(t["families"], "family_id"), "family_id", "duplicate family"), _bad(_duplicates(t["instances"], "family_id", "nominal", "label"), _inst(t["instances"]), "duplicate instance"), _bad(orphans, _inst(orphans), "no such family"))


@check("B", "unique questions")
def unique_questions(t: Tables) -> DataFrame:
    return _bad(_duplicates(t["families"].withColumn("question", F.trim("question")), "domain", "question"), "question", "question asked twice")


@check("C", "provenance")
def provenance(t: Tables) -> DataFrame:
    f = t["families"]
    lost = F.size(F.array_except("gold_ids", F.coalesce("provenance_ids", F.array().cast("array<string>")))) > 0
    return _union(_bad(f.filter("answerable").filter(lost), "family_id", "gold records without provenance"), _bad(f.filter(F.coalesce(F.size("metadata"), F.lit(0)) <= 0), "family_id", "no metadata"))


def _operand_values(t: Tables) -> DataFrame:
    """family_id, operands and units as the facts have them."""
    # A family that stands there twice is check A's matter.
    o = t["families"].filter("operation is not null").dropDuplicates(["family_id"]).select("family_id", F.explode("operand_ids").alias("role", "record_id"))
    v = o.join(t["facts"].select("record_id", "value", "unit"), "record_id", "left")
    return v.groupBy("family_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "value"))).alias("actual"), F.collect_set(F.coalesce("unit", F.lit(""))).alias("units"), F.count_if(F.col("value").isNull()).alias("n_lost"))


@check("D", "gold answers recompute")
def recompute(t: Tables) -> DataFrame:
    f = t["families"].join(_operand_values(t), "family_id", "left")
    again = calc.result(F.col("operation"), F.col("actual"))
    tol = F.greatest(F.coalesce("tolerance", F.lit(0.0)), F.lit(1e-9))
    calcs = f.filter("operation is not null and n_lost = 0")
    drift = F.exists(F.map_entries("operands"), lambda e: ~F.coalesce(core.same_value(e["value"], F.try_element_at("actual", e["key"])), F.lit(False)))
    direct = t["families"].filter("answerable and operation is null and question_type = 'DIRECT_RETRIEVAL' and gold_num is not null").select("family_id", "gold_num", "tolerance", F.get("gold_ids", F.lit(0)).alias("record_id")).join(t["facts"].select("record_id", "value"), "record_id")
    return _union(_bad(calcs.filter(again.isNull() | (F.abs(again - F.col("gold_num")) > tol)), "family_id", "gold differs from the recomputed result"), _bad(calcs.filter(drift), "family_id", "operands differ from the facts"), _bad(direct.filter(F.abs(F.col("value") - F.col("gold_num")) > tol), "family_id", "gold differs from the fact"))


@check("E", "gold present")
def gold_present(t: Tables) -> DataFrame:
    i = t["instances"]
    return _bad(i.filter(F.size(F.array_except("gold_ids", "record_ids")) > 0), _inst(i), "gold records are not in the context")


@check("F", "unanswerable contexts hold no gold")
def gold_absent(t: Tables) -> DataFrame:
    i = t["instances"].join(t["families"].filter("not answerable").select("family_id", F.col("gold_ids").alias("own")), "family_id")
    return _bad(i.filter(F.arrays_overlap("record_ids", "own") | (F.size("gold_ids") > 0)), _inst(i), "gold records of an unanswerable question")


def _varies(t: Tables, column: Column, problem: str) -> DataFrame:
    return _bad(t["instances"].groupBy("family_id").agg(F.countDistinct(column).alias("n")).filter("n > 1"), "family_id", problem)


@check("G", "same question at every length")
def same_question(t: Tables) -> DataFrame:
    own = t["instances"].join(t["families"].select("family_id", F.col("question").alias("asked")), "family_id").filter("question <> asked")
    return _union(_varies(t, F.col("question"), "question varies"), _bad(own, "family_id", "question differs from the family's"))


@check("H", "same answer at every length")
def same_answer(t: Tables) -> DataFrame:
    return _varies(t, F.coalesce("gold_answer", F.lit("")), "gold answer varies")


@check("I", "same evidence at every length")
def same_evidence(t: Tables) -> DataFrame:
    return _union(_varies(t, F.array_join("gold_ids", "|"), "gold records vary"), _varies(t, F.sha2(F.coalesce("gold_block", F.lit("")), 256), "gold block varies"))


@check("J", "nesting")
def nesting(t: Tables) -> DataFrame:
    at = Window.partitionBy("family_id").orderBy("nominal")
    i = t["instances"].withColumn("before", F.lag("record_ids").over(at)).withColumn("last", F.lag("nominal").over(at)).filter("before is not null")
    kept = F.filter("record_ids", lambda x: F.array_contains("before", x))
    return _union(_bad(i.filter(F.size(F.array_except("before", "record_ids")) > 0), _inst(i), "records of the shorter context are lost"), _bad(i.filter((F.size(F.array_except("before", "record_ids")) == 0) & (kept != F.col("before"))), _inst(i), "order of the shorter context is lost"), _bad(i.filter(F.size("record_ids") <= F.size("before")), _inst(i), "no growth"), _bad(i.filter(~F.col("parent_nominal").eqNullSafe(F.col("last"))), _inst(i), "wrong parent"))


@check("K", "length")
def length(t: Tables, min_fill: float = 0.9) -> DataFrame:
    i = t["instances"]
    return _union(_bad(i.filter("tokens > nominal"), _inst(i), "over length"), _bad(i.filter(F.col("tokens") < min_fill * F.col("nominal")), _inst(i), "under the minimum fill"))


@check("L", "position")
def position(t: Tables, target: float = 0.5, tolerance: float = 0.05) -> DataFrame:
    i = t["instances"]
    return _bad(i.filter(F.abs(F.col("relative_position") - target) > tolerance), _inst(i), "evidence is displaced")


@check("M", "record tags")
def tags(t: Tables) -> DataFrame:
    i = t["instances"]
    opened = F.regexp_extract_all("context", F.lit(r'<RECORD id="([^"]+)"'), F.lit(1))
    return _union(_bad(i.filter(F.size(opened) != F.regexp_count("context", F.lit("</RECORD>"))), _inst(i), "tags are not balanced"), _bad(i.filter(opened != F.col("display_ids")), _inst(i), "ids differ from those declared"), _bad(i.filter(F.size(F.array_distinct(opened)) != F.size(opened)), _inst(i), "a record twice"))


@check("N", "operand units")
def units(t: Tables) -> DataFrame:
    f = t["families"].join(_operand_values(t), "family_id").filter(F.col("operation").isin("growth_percent", "difference", "ratio_percent", "sum"))
    return _bad(f.filter(F.size("units") > 1), "family_id", "operands of different units")


@check("O", "answer schema")
def schema(t: Tables) -> DataFrame:
    f = t["families"]
    numeric = F.col("answer_type").isin("NUMERIC", "PERCENT", "INTEGER")
    return _union(_bad(f.filter(~F.col("answer_type").isin(*core.ANSWER_TYPES)), "family_id", "unknown answer type"), _bad(f.filter("answerable and gold_answer is null"), "family_id", "no gold answer"), _bad(f.filter("not answerable and gold_answer is not null"), "family_id", "gold answer of an unanswerable question"), _bad(f.filter(F.col("answerable") & numeric & F.col("gold_num").isNull()), "family_id", "numeric answer without a number"), _bad(f.filter("answerable and coalesce(size(gold_ids), 0) <= 0"), "family_id", "no evidence"), _bad(f.filter("question_type = 'RETRIEVAL_CALCULATION' and operation is null"), "family_id", "calculation without operation"))


@check("P", "distractor metadata")
def distractor_metadata(t: Tables) -> DataFrame:
    p = t["placements"].filter("side <> 'gold'")
    n = p.groupBy("family_id", "nominal").agg(F.count("*").alias("n"))
    i = t["instances"].join(n, ["family_id", "nominal"], "left").filter(F.size("record_ids") - F.size("gold_ids") != F.coalesce("n", F.lit(0)))
    return _union(_bad(i, _inst(i), "distractors differ from the context's"), _bad(p.filter(F.col("tier").isNull() | ~F.col("tier").isin(*distractors.TIERS)), "family_id", "distractor without tier"))


@check("Q", "finite numbers")
def finite(t: Tables) -> DataFrame:
    f = t["families"]
    return _bad(f.filter(F.isnan("gold_num") | (F.abs("gold_num") == float("inf"))), "family_id", "gold is not finite")


@check("R", "gold block intact")
def gold_block(t: Tables) -> DataFrame:
    i = t["instances"].filter("coalesce(gold_block, '') <> ''")
    times = F.size(F.split("context", F.concat(F.lit("\\Q"), F.col("gold_block"), F.lit("\\E")), -1)) - 1
    return _bad(i.filter(times != 1), _inst(i), "gold block is not there exactly once")


def _leaking(t: Tables, answerable: bool) -> DataFrame:
    """family_id, nominal, record_id of placed records that satisfy a condition of their family."""
    c = t["families"].filter(F.col("answerable") == answerable).select("family_id", F.explode("conditions").alias("c")).select("family_id", "c.*")
    metadata = "metadata" in c.columns and "metadata" in t["facts"].columns
    placed = t["placements"].filter("side <> 'gold'").join(t["facts"].select("record_id", *conditions.KEYS, *(["metadata"] if metadata else [])), "record_id").alias("f")
    return placed.join(c.alias("c"), (F.col("f.family_id") == F.col("c.family_id")) & conditions.satisfied("f", "c", metadata=metadata)).select("f.family_id", "f.nominal", "f.record_id").distinct()


@check("S", "unanswerable leakage")
def leakage(t: Tables) -> DataFrame:
    a = t["families"].filter("not answerable").select("family_id", F.explode("aliases").alias("concept"), "missing_entity", "missing_period")
    p = t["placements"].join(t["facts"].select("record_id", "concept", "entity_id", "period"), "record_id")
    hit = p.join(a, ["family_id", "concept"]).filter("(missing_entity is null or entity_id = missing_entity) and (missing_period is null or period = missing_period)")
    return _union(_bad(_leaking(t, False), "family_id", "a record satisfies the question's condition"), _bad(hit, "family_id", "a record of a forbidden concept"))


@check("T", "calculation operands")
def operands(t: Tables) -> DataFrame:
    f = t["families"].filter("operation is not null")
    lost = f.join(_operand_values(t), "family_id").filter("n_lost > 0")
    return _union(_bad(f.filter("not map_keys(operand_ids) <=> map_keys(operands)"), "family_id", "operands without values"), _bad(lost, "family_id", "operands that are no facts"), _bad(f.filter(F.size(F.array_except(F.map_values("operand_ids"), "gold_ids")) > 0), "family_id", "operands outside the evidence"))


@check("U", "all question types", "warning")
def all_types(t: Tables) -> DataFrame:
    want = t["families"].sparkSession.createDataFrame([(x,) for x in QUESTION_TYPES], "question_type string")
    return _bad(want.join(t["families"], "question_type", "left_anti"), "question_type", "no such question")


@check("V", "no second source")
def second_source(t: Tables) -> DataFrame:
    return _bad(_leaking(t, True), "family_id", "a distractor satisfies the question's condition")


@check("W", "display ids")
def display(t: Tables) -> DataFrame:
    i = t["instances"]
    return _union(_bad(i.filter(F.size("display_ids") != F.size("record_ids")), _inst(i), "display ids differ in number"), _bad(i.filter(F.size(F.array_distinct("display_ids")) != F.size("display_ids")), _inst(i), "a display id twice"), _bad(i.filter(F.exists("display_ids", lambda x: ~x.rlike("^R[A-Z0-9]{8,}$"))), _inst(i), "malformed display id"))


@check("X", "equivalence groups")
def equivalence(t: Tables) -> DataFrame:
    g = distractors.equivalents(t["facts"]).select(F.explode("record_ids").alias("record_id"), "record_ids")
    p = t["placements"]
    gold = p.filter("side = 'gold'").join(g, "record_id").select("family_id", "nominal", F.explode("record_ids").alias("record_id"))
    return _bad(p.filter("side <> 'gold'").join(gold, ["family_id", "nominal", "record_id"], "left_semi"), "family_id", "a distractor is equivalent to the evidence")


@check("Y", "tiers mean what they say")
def tier_meaning(t: Tables) -> DataFrame:
    p = t["placements"].filter("flags is not null")
    want = {"WRONG_VERSION": ("different_version",), "WRONG_PERIOD": ("different_period",), "WRONG_ENTITY": ("different_entity",), "WRONG_FIELD": ("same_entity", "different_metric"), "WRONG_UNIT": ("same_entity", "same_period"), "NEAR_MATCH_VALUE": ("value_within_5_percent",)}
    return _union(*[_bad(p.filter((F.col("tier") == tier) & ~F.coalesce(F.try_element_at("flags", F.lit(flag)), F.lit(False))), "family_id", f"{tier} without {flag}") for tier, flags in want.items() for flag in flags])


@check("Z", "questions don't tell")
def wording(t: Tables) -> DataFrame:
    return _bad(t["families"].filter(F.size(core.leaks(F.col("question"))) > 0), "family_id", "wording gives away answerability")


@check("AA", "prompt budget")
def prompt_budget(t: Tables) -> DataFrame:
    i = t["instances"].filter("prompt_tokens is not null")
    again = core.token_count(F.col("context")) + core.token_count(F.col("question"))
    return _union(_bad(i.filter("prompt_tokens > prompt_budget"), _inst(i), "over the prompt budget"), _bad(i.filter(again != F.col("prompt_tokens")), _inst(i), "prompt tokens differ when counted again"))


@check("AB", "all instances there")
def complete(t: Tables) -> DataFrame:
    lengths = t["instances"].select("nominal").union(t["unavailable"].select("nominal")).distinct().count()
    seen = t["instances"].select("family_id", "nominal").union(t["unavailable"].select("family_id", "nominal")).distinct().groupBy("family_id").agg(F.count("*").alias("n"))
    f = t["families"].join(seen, "family_id", "left").filter(F.coalesce("n", F.lit(0)) != lengths)
    return _bad(f, "family_id", "lengths that are neither there nor declared unavailable")


@check("AC", "gold display ids")
def gold_display(t: Tables) -> DataFrame:
    i = t["instances"]
    at = F.transform("gold_ids", lambda g: F.get("display_ids", (F.array_position("record_ids", g) - 1).cast("int")))
    return _bad(i.filter(at != F.col("gold_display_ids")), _inst(i), "gold display ids differ from the context's")


@check("AD", "version templates")
def version_templates(t: Tables) -> DataFrame:
    f = t["families"].filter("question_type = 'TEMPORAL_VERSION'")
    return _bad(f.filter(~F.col("template").isin(*VERSION_TEMPLATES)), "family_id", "not a temporal template")


def violations(t: Tables, checks: list[str] | None = None) -> DataFrame:
    parts = [f(t).select(F.lit(c).alias("check_id"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), "key", "problem") for c, (name, severity, f) in CHECKS.items() if checks is None or c in checks]
    return _union(*parts)


def report(t: Tables, checks: list[str] | None = None) -> DataFrame:
    """check_id, name, severity, n_failed, truncated, failures (at most CAP, by key): a row for each check.

    Violations are written once; each task counts its own and gives CAP of a check at most, so no task sees all of a check."""
    v = kept(violations(t, checks).select("check_id", "key", "problem"))
    shown = selection.top_by(v, ["check_id"], CAP, "key", "problem").groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("key", "problem"))).alias("failures"))
    failed = v.groupBy("check_id").agg(F.count("*").alias("n_failed")).join(shown, "check_id")
    names = v.sparkSession.createDataFrame([(c, n, s) for c, (n, s, _) in CHECKS.items() if checks is None or c in checks], "check_id string, name string, severity string")
    out = names.join(failed, "check_id", "left")
    return out.select("check_id", "name", "severity", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), (F.coalesce("n_failed", F.lit(0)) > CAP).alias("truncated"), F.coalesce("failures", F.array().cast("array<struct<key:string,problem:string>>")).alias("failures"))


def exit_code(rows: DataFrame, strict: bool = False) -> int:
    return int(rows.filter((F.col("n_failed") > 0) & (F.lit(strict) | (F.col("severity") == "error"))).limit(1).count() > 0)
