"""Grading of answers: parse, normalise, compare, match against the context, classify. All but JSON recovery is native.

instances: instance_id, question_type, answer_type, answerable, gold_answer, tolerance, gold_display_ids, gold_sets
(array of arrays of display ids that count for each gold record), context_display_ids, records (array of (display_id,
value) in context order), distractors (map display_id -> tier), raw_result, rounded_result, round_decimals.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import selection

# Tiers that are also error types.
DISTRACTOR_ERRORS = ("WRONG_ENTITY", "WRONG_PERIOD", "WRONG_VERSION", "WRONG_FIELD", "WRONG_UNIT", "WRONG_SERIES_VARIANT")


def context_match(records: Column, model: Column, kind: Column, tol: Column) -> Column:
    """The first record, by position, whose value equals the model's answer; null if none or no usable answer."""
    usable = (F.coalesce(model["txt"], F.lit("")) != core.INSUFFICIENT) & (model["num"].isNotNull() | model["txt"].isNotNull())
    normal = F.transform(records, lambda r: F.struct(r.alias("r"), core.normalize_answer(r["value"], kind).alias("n")))
    hits = F.filter(F.when(usable, normal), lambda x: core.answers_equal(x["n"], model, kind, tol))
    return F.get(hits, F.lit(0))["r"]


def alternate_rounding(model: Column, gold: Column, tol: Column, raw: Column, rounded: Column, decimals: Column) -> Column:
    """Whether the answer is the raw result, the rounded one, or one of up to two decimals more or fewer, gold aside."""
    t = F.coalesce(tol, F.lit(0.0))
    places = F.sequence(F.greatest(decimals - 2, F.lit(0)), decimals + 2)
    rounds = F.transform(places, lambda d: F.floor(raw * F.pow(F.lit(10.0), d) + 0.5) / F.pow(F.lit(10.0), d))
    some = F.concat(F.array(raw, rounded), F.coalesce(F.when(decimals.isNotNull() & raw.isNotNull(), rounds), F.array().cast("array<double>")))
    return F.coalesce(F.exists(some, lambda c: c.isNotNull() & ~(F.abs(c - gold["num"]) <= t) & (F.abs(model["num"] - c) <= t)), F.lit(False))


def grade_answer_only(joined: DataFrame) -> DataFrame:
    """joined: instances with raw_output_text. The first rule that holds, in this order, names the error type."""
    c = {k: F.col(k) for k in joined.columns}
    answer = core.parse_answer_line(c["raw_output_text"])
    df = joined.withColumn("parsed_answer", answer)
    df = df.withColumn("gold", core.normalize_answer(c["gold_answer"], c["answer_type"])).withColumn("model", core.normalize_answer(F.col("parsed_answer"), c["answer_type"]))
    model, gold = F.col("model"), F.col("gold")
    df = df.withColumn("insufficient", F.coalesce(model["txt"] == core.INSUFFICIENT, F.lit(False)))
    equal = core.answers_equal(model, gold, c["answer_type"], c["tolerance"])
    df = df.withColumn("matched", context_match(c["records"], model, c["answer_type"], c["tolerance"]))
    df = df.withColumn("matched_tier", F.try_element_at("distractors", F.col("matched.display_id")))
    valid, answerable = F.col("parsed_answer").isNotNull(), c["answerable"]
    correct = F.when(answerable, equal).otherwise(F.col("insufficient"))
    calc = c["question_type"] == "RETRIEVAL_CALCULATION"
    usable = (F.coalesce(model["txt"], F.lit("")) != core.INSUFFICIENT) & model["num"].isNotNull()
    alternate = calc & usable & alternate_rounding(model, gold, c["tolerance"], c["raw_result"], c["rounded_result"], c["round_decimals"])
    # Names of error types and of the rules that give them.
    rules = [
        (~valid, "FORMAT_FAILURE", "answer_line_parse_failure", None),
        (correct, "CORRECT", "answer_only_exact_match", False),
        (answerable & F.col("insufficient"), "UNNECESSARY_ABSTENTION", "answerable_instance_unnecessary_abstention", False),
        (~answerable & ~F.col("insufficient"), "FAILED_TO_ABSTAIN", "unanswerable_instance_factual_answer", True),
        (F.col("matched_tier").isin(*DISTRACTOR_ERRORS), None, "answer_matches_context_distractor_value", False),
        (alternate, "CALCULATION_ERROR", "calculation_answer_matches_unrounded_or_alternate_rounding", False),
        (calc & F.col("matched").isNotNull(), "CALCULATION_ERROR", "calculation_answer_matches_context_operand_or_value", False),
        (F.col("matched").isNotNull(), "AMBIGUOUS_REVIEW_REQUIRED", "answer_matches_context_value_without_taxonomy", False),
        (F.lit(True), "UNSUPPORTED_VALUE", "answer_not_matched_to_context_value", True),
    ]
    return _outcomes(df.withColumn("answer_correct", valid & correct), rules)


def _outcomes(df: DataFrame, rules: list[tuple]) -> DataFrame:
    error, rule, halluc = F, F, F
    for holds, name, text, is_halluc in rules:
        holds = F.coalesce(holds, F.lit(False))
        error = error.when(holds, F.lit(name) if name else F.col("matched_tier"))
        rule = rule.when(holds, F.lit(text))
        halluc = halluc.when(holds, F.lit(is_halluc).cast("boolean"))
    df = df.withColumn("error_type", error).withColumn("grading_rule", rule).withColumn("hallucination", halluc)
    abstention = F.when(F.col("error_type") == "FORMAT_FAILURE", F.when(~F.col("answerable"), F.lit(False))).when(F.col("answerable"), ~F.col("insufficient")).otherwise(F.col("insufficient"))
    df = df.withColumn("abstention_correct", abstention).withColumn("needs_review", F.col("error_type").isin("FORMAT_FAILURE", "AMBIGUOUS_REVIEW_REQUIRED", "OTHER"))
    return df.withColumn("factual_outcome", F.when(F.col("answer_correct"), "CORRECT").otherwise("INACCURATE")).withColumn("inaccuracy_class", F.when(F.col("answer_correct"), F.lit(None)).when(F.col("hallucination"), "HALLUCINATORY").otherwise("GROUNDED"))


def evidence(selected: Column, gold_sets: Column, known: Column, answerable: Column, distractors: Column) -> Column:
    """Selected evidence against the sets of ids that count for each gold record."""
    chosen = F.coalesce(selected, F.array().cast("array<string>"))
    valid = F.flatten(gold_sets)
    missing = F.filter(F.transform(gold_sets, lambda g, i: F.when(F.size(F.array_intersect(g, chosen)) == 0, i)), lambda i: i.isNotNull())
    extra, unknown = F.filter(chosen, lambda x: ~F.array_contains(valid, x)), F.filter(chosen, lambda x: ~F.array_contains(known, x))
    correct = F.when(~answerable, F.size(chosen) == 0).otherwise((F.size(gold_sets) > 0) & (F.size(missing) == 0) & (F.size(extra) == 0) & (F.size(unknown) == 0))
    of = F.map_filter(distractors, lambda k, v: F.array_contains(chosen, k))
    return F.struct(correct.alias("correct"), missing.alias("missing"), extra.alias("extra"), unknown.alias("unknown"), of.alias("distractors"))


JSON_SCHEMA = "struct<answer:string,selected_evidence:array<string>,insufficient_evidence:boolean,method:string,degenerate:boolean>"


# What a record's id and a fence look like; a response that lists LISTED ids or more is degenerate if one of
# them stands there OFTEN times or all of them are MANY; Python's literals and JSON's; closers that may be missing.
SHOWN_ID, FENCE = re.compile(r'"(R[A-Z0-9]{8,12})"'), re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
LISTED, OFTEN, MANY, CLOSERS = 20, 12, 60, 3
LITERALS = {"True": "true", "False": "false", "None": "null"}


def degenerate(text: str) -> bool:
    """Whether a response does nothing but list ids."""
    ids = SHOWN_ID.findall(text)
    return len(ids) >= LISTED and (len(ids) >= MANY or max(Counter(ids).values()) >= OFTEN)


def recover(raw: str | None) -> dict:
    """A response object: as it is, out of a fence, the first whole object, with Python literals, or with closers added.

    Nothing is guessed: the object must have all three fields of the right kinds."""
    text = (raw or "").strip()
    empty = {"answer": None, "selected_evidence": None, "insufficient_evidence": None, "method": None, "degenerate": degenerate(text)}

    def shaped(s: str | None, method: str) -> dict | None:
        try:
            x = json.loads(s) if s else None
        except ValueError:
            return None
        if not isinstance(x, dict) or "answer" not in x or not isinstance(x.get("selected_evidence"), list) or not isinstance(x.get("insufficient_evidence"), bool):
            return None
        answer = x["answer"]
        return empty | {"answer": answer if answer is None or isinstance(answer, str) else json.dumps(answer), "selected_evidence": [e for e in x["selected_evidence"] if isinstance(e, str)], "insufficient_evidence": x["insufficient_evidence"], "method": method}

    if found := shaped(text, "strict"):
        return found
    if empty["degenerate"]:
        return empty
    fence = FENCE.fullmatch(text)
    if found := shaped(fence and fence[1], "fence"):
        return found
    whole, closed = _scan(text)
    plain = re.sub(rf":\s*({'|'.join(LITERALS)})\b", lambda m: ": " + LITERALS[m[1]], text)
    for s, method in ((whole, "first_object"), (plain, "literals"), (closed, "closers")):
        if found := shaped(s, method):
            return found
    return empty


def _scan(text: str) -> tuple[str | None, str | None]:
    """(the first balanced object, the whole text with at most three missing closers added)."""
    open_, start, first, inside, escaped, broken = [], text.find("{"), None, False, False, False
    for k, ch in enumerate(text):
        if inside:
            inside, escaped = not (ch == '"' and not escaped), ch == "\\" and not escaped
        elif ch == '"':
            inside = True
        elif ch in "[{":
            open_.append("]" if ch == "[" else "}")
        elif ch in "]}":
            if not open_ or open_.pop() != ch:
                broken = True
                open_ = []
            elif not open_ and first is None and ch == "}" and start >= 0:
                first = text[start : k + 1]
    return first, None if inside or broken or not 0 < len(open_) <= CLOSERS else text + "".join(reversed(open_))


def _strict(text: Column) -> Column:
    """What recover gives for a response that plainly is an object of the right shape, else null: of one pair of braces, with a
    text or null as answer, a list of texts as evidence, fewer than LISTED ids, and nothing that only one of two JSON
    parsers takes."""
    plain = text.rlike(r"^\{[^{}]*\}$") & (F.size(F.regexp_extract_all(text, F.lit(SHOWN_ID.pattern), F.lit(1))) < LISTED)

    def taken(v: Column) -> Column:
        kind = lambda field: F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        get = lambda field, kind: F.try_variant_get(v, f"$.{field}", kind)
        shaped = kind("answer").isin("STRING", "VOID") & kind("selected_evidence").isin("ARRAY<STRING>", "ARRAY<VOID>") & (kind("insufficient_evidence") == "BOOLEAN")
        whole = F.struct(get("answer", "string").alias("answer"), get("selected_evidence", "array<string>").alias("selected_evidence"), get("insufficient_evidence", "boolean").alias("insufficient_evidence"), F.lit("strict").alias("method"), F.lit(False).alias("degenerate"))
        return F.when(F.coalesce(shaped, F.lit(False)), whole)

    return core.once(F.when(plain, F.try_parse_json(text)), taken)


def recovered(raw: Column) -> Column:
    """recover: plain objects in the JVM, as VARIANT; what is left in Arrow batches, as a balanced scan has no native form."""

    @F.pandas_udf(JSON_SCHEMA)
    def run(x: pd.Series) -> pd.DataFrame:
        none = recover(None)
        return pd.DataFrame([none if v is None else recover(v) for v in x], columns=list(none), dtype=object)

    strict = _strict(F.trim(raw))
    return F.coalesce(strict, run(F.when(strict.isNull(), raw)))


def structure_checks(joined: DataFrame, limit: int = 512) -> DataFrame:
    """joined (raw_output_text, question_type, generated_tokens) with what a response's form tells: r (see recovered), usable,
    hit_limit, missing_answer_field, answer_first, expected_evidence, n_selected, repeated_evidence, evidence_violation.

    The number of records that a rule asks for: none of an abstention, two of a calculation, else one. More than two, one
    of them twice, or another number is a violation; of a response that can't be used nothing is expected."""
    raw = F.coalesce("raw_output_text", F.lit(""))
    df = joined.withColumn("r", recovered(F.col("raw_output_text")))
    usable, chosen = F.col("r.method").isNotNull(), F.coalesce("r.selected_evidence", F.array().cast("array<string>"))
    abstains = F.coalesce("r.insufficient_evidence", F.lit(False)) | F.coalesce(F.col("r.answer") == "INSUFFICIENT_EVIDENCE", F.lit(False))
    expected = F.when(usable, F.when(abstains, 0).when(F.col("question_type") == "RETRIEVAL_CALCULATION", 2).otherwise(1))
    repeated = usable & (F.size(chosen) != F.size(F.array_distinct(chosen)))
    return df.withColumns({
        "usable": usable, "hit_limit": F.coalesce(F.col("generated_tokens") == limit, F.lit(False)), "missing_answer_field": ~raw.contains('"answer"'), "answer_first": F.ltrim(raw).startswith('{"answer"') | F.ltrim(raw).startswith('{\n  "answer"'),
        "expected_evidence": expected, "n_selected": F.size(chosen), "repeated_evidence": repeated, "evidence_violation": usable & ((F.size(chosen) != expected) | (F.size(chosen) > 2) | repeated),
    })


def format_transitions(results: DataFrame, family: str, label: str, labels: list[str], failed: Column) -> DataFrame:
    """How each family's responses fail along a ladder of labels, shortest first: one row a family, with whether it fails or
    succeeds at every label, succeeds at the first and fails later, the first failure, and the labels of either kind. A
    label without a result is of neither kind."""
    at = F.array_position(F.array(*map(F.lit, labels)), F.col(label))
    rungs = results.filter(F.col(label).isin(*labels)).groupBy(family, label).agg(F.bool_or(failed).alias("failed"))
    x = rungs.groupBy(family).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(label).alias("label"), "failed"))).alias("x"))
    names = lambda want: F.transform(F.filter("x", lambda s: s["failed"] == want), lambda s: s["label"])
    bad, good = names(True), names(False)
    return x.select(
        family, (F.size(good) == len(labels)).alias("success_everywhere"), (F.size(bad) == len(labels)).alias("fails_everywhere"), (F.array_contains(good, labels[0]) & (F.size(bad) > 0)).alias("short_success_long_failure"),
        F.get(bad, F.lit(0)).alias("first_failure"), F.array_join(bad, ";").alias("failures"), F.array_join(good, ";").alias("usable"),
    )


def grade_structured(joined: DataFrame) -> DataFrame:
    """JSON responses with evidence. A failed abstention is a hallucination only if its value isn't in the context."""
    df = joined.withColumn("r", recovered(F.col("raw_output_text")))
    c = {k: F.col(k) for k in joined.columns}
    valid = F.col("r.method").isNotNull()
    df = df.withColumn("parsed_answer", F.col("r.answer")).withColumn("gold", core.normalize_answer(c["gold_answer"], c["answer_type"])).withColumn("model", core.normalize_answer(F.col("parsed_answer"), c["answer_type"]))
    model, gold = F.col("model"), F.col("gold")
    df = df.withColumn("insufficient", F.coalesce(F.col("r.insufficient_evidence"), F.lit(False)) | F.coalesce(model["txt"] == core.INSUFFICIENT, F.lit(False)))
    df = df.withColumn("evidence", evidence(F.col("r.selected_evidence"), c["gold_sets"], c["context_display_ids"], c["answerable"], c["distractors"]))
    df = df.withColumn("matched", context_match(c["records"], model, c["answer_type"], c["tolerance"])).withColumn("matched_tier", F.try_element_at("distractors", F.col("matched.display_id")))
    answerable, calc, hit = c["answerable"], c["question_type"] == "RETRIEVAL_CALCULATION", F.col("matched").isNotNull()
    equal = core.answers_equal(model, gold, c["answer_type"], c["tolerance"])
    correct = F.when(answerable, equal).otherwise(F.col("insufficient") & (F.coalesce(F.col("parsed_answer"), F.lit("")) == "INSUFFICIENT_EVIDENCE"))
    # Names of error types and of the rules that give them.
    rules = [
        (~valid, "FORMAT_FAILURE", "json_parse_failure", None),
        (correct & F.col("evidence.correct"), "CORRECT", "deterministic_exact", False),
        (answerable & F.col("insufficient"), "UNNECESSARY_ABSTENTION", "deterministic_exact", False),
        (~answerable & ~F.col("insufficient") & hit, "FAILED_TO_ABSTAIN", "failed_to_abstain_but_value_present_in_context", False),
        (~answerable & ~F.col("insufficient"), "FAILED_TO_ABSTAIN", "failed_to_abstain_unsupported_value", True),
        (~correct & F.col("matched_tier").isin(*DISTRACTOR_ERRORS), None, "model_answer_matches_context_distractor_value", False),
        (~correct & hit & calc, "CALCULATION_ERROR", "model_answer_matches_context_value", False),
        (~correct & hit, "OTHER", "model_answer_matches_context_value", False),
        (~correct, "UNSUPPORTED_VALUE", "model_answer_not_matched_to_context_value", True),
        (F.lit(True), "WRONG_EVIDENCE", "answer_correct_evidence_incorrect", False),
    ]
    return _outcomes(df.withColumn("answer_correct", valid & F.coalesce(correct, F.lit(False))), rules)


def join_results(instances: DataFrame, results: DataFrame, families: DataFrame, key: str = "instance_id", family: str = "family_id", attempt: str = "attempt", place: tuple[str, ...] = ()) -> DataFrame:
    """One row for each instance, and for each result of none: the columns of instances, results and families, and status.

    Of several results of an instance the last attempt counts, of equal attempts the first by place, and attempts tells their number. status is joined, no_result,
    no_family, or no_instance for the last attempt of a key that no instance has."""
    n = results.groupBy(key).agg(F.count("*").alias("attempts"))
    last = selection.first_by(results, [key], F.col(attempt).desc(), *place).drop(*place).join(n, key).withColumn("_answered", F.lit(True))
    both = instances.withColumn("_asked", F.lit(True)).join(last, key, "full_outer").join(families.withColumn("_known", F.lit(True)), family, "left")
    status = F.when(F.col("_asked").isNull(), "no_instance").when(F.col("_answered").isNull(), "no_result").when(F.col("_known").isNull(), "no_family").otherwise("joined")
    return both.withColumn("status", status).withColumn("attempts", F.coalesce("attempts", F.lit(0))).drop("_asked", "_answered", "_known")


def split_failures(runs: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(results, failures): runs that ended with an error have no answer to grade."""
    return runs.filter(F.col(error).isNull()), runs.filter(F.col(error).isNotNull())
