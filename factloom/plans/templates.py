"""The question templates: each a function from facts to families, a family being a question with a computed answer.

facts are those of the adapters. A template proposes candidates, keeps one of each key in seeded order, and returns at
most n families. Questions are worded from the evidence alone; gold answers are computed, never copied by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import calc, selection
from factloom.sources.shared import kept

Template = Callable[[DataFrame, int, str], DataFrame]
TEMPLATES: dict[str, tuple[str, str, Template]] = {}
# Concepts and series that templates name.
REVENUES = ("us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:Revenues")
OPERATING_INCOME = "us-gaap:OperatingIncomeLoss"
SPREADS = (("DGS10", "FEDFUNDS"), ("GS10", "FEDFUNDS"), ("UNRATE", "UNRATENSA"), ("CAUR", "TXUR"), ("NYUR", "FLUR"))
CONFUSABLE = (("NY.GDP.MKTP.KD", "NY.GDP.MKTP.CD"), ("NY.GDP.PCAP.CD", "NY.GDP.MKTP.CD"), ("NE.EXP.GNFS.ZS", "NE.IMP.GNFS.ZS"), ("SP.POP.GROW", "NY.GDP.MKTP.KD.ZG"))
GDP, POPULATION = "NY.GDP.MKTP.CD", "SP.POP.TOTL"
DATES = ("study.start_date", "study.primary_completion_date", "study.completion_date", "study.first_posted_date", "study.last_update_posted_date", "study.results_first_posted_date")
ABSENT_PRODUCT = ("product.route", "product.marketing_status")
ABSENT_STUDY = ("study.results_first_posted_date", "eligibility.maximum_age")
MIX = {"DIRECT_RETRIEVAL": 0.20, "RETRIEVAL_CALCULATION": 0.30, "TEMPORAL_VERSION": 0.15, "ENTITY_UNIT_BINDING": 0.15, "UNANSWERABLE": 0.20}

KEY = "struct<entity_id:string,concept:string,period:string,unit:string,version:string>"


def template(domain: str, kind: str):
    def add(f: Template) -> Template:
        TEMPLATES[f.__name__.upper()] = (domain, kind, f)
        return f

    return add


def _record(prefix: str = "") -> Column:
    """A fact's columns as a struct."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.struct(*[c(n).alias(n) for n in ("record_id", "entity_id", "entity_name", "concept", "concept_label", "value", "value_numeric", "unit", "period", "version")])


def _facts(facts: DataFrame, domain: str) -> DataFrame:
    return facts.filter(F.col("domain") == domain)


def _meta(key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key))


def _conditions(*records: str) -> Column:
    """Field by field, so that joins carry only what is used of a record."""
    return F.array(*[F.struct(*[F.col(f"{r}.{c}").cast("string").alias(c) for c in ("entity_id", "concept", "period", "unit", "version")]) for r in records]).cast(f"array<{KEY}>")


def _families(df: DataFrame, name: str, n: int, seed: str, key: list[Column], question: Column, evidence: list[str], roles: list[str], operation: str | None = None, gold: Column | None = None, kind: str = "NUMERIC", unit: Column | None = None, decimals: int | None = None, foils: Column | None = None, text: Column | None = None, absent: dict[str, Column] | None = None, operand: Callable[[Column], Column] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Families of candidate rows: one of each key in seeded order, the first n of those; more: columns that are added."""
    domain, qtype, _ = TEMPLATES[name]
    none = F.lit(None)
    ids = F.array(*[F.col(f"{e}.record_id") for e in evidence]) if evidence else F.array().cast("array<string>")
    value = operand or (lambda e: e["value_numeric"])
    operands = F.map_from_arrays(F.array(*map(F.lit, roles)), F.array(*[value(F.col(e)) for e in evidence])) if operation else none
    result = gold if gold is not None else (calc.result(F.lit(operation), operands) if operation else F.col(f"{evidence[0]}.value_numeric") if evidence else none)
    rounded = calc.half_up(result.cast("double"), decimals) if decimals is not None else result.cast("double")
    answer = text if text is not None else F.when(F.lit(decimals is not None), F.concat(F.format_number(rounded, decimals or 0), F.lit("%" if kind == "PERCENT" else ""))).otherwise(core.format_value(rounded)) if evidence else none
    d = df.withColumn("_key", F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))).withColumn("_h", core.order_key(seed, F.lit(name), F.col("_key"), *[F.col(f"{e}.record_id") for e in evidence]))
    out = d.select(
        F.lit(domain).alias("domain"), F.lit(name).alias("template"), F.lit(qtype).alias("question_type"), question.alias("question"), F.lit(bool(evidence)).alias("answerable"), answer.cast("string").alias("gold_answer"),
        (rounded if evidence and text is None else none).cast("double").alias("gold_num"), F.lit(kind if evidence else "INSUFFICIENT_EVIDENCE").alias("answer_type"), (unit if unit is not None else none).cast("string").alias("unit"), (core.tolerance(rounded, F.lit(decimals).cast("int")) if evidence and text is None else none).cast("double").alias("tolerance"), ids.alias("gold_ids"),
        F.lit(operation).cast("string").alias("operation"), (F.map_from_arrays(F.array(*map(F.lit, roles)), ids) if operation else none).cast("map<string,string>").alias("operand_ids"), operands.cast("map<string,double>").alias("operands"), (result if operation else none).cast("double").alias("raw_result"), F.lit(decimals).cast("int").alias("round_decimals"),
        _conditions(*evidence).alias("conditions") if evidence else F.array(F.struct(*[(absent or {}).get(c, none).cast("string").alias(c) for c in ("entity_id", "concept", "period", "unit", "version")])).cast(f"array<{KEY}>").alias("conditions"),
        (foils if foils is not None else F.array().cast("array<string>")).alias("foil_ids"), (absent or {}).get("entity_id", none).cast("string").alias("missing_entity"), (absent or {}).get("period", none).cast("string").alias("missing_period"), (F.array(absent["concept"]) if absent else F.array()).cast("array<string>").alias("aliases"), "_key", "_h", *[c.alias(k) for k, c in (more or {}).items()],
    )
    out = out.filter("not answerable or gold_answer is not null")
    if operation:
        out = out.filter("raw_result is not null")
    first = selection.first_keys(out, "_key", n, "_h", "question")
    return first.orderBy("_h", "question").withColumn("family_id", F.concat(F.lit(domain + "_"), F.upper(F.substring("_h", 1, 10)))).drop("_key", "_h")


def _pair(a: DataFrame, b: DataFrame, on: Column, left: str = "a", right: str = "b", how: str = "inner") -> DataFrame:
    """Facts a and b joined as structs left and right; on refers to them by these names."""
    x, y = a.select(_record().alias(left)), b.select(_record().alias(right))
    return x.join(y, on, how)


def _eq(*names: str, left: str = "a", right: str = "b") -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"{left}.{n}") == F.col(f"{right}.{n}"))
    return out


def _binding(df: DataFrame, group: list[str], least: int, distinct: str, name: str, seed: str) -> DataFrame:
    """Groups with at least `least` distinct values: one member (t) by hash, and up to three others (foil_ids)."""
    members = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], _record().alias("r"), core.order_key(seed, F.lit(name), F.col("record_id")).alias("h"))
    keys = [f"g{i}" for i in range(len(group))]
    n = members.groupBy(*keys).agg(F.countDistinct(f"r.{distinct}").alias("n")).filter(F.col("n") >= least)
    top = selection.ranked(members.join(n, keys), keys, "k", "h").filter("k <= 4")
    return top.groupBy(*keys).agg(F.max(F.when(F.col("k") == 1, F.col("r"))).alias("t"), F.collect_list(F.when(F.col("k") > 1, F.col("r.record_id"))).alias("foil_ids"))


def _annual(facts: DataFrame) -> DataFrame:
    return _facts(facts, "SEC").filter((_meta("has_frame") == "true") & (_meta("period_kind") == "annual") & F.col("value_numeric").isNotNull() & (F.col("unit") == "USD"))


def _q(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


@template("SEC", "DIRECT_RETRIEVAL")
def sec_direct_xbrl_fact(facts: DataFrame, n: int, seed: str) -> DataFrame:
    recent = _annual(facts).withColumn("recent", F.col("period") >= "CY2015").withColumn("any", F.max("recent").over(Window.partitionBy()))
    d = _annual(facts).filter("period >= 'CY2015'")
    d = d if not d.isEmpty() else recent.drop("recent", "any")
    d = d.select(_record().alias("a"))
    return _families(d, "SEC_DIRECT_XBRL_FACT", n, seed, [F.col("a.entity_id"), F.col("a.concept")], _q("What did ", F.col("a.entity_name"), " (CIK ", F.col("a.entity_id"), ") report as ", F.col("a.concept_label"), " for annual frame ", F.col("a.period"), ", in ", F.col("a.unit"), "?"), ["a"], ["target"], unit=F.col("a.unit"))


@template("SEC", "RETRIEVAL_CALCULATION")
def sec_operating_margin(facts: DataFrame, n: int, seed: str) -> DataFrame:
    annual = _annual(facts)
    revenue = annual.filter(F.col("concept").isin(*REVENUES)).withColumn("p", F.array_position(F.array(*map(F.lit, REVENUES)), F.col("concept")))
    revenue = selection.first_by(revenue, ["entity_id", "period"], "p", "record_id")
    d = _pair(annual.filter(F.col("concept") == OPERATING_INCOME), revenue, _eq("entity_id", "period"))
    return _families(d, "SEC_OPERATING_MARGIN", n, seed, [F.col("a.entity_id")], _q("What was the operating margin of ", F.col("a.entity_name"), " for frame ", F.col("a.period"), ": operating income over ", F.col("b.concept"), ", in percent to two decimals?"), ["a", "b"], ["numerator", "denominator"], "ratio_percent", kind="PERCENT", unit=F.lit("percent"), decimals=2)


@template("SEC", "RETRIEVAL_CALCULATION")
def sec_yoy_growth_percent(facts: DataFrame, n: int, seed: str) -> DataFrame:
    a = _annual(facts)
    d = _pair(a, a, _eq("entity_id", "concept") & (F.substring("a.period", 3, 4).try_cast("int") == F.substring("b.period", 3, 4).try_cast("int") + 1))
    return _families(d, "SEC_YOY_GROWTH_PERCENT", n, seed, [F.col("a.entity_id"), F.col("a.concept")], _q("By how many percent did ", F.col("a.concept_label"), " of ", F.col("a.entity_name"), " change from ", F.col("b.period"), " to ", F.col("a.period"), ", to two decimals?"), ["a", "b"], ["current", "previous"], "growth_percent", kind="PERCENT", unit=F.lit("percent"), decimals=2)


@template("SEC", "TEMPORAL_VERSION")
def sec_quarter_vs_annual_frame(facts: DataFrame, n: int, seed: str) -> DataFrame:
    quarters = _facts(facts, "SEC").filter(F.col("period").rlike(r"^CY\d{4}Q[1-3]$") & (F.col("unit") == "USD") & F.col("value_numeric").isNotNull())
    d = _pair(quarters, _annual(facts), _eq("entity_id", "concept") & (F.substring("a.period", 1, 6) == F.col("b.period")) & (F.col("a.value_numeric") != F.col("b.value_numeric")))
    return _families(d, "SEC_QUARTER_VS_ANNUAL_FRAME", n, seed, [F.col("a.entity_id"), F.col("a.concept")], _q("What was ", F.col("a.concept_label"), " of ", F.col("a.entity_name"), " for the single quarter ", F.col("a.period"), ", not for the year, in USD?"), ["a"], ["target"], unit=F.col("a.unit"), foils=F.array("b.record_id"))


@template("SEC", "TEMPORAL_VERSION")
def sec_filing_version_selection(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _facts(facts, "SEC").filter("value_numeric is not null and period_end <> ''")
    order = F.struct(F.coalesce(_meta("filed"), F.lit("")), F.col("record_id"))
    differ = lambda c: F.min(c) != F.max(c)  # noqa: E731  two distinct values, without a row for each count
    g = f.groupBy("entity_id", "concept", "unit", "period_start", "period_end").agg(differ(F.col("value_numeric")).alias("nv"), differ(_meta("accn")).alias("na"), F.max_by(_record(), order).alias("a"), F.min_by(_record(), order).alias("b")).filter("nv and na and a.value_numeric <> b.value_numeric")
    return _families(g, "SEC_FILING_VERSION_SELECTION", n, seed, [F.col("a.entity_id")], _q("Several filings of ", F.col("a.entity_name"), " state ", F.col("a.concept_label"), " for the period ending ", F.col("period_end"), ". What does the one filed last (", F.col("a.version"), ") state?"), ["a"], ["target"], unit=F.col("a.unit"), foils=F.array("b.record_id"))


@template("SEC", "ENTITY_UNIT_BINDING")
def sec_entity_binding(facts: DataFrame, n: int, seed: str) -> DataFrame:
    d = _binding(_annual(facts), ["concept", "period"], 3, "entity_id", "SEC_ENTITY_BINDING", seed)
    return _families(d, "SEC_ENTITY_BINDING", n, seed, [F.col("t.entity_id"), F.col("t.concept")], _q("Of the companies that report ", F.col("t.concept_label"), " for ", F.col("t.period"), ", what did ", F.col("t.entity_name"), " (CIK ", F.col("t.entity_id"), ") report?"), ["t"], ["target"], unit=F.col("t.unit"), foils=F.col("foil_ids"))


def _absent(entities: DataFrame, reported: DataFrame, concepts: DataFrame) -> DataFrame:
    """entity_id, entity_name, concept, concept_label that no fact reports; the concepts are a list that is collected per entity."""
    have = reported.groupBy("entity_id").agg(F.collect_set("concept").alias("have"))
    every = concepts.agg(F.collect_set(F.struct("concept", "concept_label")).alias("every"))
    d = entities.join(have, "entity_id", "left").crossJoin(F.broadcast(every))  # one row to the right
    missing = F.filter("every", lambda c: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), c["concept"]))
    return d.select("entity_id", "entity_name", F.explode(missing).alias("c")).select("entity_id", "entity_name", "c.concept", "c.concept_label")


@template("SEC", "UNANSWERABLE")
def sec_unanswerable_concept_or_period_absent(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _facts(facts, "SEC")
    d = _absent(selection.first_by(f.select("entity_id", "entity_name"), ["entity_id"], "entity_name"), f, selection.first_by(f.select("concept", "concept_label"), ["concept"], "concept_label"))
    return _families(d, "SEC_UNANSWERABLE_CONCEPT_OR_PERIOD_ABSENT", n, seed, [F.col("entity_id")], _q("What did ", F.col("entity_name"), " report as ", F.col("concept_label"), " for annual frame CY2023, in USD?"), [], [], absent={"entity_id": F.col("entity_id"), "concept": F.col("concept")})


@template("FDA", "DIRECT_RETRIEVAL")
def fda_direct_product_attribute(facts: DataFrame, n: int, seed: str) -> DataFrame:
    d = _facts(facts, "FDA").filter("concept = 'product.dosage_form'").select(_record().alias("a"), _meta("application_number").alias("app"))
    return _families(d, "FDA_DIRECT_PRODUCT_ATTRIBUTE", n, seed, [F.col("app")], _q("What is the dosage form of ", F.col("a.entity_name"), "?"), ["a"], ["target"], kind="CATEGORICAL", text=F.col("a.value"))


@template("FDA", "RETRIEVAL_CALCULATION")
def fda_product_count(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _facts(facts, "FDA").filter("concept = 'product.dosage_form'").withColumn("app", _meta("application_number"))
    g = f.groupBy("app").agg(F.array_sort(F.collect_list(_record())).alias("all"), F.size(F.collect_set("entity_id")).alias("n")).filter("n between 2 and 12").withColumn("a", F.element_at("all", 1))
    out = _families(g, "FDA_PRODUCT_COUNT", n, seed, [F.col("app")], _q("How many products are listed under application ", F.col("app"), "?"), ["a"], ["first"], gold=F.col("n").cast("double"), kind="INTEGER", unit=F.lit("products"), more={"every": F.col("all.record_id"), "total": F.col("n")})
    # every product is evidence and operand of the count
    out = out.withColumn("gold_ids", F.col("every")).withColumn("operation", F.lit("count")).withColumn("operand_ids", F.map_from_arrays(F.transform("every", lambda x, i: F.concat(F.lit("item_"), i.cast("string"))), F.col("every"))).withColumn("operands", F.transform_values("operand_ids", lambda k, v: F.lit(1.0))).withColumn("raw_result", F.col("total").cast("double"))
    return out.drop("every", "total")


@template("FDA", "RETRIEVAL_CALCULATION")
def fda_strength_ratio(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _facts(facts, "FDA").filter("record_type = 'drug_product_strength' and value_numeric > 0").withColumn("ing", _meta("ingredient_name"))
    order = lambda sign: F.struct(sign * F.col("value_numeric"), F.col("record_id"))
    g = f.groupBy("ing", "unit").agg(F.min_by(_record(), order(-1)).alias("a"), F.min_by(_record(), order(1)).alias("b")).filter("a.value_numeric > b.value_numeric and a.entity_id <> b.entity_id")
    return _families(g, "FDA_STRENGTH_RATIO", n, seed, [F.col("ing"), F.col("unit")], _q("How many times the strength of ", F.col("b.entity_name"), " is that of ", F.col("a.entity_name"), ", for ", F.col("ing"), " in ", F.col("unit"), ", to two decimals?"), ["a", "b"], ["numerator", "denominator"], "ratio", decimals=2, unit=F.lit("ratio"))


@template("FDA", "TEMPORAL_VERSION")
def fda_original_vs_supplement(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _facts(facts, "FDA").filter("record_type = 'drug_submission'")
    original = _meta("is_original") == "true"
    g = f.groupBy("entity_id").agg(F.min_by(F.when(original, _record()), F.when(original, F.struct("value", "record_id"))).alias("a"), F.count_if(~original).alias("n"), F.slice(F.array_sort(F.collect_list(F.when(~original, F.col("record_id")))), 1, 3).alias("foil_ids")).filter("n >= 2 and a is not null")
    return _families(g, "FDA_ORIGINAL_VS_SUPPLEMENT", n, seed, [F.col("entity_id")], _q("On which date did the original submission of application ", F.col("entity_id"), ", not a supplement, get its status?"), ["a"], ["target"], kind="DATE", text=F.col("a.value"), foils=F.col("foil_ids"))


@template("FDA", "ENTITY_UNIT_BINDING")
def fda_strength_product_binding(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _facts(facts, "FDA").filter("record_type = 'drug_product_strength' and value <> ''").withColumn("app", _meta("application_number"))
    d = _binding(f, ["app"], 3, "value", "FDA_STRENGTH_PRODUCT_BINDING", seed)
    extra = _facts(facts, "FDA").filter("concept in ('product.dosage_form', 'product.route')").groupBy("entity_id").agg(F.max(F.when(F.col("concept") == "product.dosage_form", F.col("value"))).alias("form"), F.max(F.when(F.col("concept") == "product.route", F.col("value"))).alias("route"))
    d = d.join(extra, F.col("t.entity_id") == F.col("entity_id"), "left")
    return _families(d, "FDA_STRENGTH_PRODUCT_BINDING", n, seed, [F.col("g0")], _q("Of the products under one application, what is the strength of ", F.col("t.entity_name"), F.coalesce(F.concat(F.lit(", "), "form"), F.lit("")), F.coalesce(F.concat(F.lit(", "), "route"), F.lit("")), "?"), ["t"], ["target"], kind="STRING", text=F.col("t.value"), foils=F.col("foil_ids"))


@template("FDA", "UNANSWERABLE")
def fda_unanswerable_attribute_absent(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _facts(facts, "FDA").filter("record_type = 'drug_product_attribute'")
    g = f.groupBy("entity_id").agg(F.max("entity_name").alias("name"), F.collect_set("concept").alias("have"))
    gone = F.filter(F.array(*map(F.lit, ABSENT_PRODUCT)), lambda c: ~F.array_contains("have", c))
    g = g.withColumn("concept", F.get(gone, F.lit(0))).filter("concept is not null")
    return _families(g, "FDA_UNANSWERABLE_ATTRIBUTE_ABSENT", n, seed, [F.col("entity_id")], _q("What is the ", F.replace(F.regexp_replace("concept", "^product[.]", ""), F.lit("_"), F.lit(" ")), " of ", F.col("name"), "?"), [], [], absent={"entity_id": F.col("entity_id"), "concept": F.col("concept")})


def _trials(facts: DataFrame) -> DataFrame:
    return _facts(facts, "CLINICAL_TRIALS")


def _enrollment(facts: DataFrame) -> DataFrame:
    return _trials(facts).filter("concept = 'enrollment.count' and value_numeric is not null")


@template("CLINICAL_TRIALS", "DIRECT_RETRIEVAL")
def ct_direct_enrollment(facts: DataFrame, n: int, seed: str) -> DataFrame:
    return _families(_enrollment(facts).select(_record().alias("a")), "CT_DIRECT_ENROLLMENT", n, seed, [F.col("a.entity_id")], _q("How many participants does trial ", F.col("a.entity_id"), " (", F.col("a.entity_name"), ") enroll?"), ["a"], ["target"], kind="INTEGER", unit=F.lit("participants"))


@template("CLINICAL_TRIALS", "RETRIEVAL_CALCULATION")
def ct_enrollment_difference(facts: DataFrame, n: int, seed: str) -> DataFrame:
    """Pairs within one first condition; every trial has one first condition, so none is used twice."""
    first = F.coalesce(F.nullif(F.split_part(_meta("conditions"), F.lit(", "), F.lit(1)), F.lit("")), F.lit("(unspecified)"))
    top = selection.ranked(_enrollment(facts).withColumn("cond", first), ["cond"], "k", "record_id").filter("k <= 2")
    g = top.groupBy("cond").agg(F.max_by(_record(), F.struct("value_numeric", "record_id")).alias("a"), F.min_by(_record(), F.struct("value_numeric", "record_id")).alias("b"), F.count("*").alias("n")).filter("n = 2 and a.value_numeric <> b.value_numeric")
    return _families(g, "CT_ENROLLMENT_DIFFERENCE", n, seed, [F.col("cond")], _q("How many more participants does trial ", F.col("a.entity_id"), " enroll than trial ", F.col("b.entity_id"), "?"), ["a", "b"], ["a", "b"], "difference", kind="INTEGER", unit=F.lit("participants"))


@template("CLINICAL_TRIALS", "RETRIEVAL_CALCULATION")
def ct_study_duration_days(facts: DataFrame, n: int, seed: str) -> DataFrame:
    full = _trials(facts).filter(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    d = _pair(full.filter("concept = 'study.primary_completion_date'"), full.filter("concept = 'study.start_date'"), _eq("entity_id")).filter(core.epoch_days(F.col("a.value")) > core.epoch_days(F.col("b.value")))
    return _families(d, "CT_STUDY_DURATION_DAYS", n, seed, [F.col("a.entity_id")], _q("How many days lie between the start of trial ", F.col("a.entity_id"), " and its primary completion?"), ["a", "b"], ["end", "start"], "days_between", kind="INTEGER", unit=F.lit("days"), operand=lambda e: core.epoch_days(e["value"]).cast("double"))


@template("CLINICAL_TRIALS", "ENTITY_UNIT_BINDING")
def ct_date_field_selection(facts: DataFrame, n: int, seed: str) -> DataFrame:
    target = "study.primary_completion_date"
    f = _trials(facts).filter(F.col("concept").isin(*DATES))
    g = f.groupBy("entity_id").agg(F.max(F.when(F.col("concept") == target, _record())).alias("a"), F.array_sort(F.collect_list(F.when(F.col("concept") != target, F.struct("record_id", "value")))).alias("others"))
    g = g.withColumn("others", F.filter("others", lambda x: x["value"] != F.col("a.value"))).filter("a is not null and size(others) >= 3")
    return _families(g, "CT_DATE_FIELD_SELECTION", n, seed, [F.col("entity_id")], _q("What is the primary completion date of trial ", F.col("entity_id"), "?"), ["a"], ["target"], kind="DATE", text=F.col("a.value"), foils=F.col("others.record_id"))


@template("CLINICAL_TRIALS", "ENTITY_UNIT_BINDING")
def ct_arm_type_binding(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _trials(facts).filter(F.col("concept") == "arm.type").filter(_meta("arm_label") != "")
    d = _binding(f, ["entity_id"], 2, "record_id", "CT_ARM_TYPE_BINDING", seed)
    return _families(d, "CT_ARM_TYPE_BINDING", n, seed, [F.col("g0")], _q("Of the arms of trial ", F.col("t.entity_id"), ", of which type is the one called ", F.regexp_replace("t.concept_label", "^Arm group type: ", ""), "?"), ["t"], ["target"], kind="CATEGORICAL", text=F.col("t.value"), foils=F.col("foil_ids"))


@template("CLINICAL_TRIALS", "UNANSWERABLE")
def ct_unanswerable_field_absent(facts: DataFrame, n: int, seed: str) -> DataFrame:
    g = _trials(facts).groupBy("entity_id").agg(F.max("entity_name").alias("name"), F.collect_set("concept").alias("have"), F.count("*").alias("n")).filter("n >= 8")
    gone = F.filter(F.array(*map(F.lit, ABSENT_STUDY)), lambda c: ~F.array_contains("have", c))
    g = g.withColumn("concept", F.get(gone, F.lit(0))).filter("concept is not null")
    return _families(g, "CT_UNANSWERABLE_FIELD_ABSENT", n, seed, [F.col("entity_id")], _q("What is the ", F.replace(F.regexp_replace("concept", "^[a-z]+[.]", ""), F.lit("_"), F.lit(" ")), " of trial ", F.col("entity_id"), " (", F.col("name"), ")?"), [], [], absent={"entity_id": F.col("entity_id"), "concept": F.col("concept")})


def _observed(facts: DataFrame) -> DataFrame:
    return _facts(facts, "FRED").filter("record_type = 'fred_observation' and value_numeric is not null")


def _series(r: str) -> Column:
    return _q("series ", F.col(f"{r}.concept"), " (", F.col(f"{r}.concept_label"), ", ", F.col(f"{r}.unit"), ")")


@template("FRED", "DIRECT_RETRIEVAL")
def fred_direct_observation(facts: DataFrame, n: int, seed: str) -> DataFrame:
    """Observations that were revised come first: the key order puts them before the others."""
    revised = _facts(facts, "FRED").filter("record_type = 'fred_vintage_observation'").select("concept", "period").distinct().withColumn("revised", F.lit(True))
    d = _observed(facts).filter("period >= '2015-01-01'").join(revised, ["concept", "period"], "left").select(_record().alias("a"), F.coalesce("revised", F.lit(False)).alias("revised"))
    ask = _q("What is the latest value of ", _series("a"), " for ", F.col("a.period"), "?")
    make = lambda x: _families(x, "FRED_DIRECT_OBSERVATION", n, seed, [F.col("a.concept"), F.col("a.period")], ask, ["a"], ["target"], unit=F.col("a.unit"))
    return make(d.filter("revised")).withColumn("o", F.lit(0)).unionByName(make(d.filter("not revised")).withColumn("o", F.lit(1))).orderBy("o", "family_id").limit(n).drop("o")


@template("FRED", "RETRIEVAL_CALCULATION")
def fred_percent_change(facts: DataFrame, n: int, seed: str) -> DataFrame:
    w = Window.partitionBy("concept").orderBy("period")
    o = _observed(facts).select(_record().alias("a"), "concept", "period", "value_numeric")
    o = o.withColumn("b", F.last(F.when(F.col("value_numeric") != 0, F.col("a")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    late = F.row_number().over(Window.partitionBy("concept").orderBy(F.col("period").desc()))
    o = o.withColumn("k", late).filter("b is not null and (period >= '2015-01-01' or k <= 24)")
    return _families(o, "FRED_PERCENT_CHANGE", n, seed, [F.col("a.concept"), F.col("a.period")], _q("By how many percent did ", _series("a"), " change from ", F.col("b.period"), " to ", F.col("a.period"), ", to two decimals?"), ["a", "b"], ["current", "previous"], "growth_percent", kind="PERCENT", unit=F.lit("percent"), decimals=2)


@template("FRED", "RETRIEVAL_CALCULATION")
def fred_series_spread(facts: DataFrame, n: int, seed: str) -> DataFrame:
    o = _observed(facts).filter("period >= '2015-01-01'")
    pairs = F.array(*[F.concat_ws("|", F.lit(a), F.lit(b)) for a, b in SPREADS])
    named = o.filter(F.col("concept").isin(*{x for p in SPREADS for x in p}))
    d = _pair(named, named, _eq("period", "unit") & F.array_contains(pairs, F.concat_ws("|", "a.concept", "b.concept")) & (F.col("a.value_numeric") != F.col("b.value_numeric")))
    return _families(d, "FRED_SERIES_SPREAD", n, seed, [F.col("a.concept"), F.col("b.concept"), F.col("a.period")], _q("How far does ", _series("a"), " lie above ", _series("b"), " for ", F.col("a.period"), ", to two decimals?"), ["a", "b"], ["a", "b"], "difference", unit=F.col("a.unit"), decimals=2)


@template("FRED", "TEMPORAL_VERSION")
def fred_vintage_selection(facts: DataFrame, n: int, seed: str) -> DataFrame:
    v = _facts(facts, "FRED").filter("record_type = 'fred_vintage_observation' and value_numeric is not null")
    g = v.groupBy("concept", "period").agg(F.countDistinct("value_numeric").alias("n"), F.min_by(_record(), "version").alias("a"), F.max_by(_record(), "version").alias("b")).filter("n >= 2")
    return _families(g, "FRED_VINTAGE_SELECTION", n, seed, [F.col("a.concept"), F.col("a.period")], _q("What did the release of ", F.regexp_replace("a.version", "^vintage:", ""), " state for ", _series("a"), " and ", F.col("a.period"), "?"), ["a"], ["target"], unit=F.col("a.unit"), foils=F.array("b.record_id"))


@template("FRED", "ENTITY_UNIT_BINDING")
def fred_basis_binding(facts: DataFrame, n: int, seed: str) -> DataFrame:
    f = _observed(facts).withColumn("fam", _meta("series_family")).filter("fam <> ''")
    d = _binding(f, ["fam", "period"], 2, "concept", "FRED_BASIS_BINDING", seed)
    return _families(d, "FRED_BASIS_BINDING", n, seed, [F.col("g0"), F.col("g1")], _q("Of the series that measure the same, what is the value of ", _series("t"), " for ", F.col("t.period"), "?"), ["t"], ["target"], unit=F.col("t.unit"), foils=F.col("foil_ids"))


def _unobserved(facts: DataFrame, name: str, n: int, seed: str, domain: str) -> DataFrame:
    """Missing observations without a valued twin; as many as max(200, 25 n) by record id are considered."""
    f = _facts(facts, domain)
    gone = f.filter("record_type = 'observation_missing'")
    twin = f.filter("value_numeric is not null").select("entity_id", "concept", "period")
    d = gone.join(twin, ["entity_id", "concept", "period"], "left_anti").orderBy("record_id").limit(max(200, 25 * n))
    return _families(d, name, n, seed, [F.col("concept"), F.col("period"), F.col("entity_id")], _q("What is the value of ", F.col("concept_label"), " (", F.col("concept"), ") of ", F.col("entity_name"), " for ", F.col("period"), "?"), [], [], absent={"entity_id": F.col("entity_id"), "concept": F.col("concept"), "period": F.col("period")})


@template("FRED", "UNANSWERABLE")
def fred_unanswerable_no_observation(facts: DataFrame, n: int, seed: str) -> DataFrame:
    return _unobserved(facts, "FRED_UNANSWERABLE_NO_OBSERVATION", n, seed, "FRED")


def _indicators(facts: DataFrame) -> DataFrame:
    return _facts(facts, "WORLD_BANK").filter("record_type = 'indicator_observation' and value_numeric is not null")


@template("WORLD_BANK", "DIRECT_RETRIEVAL")
def wb_direct_indicator_value(facts: DataFrame, n: int, seed: str) -> DataFrame:
    d = _indicators(facts).filter("period >= '2005'").select(_record().alias("a"))
    return _families(d, "WB_DIRECT_INDICATOR_VALUE", n, seed, [F.col("a.entity_id"), F.col("a.concept")], _q("What was ", F.col("a.concept_label"), " of ", F.col("a.entity_name"), " in ", F.col("a.period"), "?"), ["a"], ["target"], unit=F.col("a.unit"))


@template("WORLD_BANK", "RETRIEVAL_CALCULATION")
def wb_indicator_growth_percent(facts: DataFrame, n: int, seed: str) -> DataFrame:
    i = _indicators(facts)
    d = _pair(i, i, _eq("entity_id", "concept") & (F.col("a.period").try_cast("int") == F.col("b.period").try_cast("int") + 1))
    return _families(d, "WB_INDICATOR_GROWTH_PERCENT", n, seed, [F.col("a.entity_id"), F.col("a.concept")], _q("By how many percent did ", F.col("a.concept_label"), " of ", F.col("a.entity_name"), " change from ", F.col("b.period"), " to ", F.col("a.period"), ", to two decimals?"), ["a", "b"], ["current", "previous"], "growth_percent", kind="PERCENT", unit=F.lit("percent"), decimals=2)


@template("WORLD_BANK", "RETRIEVAL_CALCULATION")
def wb_cross_indicator_ratio(facts: DataFrame, n: int, seed: str) -> DataFrame:
    i = _indicators(facts)
    d = _pair(i.filter(F.col("concept") == GDP), i.filter(F.col("concept") == POPULATION), _eq("entity_id", "period"))
    return _families(d, "WB_CROSS_INDICATOR_RATIO", n, seed, [F.col("a.entity_id")], _q("What is ", F.col("a.concept_label"), " over ", F.col("b.concept_label"), " of ", F.col("a.entity_name"), " in ", F.col("a.period"), ", to two decimals?"), ["a", "b"], ["numerator", "denominator"], "ratio", unit=F.lit("US$ per person"), decimals=2)


@template("WORLD_BANK", "TEMPORAL_VERSION")
def wb_temporal_max_year(facts: DataFrame, n: int, seed: str) -> DataFrame:
    i = _indicators(facts).filter("period >= '2005'")
    four = selection.top_by(i, ["entity_id", "concept"], 4, core.order_key(seed, F.lit("years"), F.col("record_id")))
    g = four.groupBy("entity_id", "concept").agg(F.count("*").alias("n"), F.max("value_numeric").alias("top"), F.max_by(_record(), "value_numeric").alias("a"), F.array_sort(F.collect_list(F.struct("period", "value_numeric", "record_id"))).alias("years"))
    g = g.filter((F.col("n") == 4) & (F.size(F.filter("years", lambda y: y["value_numeric"] == F.col("top"))) == 1))
    return _families(g, "WB_TEMPORAL_MAX_YEAR", n, seed, [F.col("entity_id"), F.col("concept")], _q("In which of the years ", F.array_join("years.period", ", "), " was ", F.col("a.concept_label"), " of ", F.col("a.entity_name"), " highest?"), ["a"], ["target"], kind="STRING", text=F.col("a.period"), foils=F.array_except("years.record_id", F.array("a.record_id")))


@template("WORLD_BANK", "ENTITY_UNIT_BINDING")
def wb_unit_basis_binding(facts: DataFrame, n: int, seed: str) -> DataFrame:
    pairs = F.array(*[F.concat_ws("|", F.lit(a), F.lit(b)) for a, b in CONFUSABLE])
    i = _indicators(facts).filter(F.col("concept").isin(*{x for p in CONFUSABLE for x in p}))
    d = _pair(i, i, _eq("entity_id", "period") & F.array_contains(pairs, F.concat_ws("|", "a.concept", "b.concept")))
    return _families(d, "WB_UNIT_BASIS_BINDING", n, seed, [F.col("a.entity_id"), F.col("a.concept")], _q("What was ", F.col("a.concept_label"), ", not ", F.col("b.concept_label"), ", of ", F.col("a.entity_name"), " in ", F.col("a.period"), "?"), ["a"], ["target"], unit=F.col("a.unit"), foils=F.array("b.record_id"))


@template("WORLD_BANK", "UNANSWERABLE")
def wb_unanswerable_no_observation(facts: DataFrame, n: int, seed: str) -> DataFrame:
    return _unobserved(facts, "WB_UNANSWERABLE_NO_OBSERVATION", n, seed, "WORLD_BANK")


def generate(facts: DataFrame, domain: str, total: int, seed: str = "families", mix: dict[str, float] | None = None) -> DataFrame:
    """total families of a domain: shares of the question types by largest remainder, split over their templates; what a
    template can't fill goes to the others. Questions asked twice count once; ids are numbered within the domain."""
    kinds = facts.sparkSession.createDataFrame(sorted((mix or MIX).items()), "question_type string, weight double")
    want = {r.question_type: r.seats for r in selection.allocate_rows(kinds, "weight", total, least=1).collect()}  # one row a type
    parts = None
    for name, (d, kind, f) in TEMPLATES.items():
        if d == domain:
            # every template offers the whole, so that shares others leave open can be filled
            offer = f(facts, total, seed).withColumn("_quota", F.lit(want.get(kind, 0)))
            parts = offer if parts is None else parts.unionByName(offer)
    if parts is None:
        raise ValueError(f"no templates of domain {domain}")
    once = selection.first_by(kept(parts), ["question"], "template", "family_id")  # total rows a template at most, written once
    turn = F.row_number().over(Window.partitionBy("template").orderBy(core.order_key(seed, F.col("question"))))
    place = F.row_number().over(Window.partitionBy("question_type").orderBy("_turn", "template"))
    placed = once.withColumn("_turn", turn).withColumn("_place", place).withColumn("_over", F.col("_place") > F.col("_quota"))
    chosen = placed.orderBy("_over", "_place", "question_type", "question").limit(total)
    number = F.row_number().over(Window.orderBy("question_type", "template", "question"))
    return chosen.withColumn("family_id", F.format_string(f"{domain}_%04d", number)).drop("_quota", "_turn", "_place", "_over")
