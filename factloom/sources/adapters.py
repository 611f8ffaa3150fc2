"""Normalisation of raw payloads into facts: one function from a table of envelopes for each source.

Envelopes: path, request_url, retrieved_at, payload (the JSON text of the payload, or a CSV text). Facts have the columns
of FACT; of equal record ids the first in path and position order stays. Values that can't be verified are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import selection

FACT = ["record_id", "domain", "source", "entity_id", "entity_name", "record_type", "concept", "concept_label", "value", "value_numeric", "unit", "period", "period_start", "period_end", "version", "metadata", "raw_file", "raw_pointer", "retrieved_at"]
NULL = F.lit


def raw_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of JSON files; a corrupt file is an error."""
    raw = spark.read.schema("request_url string, retrieved_at string, payload string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), "request_url", "retrieved_at", "payload")


def _text(c: Column) -> Column:
    return c.cast("string")


def _map(**kv: Column) -> Column:
    """A metadata map without its null and empty entries."""
    pairs = F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), _text(v))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def _facts(df: DataFrame, order: list[str], **c: Column) -> DataFrame:
    """The FACT columns of df, the first of each record id in order."""
    named = {k: c.get(k, F.lit(None)) for k in FACT if k not in ("raw_file", "retrieved_at")}
    kinds = {"value_numeric": "double", "metadata": "map<string,string>"}
    out = df.select(*[v.cast(kinds.get(k, "string")).alias(k) for k, v in named.items()], F.col("path").alias("raw_file"), "retrieved_at", *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    return selection.first_by(out, ["record_id"], *[f"_o{i}" for i in range(len(order))]).select(*FACT)


SEC_FACT = "struct<val:string,start:string,end:string,accn:string,form:string,fy:string,fp:string,filed:string,frame:string>"


def sec(raw: DataFrame, concepts: tuple[str, ...] = ()) -> DataFrame:
    """Company facts: taxonomy -> tag -> unit -> list of facts."""
    schema = f"cik string, entityName string, facts map<string,map<string,struct<label:string,units:map<string,array<{SEC_FACT}>>>>>"
    d = raw.select("path", "retrieved_at", F.from_json("payload", schema).alias("p")).filter("p.facts is not null")
    d = d.select("path", "retrieved_at", F.lpad("p.cik", 10, "0").alias("cik"), F.col("p.entityName").alias("name"), F.posexplode("p.facts").alias("o1", "taxonomy", "tags"))
    d = d.select("*", F.posexplode("tags").alias("o2", "tag", "data")).drop("tags")
    if concepts:
        d = d.filter(F.col("tag").isin(*concepts))
    d = d.select("*", F.posexplode("data.units").alias("o3", "unit", "list")).select("*", F.posexplode("list").alias("i", "f")).drop("list")
    value, form, accn, frame, start, end = core.canonical_number(F.col("f.val")), F.col("f.form"), F.col("f.accn"), F.col("f.frame"), F.col("f.start"), F.col("f.end")
    d = d.filter(value.isNotNull() & F.coalesce(end != "", F.lit(False)))
    period = core.period_label(frame, start, end)
    version = F.when(accn.isNotNull(), F.concat_ws("|", form, accn)).otherwise(form)
    return _facts(
        d, ["path", "o1", "o2", "o3", "i"], record_id=core.record_id("SEC", F.col("cik"), F.col("tag"), F.col("unit"), period, accn), domain=F.lit("SEC"), source=F.lit("SEC_COMPANYFACTS"), entity_id=F.col("cik"), entity_name=F.coalesce("name", "cik"), record_type=F.lit("xbrl_fact"),
        concept=F.concat_ws(":", "taxonomy", "tag"), concept_label=F.coalesce(F.nullif(F.col("data.label"), F.lit("")), "tag"), value=F.col("f.val"), value_numeric=value, unit=F.col("unit"), period=period, period_start=start, period_end=end, version=version,
        metadata=_map(tag=F.col("tag"), taxonomy=F.col("taxonomy"), form=form, accn=accn, fy=F.col("f.fy"), fp=F.col("f.fp"), filed=F.col("f.filed"), frame=frame, has_frame=(F.coalesce(frame, F.lit("")) != ""), period_kind=core.period_kind(frame, start), is_amendment=F.coalesce(form.endswith("/A"), F.lit(False))),
        raw_pointer=F.format_string("$.facts.%s.%s.units.%s[%d]", "taxonomy", "tag", "unit", "i"),
    )


# Attributes of a product that become facts.
PRODUCT_FIELDS = {
    "brand_name": "Brand name",
    "dosage_form": "Dosage form",
    "route": "Route of administration",
    "marketing_status": "Marketing status",
    "reference_drug": "Reference listed drug",
    "reference_standard": "Reference standard",
}


def fda(raw: DataFrame) -> DataFrame:
    """Drug applications: product attributes (unpivoted), ingredient strengths, submissions."""
    product = "struct<product_number:string,brand_name:string,dosage_form:string,route:string,marketing_status:string,reference_drug:string,reference_standard:string,active_ingredients:array<struct<name:string,strength:string>>>"
    submission = "struct<submission_type:string,submission_number:string,submission_status:string,submission_status_date:string,submission_class_code:string,review_priority:string>"
    schema = f"results array<struct<application_number:string,sponsor_name:string,products:array<{product}>,submissions:array<{submission}>>>"
    a = raw.select("path", "retrieved_at", F.posexplode(F.from_json("payload", schema)["results"]).alias("ai", "a")).filter("a.application_number <> ''")
    app, sponsor = F.col("a.application_number"), F.coalesce(F.nullif(F.col("a.sponsor_name"), F.lit("")), F.lit("UNKNOWN SPONSOR"))
    p = a.select("*", F.posexplode("a.products").alias("pi", "p")).filter("p is not null")
    number = F.coalesce(F.nullif(F.col("p.product_number"), F.lit("")), _text(F.col("pi")))
    brand = F.coalesce(F.nullif(F.col("p.brand_name"), F.lit("")), F.lit("(no brand name)"))
    entity, name = F.concat_ws("/", app, number), F.concat(brand, F.lit(" ("), app, F.lit(", product "), number, F.lit(")"))
    kind = F.nullif(F.regexp_replace(F.substring(app, 1, 4), "[0-9]+$", ""), F.lit(""))
    meta = dict(application_number=app, product_number=number, sponsor_name=sponsor, brand_name=brand, active_ingredients=F.array_join("p.active_ingredients.name", ", "), dosage_form=F.col("p.dosage_form"), route=F.col("p.route"), marketing_status=F.col("p.marketing_status"), application_type=kind)
    common = dict(domain=F.lit("FDA"), source=F.lit("OPENFDA_DRUGSFDA"))
    fields = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("label"), F.col(f"p.{k}").alias("v")) for k, v in PRODUCT_FIELDS.items()])
    attr = p.select("*", F.posexplode(fields).alias("k", "x")).filter("x.v <> ''")
    concept = F.concat(F.lit("product."), F.col("x.key"))
    attributes = _facts(attr, ["path", "ai", "pi", "k"], record_id=core.record_id("FDA", app, number, concept), entity_id=entity, entity_name=name, record_type=F.lit("drug_product_attribute"), concept=concept, concept_label=F.col("x.label"), value=F.col("x.v"), metadata=_map(**meta, field=F.col("x.key")), raw_pointer=F.format_string("$.results[%d].products[%d].%s", "ai", "pi", "x.key"), **common)
    ing = p.select("*", F.posexplode("p.active_ingredients").alias("ii", "g")).filter("g is not null")
    strengths = _facts(ing, ["path", "ai", "pi", "ii"], record_id=core.record_id("FDA", app, number, F.lit("strength"), F.col("g.name"), F.col("ii")), entity_id=entity, entity_name=name, record_type=F.lit("drug_product_strength"), concept=F.lit("product.active_ingredient_strength"), concept_label=F.concat(F.lit("Strength of "), F.coalesce("g.name", F.lit("?"))), value=F.col("g.strength"), value_numeric=core.strength_magnitude(F.col("g.strength")), unit=core.strength_unit(F.col("g.strength")), metadata=_map(**meta, ingredient_name=F.col("g.name"), ingredient_index=F.col("ii"), strength_raw=F.col("g.strength")), raw_pointer=F.format_string("$.results[%d].products[%d].active_ingredients[%d].strength", "ai", "pi", "ii"), **common)
    s = a.select("*", F.posexplode("a.submissions").alias("si", "s"))
    date, st, sn = core.canonical_date(F.col("s.submission_status_date")), F.col("s.submission_type"), F.col("s.submission_number")
    s = s.filter((date != "") & (st != ""))
    submissions = _facts(s, ["path", "ai", "si"], record_id=core.record_id("FDA", app, F.lit("submission"), st, sn), entity_id=app, entity_name=F.concat(sponsor, F.lit(" application "), app), record_type=F.lit("drug_submission"), concept=F.lit("submission.status_date"), concept_label=F.concat_ws(" ", st, F.lit("submission"), sn, F.lit("status date")), value=date, period=F.substring(date, 1, 4), period_end=date, version=F.concat_ws("-", st, sn), metadata=_map(application_number=app, sponsor_name=sponsor, submission_type=st, submission_number=sn, submission_status=F.col("s.submission_status"), submission_class_code=F.col("s.submission_class_code"), review_priority=F.col("s.review_priority"), is_original=st == "ORIG"), raw_pointer=F.format_string("$.results[%d].submissions[%d]", "ai", "si"), **common)
    return attributes.unionByName(strengths).unionByName(submissions)


# Path, concept, label and kind of a study's plain fields.
STUDY_FIELDS = (
    ("statusModule.overallStatus", "study.overall_status", "Overall recruitment status", "string"),
    ("statusModule.startDateStruct.date", "study.start_date", "Study start date", "date"),
    ("statusModule.primaryCompletionDateStruct.date", "study.primary_completion_date", "Primary completion date", "date"),
    ("statusModule.completionDateStruct.date", "study.completion_date", "Study completion date", "date"),
    ("statusModule.studyFirstPostDateStruct.date", "study.first_posted_date", "Study first posted date", "date"),
    ("statusModule.lastUpdatePostDateStruct.date", "study.last_update_posted_date", "Last update posted date", "date"),
    ("statusModule.resultsFirstPostDateStruct.date", "study.results_first_posted_date", "Results first posted date", "date"),
    ("designModule.studyType", "study.study_type", "Study type", "string"),
    ("designModule.designInfo.allocation", "design.allocation", "Allocation", "string"),
    ("designModule.designInfo.interventionModel", "design.intervention_model", "Intervention model", "string"),
    ("designModule.designInfo.primaryPurpose", "design.primary_purpose", "Primary purpose", "string"),
    ("designModule.designInfo.maskingInfo.masking", "design.masking", "Masking", "string"),
    ("eligibilityModule.sex", "eligibility.sex", "Eligible sex", "string"),
    ("eligibilityModule.minimumAge", "eligibility.minimum_age", "Minimum eligible age", "string"),
    ("eligibilityModule.maximumAge", "eligibility.maximum_age", "Maximum eligible age", "string"),
    ("eligibilityModule.healthyVolunteers", "eligibility.healthy_volunteers", "Accepts healthy volunteers", "bool"),
    ("sponsorCollaboratorsModule.leadSponsor.name", "sponsor.lead_sponsor", "Lead sponsor", "string"),
)


def clinical_trials(raw: DataFrame) -> DataFrame:
    """Studies, read as VARIANT: plain fields, enrollment, phases, arms, interventions, outcomes, conditions."""
    studies = raw.select("path", "retrieved_at", F.try_parse_json("payload").alias("v")).filter("v is not null")
    studies = studies.select("path", "retrieved_at", F.posexplode(F.expr("try_variant_get(v, '$.studies', 'array<variant>')")).alias("si", "s"))
    get = lambda path, kind="string", of="s", at="$.protocolSection.": F.try_variant_get(F.col(of), f"{at}{path}", kind)
    d = studies.withColumn("nct", get("identificationModule.nctId")).filter("nct <> ''")
    updated = get("statusModule.lastUpdatePostDateStruct.date")
    d = d.withColumn("title", F.coalesce(F.nullif(get("identificationModule.briefTitle"), F.lit("")), "nct")).withColumn("status", get("statusModule.overallStatus"))
    d = d.withColumn("conditions", get("conditionsModule.conditions", "array<string>")).withColumn("phases", get("designModule.phases", "array<string>")).withColumn("sponsor", get("sponsorCollaboratorsModule.leadSponsor.name")).withColumn("version", F.concat(F.lit("lastupdate:"), updated))

    def make(df: DataFrame, order: list[str], concept: Column, label: Column, value: Column, kind: str, pointer: Column, key: tuple[Column, ...] = (), numeric: Column | None = None, unit: str | None = None, period: Column | None = None, **extra: Column) -> DataFrame:
        meta = _map(nct_id=F.col("nct"), brief_title=F.col("title"), overall_status=F.col("status"), conditions=F.array_join("conditions", ", "), phases=F.array_join("phases", "/"), lead_sponsor=F.col("sponsor"), **extra)
        return _facts(df, ["path", "si", *order], record_id=core.record_id("CT", F.col("nct"), concept, *key), domain=F.lit("CLINICAL_TRIALS"), source=F.lit("CLINICALTRIALS_V2"), entity_id=F.col("nct"), entity_name=F.col("title"), record_type=F.lit(kind), concept=concept, concept_label=label, value=value, value_numeric=F.lit(None) if numeric is None else numeric, unit=F.lit(unit), period=F.lit(None) if period is None else period, version=F.col("version"), metadata=meta, raw_pointer=F.concat(F.format_string("$.studies[%d].protocolSection.", "si"), pointer))

    count = core.canonical_number(get("designModule.enrollmentInfo.count"))
    out = [make(d.withColumn("n", count).filter("n is not null"), [], F.lit("enrollment.count"), F.lit("Enrollment (participants)"), _text(F.col("n")), "trial_field", F.lit("designModule.enrollmentInfo.count"), numeric=F.col("n"), unit="participants", enrollment_type=get("designModule.enrollmentInfo.type"))]
    fields = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(concept).alias("concept"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), get(path).alias("raw")) for path, concept, label, kind in STUDY_FIELDS])
    f = d.select("*", F.posexplode(fields).alias("k", "f")).filter("f.raw <> ''")
    value = F.when(F.col("f.kind") == "date", core.canonical_date(F.col("f.raw"))).when(F.col("f.kind") == "bool", F.when(F.lower("f.raw") == "true", "Yes").otherwise("No")).otherwise(F.col("f.raw"))
    out.append(make(f, ["k"], F.col("f.concept"), F.col("f.label"), value, "trial_field", F.col("f.path"), period=F.when(F.col("f.kind") == "date", F.substring(value, 1, 4)), field_kind=F.col("f.kind")))
    out.append(make(d.filter(F.size("phases") > 0), [], F.lit("study.phase"), F.lit("Study phase"), F.array_join("phases", "/"), "trial_field", F.lit("designModule.phases")))
    arms = d.withColumn("list", get("armsInterventionsModule.armGroups", "array<variant>"))
    n_arms = F.size("list").cast("double")
    out.append(make(arms.filter(F.size("list") > 0), [], F.lit("arms.count"), F.lit("Number of arm groups"), _text(n_arms), "trial_field", F.lit("armsInterventionsModule.armGroups"), numeric=n_arms, unit="arms"))

    def listed(path: str, first: str, second: str) -> DataFrame:
        x = d.select("*", F.posexplode(get(path, "array<variant>")).alias("i", "x"))
        return x.withColumn("a", get(first, of="x", at="$.")).withColumn("b", get(second, of="x", at="$.")).filter("a <> '' and b <> ''")

    x = listed("armsInterventionsModule.armGroups", "label", "type")
    out.append(make(x, ["i"], F.lit("arm.type"), F.concat(F.lit("Arm group type: "), "a"), F.col("b"), "trial_arm", F.format_string("armsInterventionsModule.armGroups[%d]", "i"), key=(F.col("a"), F.col("i")), arm_label=F.col("a"), arm_index=F.col("i")))
    x = listed("armsInterventionsModule.interventions", "name", "type")
    out.append(make(x, ["i"], F.lit("intervention.type"), F.concat(F.lit("Intervention: "), "a"), F.col("b"), "trial_intervention", F.format_string("armsInterventionsModule.interventions[%d]", "i"), key=(F.col("a"), F.col("i")), intervention_name=F.col("a"), intervention_index=F.col("i")))
    for kind in ("primary", "secondary"):
        x = listed(f"outcomesModule.{kind}Outcomes", "measure", "timeFrame")
        out.append(make(x, ["i"], F.lit(f"outcome.{kind}.timeframe"), F.concat(F.lit(f"{kind.capitalize()} outcome timeframe: "), "a"), F.col("b"), "trial_outcome", F.format_string(f"outcomesModule.{kind}Outcomes[%d]", "i"), key=(F.lit(kind), F.col("i")), outcome_measure=F.col("a"), outcome_kind=F.lit(kind), outcome_index=F.col("i")))
    c = d.select("*", F.posexplode("conditions").alias("i", "c"))
    out.append(make(c, ["i"], F.lit("study.condition"), F.lit("Studied condition"), F.col("c"), "trial_field", F.format_string("conditionsModule.conditions[%d]", "i"), key=(F.col("i"),), condition_index=F.col("i")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def fred(raw: DataFrame, catalog: DataFrame, start: str | None = "1990-01-01", vintage_start: str | None = "2018-01-01") -> DataFrame:
    """CSV payloads, wide by series (current) or by series and vintage, melted and joined to the catalog of series:
    id, title, units, frequency, seasonal_adjustment, family, geo_code, geo_name."""
    d = raw.filter("payload is not null").select("path", "retrieved_at", F.coalesce("request_url", F.lit("")).contains("alfredgraph").alias("is_vintage"), F.filter(F.split("payload", "\r?\n"), lambda x: x != "").alias("lines"))
    d = d.filter(F.size("lines") > 1).withColumn("header", F.split(F.element_at("lines", 1), ","))
    d = d.select("path", "retrieved_at", "is_vintage", "header", F.posexplode(F.slice("lines", 2, 100_000_000)).alias("row", "line")).withColumn("cells", F.split("line", ",")).filter(F.size("cells") > 1)
    d = d.select("path", "retrieved_at", "is_vintage", "row", F.element_at("cells", 1).alias("date"), F.posexplode(F.arrays_zip(F.slice("header", 2, 100_000).alias("name"), F.slice("cells", 2, 100_000).alias("raw"))).alias("col", "x")).filter("x.raw is not null and x.name is not null")
    split = F.col("is_vintage") & F.col("x.name").rlike(r"^.*_\d{8}$")
    tail = F.regexp_extract("x.name", r"_(\d{8})$", 1)
    d = d.withColumn("id", F.when(split, F.regexp_extract("x.name", r"^(.*)_\d{8}$", 1)).otherwise(F.col("x.name"))).withColumn("vintage", F.when(split, core.canonical_date(tail)))
    iso, missing, value = core.canonical_date(F.col("date")), core.is_missing(F.col("x.raw")), core.canonical_number(F.col("x.raw"))
    d = d.join(F.broadcast(catalog), "id").filter((iso != "") & (missing | value.isNotNull()))
    if start:
        d = d.filter(iso >= start)
    if vintage_start:
        d = d.filter(~F.col("is_vintage") | (iso >= vintage_start))
    value = F.when(~missing, value)
    kind = F.when(F.col("vintage").isNotNull(), "fred_vintage_observation").when(missing, "observation_missing").otherwise("fred_observation")
    label = F.when(F.coalesce("seasonal_adjustment", F.lit("")) != "", F.concat("title", F.lit(" ("), "seasonal_adjustment", F.lit(")"))).otherwise(F.col("title"))
    return _facts(
        d, ["path", "col", "row"], record_id=core.record_id("FRED", F.col("id"), iso, F.coalesce("vintage", F.lit("latest"))), domain=F.lit("FRED"), source=F.lit("FRED_STLOUISFED"), entity_id=F.coalesce("geo_code", F.lit("US")), entity_name=F.coalesce("geo_name", F.lit("United States")), record_type=kind,
        concept=F.col("id"), concept_label=label, value=_text(value), value_numeric=value, unit=F.col("units"), period=iso, period_start=iso, period_end=iso, version=F.when(F.col("vintage").isNotNull(), F.concat(F.lit("vintage:"), "vintage")).otherwise("latest"),
        metadata=_map(series_id=F.col("id"), series_title=F.col("title"), series_family=F.col("family"), frequency=F.col("frequency"), seasonal_adjustment=F.col("seasonal_adjustment"), geography_code=F.col("geo_code"), geography_name=F.col("geo_name"), vintage_date=F.col("vintage"), is_vintage=F.col("vintage").isNotNull(), no_data=missing),
        raw_pointer=F.format_string("$.payload[row=%d,col=%d]", "row", "col"),
    )


def world_bank(raw: DataFrame, indicators: tuple[str, ...] = (), countries: tuple[str, ...] = (), years: tuple[int, int] | None = None) -> DataFrame:
    """Observations [page info, [observation ...]]; null values stay as missing observations."""
    pair = "struct<id:string,value:string>"
    schema = f"array<struct<indicator:{pair},country:{pair},countryiso3code:string,date:string,value:string,unit:string,obs_status:string,decimal:string>>"
    d = raw.select("path", "retrieved_at", F.try_parse_json("payload").alias("v")).filter("v is not null")
    d = d.select("path", "retrieved_at", F.posexplode(F.expr("try_variant_get(v, '$[1]', 'array<variant>')")).alias("i", "x"))
    d = d.select("path", "retrieved_at", "i", F.element_at(F.from_json(F.concat(F.lit("["), F.to_json("x"), F.lit("]")), schema), 1).alias("o")).filter("o is not null")
    iso3 = F.coalesce(F.nullif(F.col("o.countryiso3code"), F.lit("")), "o.country.id")
    d = d.filter((F.col("o.indicator.id") != "") & (iso3 != "") & (F.col("o.date") != ""))
    if indicators:
        d = d.filter(F.col("o.indicator.id").isin(*indicators))
    if countries:
        d = d.filter(iso3.isin(*countries))
    if years:
        year = F.col("o.date").try_cast("int")
        d = d.filter(year.isNull() | year.between(*years))
    missing, value = F.col("o.value").isNull(), core.canonical_number(F.col("o.value"))
    unit = F.coalesce(F.nullif(F.col("o.unit"), F.lit("")), core.unit_of_name(F.col("o.indicator.value")))
    return _facts(
        d, ["path", "i"], record_id=core.record_id("WB", iso3, F.col("o.indicator.id"), F.col("o.date")), domain=F.lit("WORLD_BANK"), source=F.lit("WORLD_BANK_INDICATORS_V2"), entity_id=iso3, entity_name=F.coalesce("o.country.value", iso3), record_type=F.when(missing, "observation_missing").otherwise("indicator_observation"),
        concept=F.col("o.indicator.id"), concept_label=F.coalesce("o.indicator.value", "o.indicator.id"), value=F.when(~missing, F.col("o.value")), value_numeric=F.when(~missing, value), unit=unit, period=F.col("o.date"), period_start=F.concat("o.date", F.lit("-01-01")), period_end=F.concat("o.date", F.lit("-12-31")),
        metadata=_map(country_iso2=F.col("o.country.id"), indicator_id=F.col("o.indicator.id"), indicator_name=F.col("o.indicator.value"), obs_status=F.col("o.obs_status"), decimal=F.col("o.decimal"), no_data=missing, aggregation_level=F.lit("country")), raw_pointer=F.format_string("$[1][%d]", "i"),
    )


#: Adapters that need no more than envelopes; fred takes its catalog.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"SEC": sec, "FDA": fda, "CLINICAL_TRIALS": clinical_trials, "FRED": fred, "WORLD_BANK": world_bank}
