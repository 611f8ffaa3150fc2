"""Queries of the adapters: payloads of each source's shape are made of the driver's tables by Spark, written, read again
through the payload source, and normalised; SQL gives the facts straight from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.sources import payloads
from factloom.sources.envelope import read
from factloom.sources.shared import kept, shared_folder

SHOWN = ["record_id", "entity_id", "entity_name", "record_type", "concept", "concept_label", "value", "value_numeric", "unit", "period", "period_start", "period_end", "version"]


def _through(spark: SparkSession, sf_dir: str, domain: str, payload: DataFrame, **params) -> DataFrame:
    """payload: url and payload, a JSON text or (of CSV) a string; both become envelopes, one a line."""
    root = shared_folder(spark)
    text = F.to_json(F.struct(F.col("url").alias("request_url"), F.lit("2024-01-01").alias("retrieved_at"), "payload"))
    payload.select(text.alias("value")).write.text(f"{root}/{domain.lower()}")
    return kept(payloads.load(spark, root, domain, lines=True, **params).select(*SHOWN))


def _facts_sql(with_: str, select: str, prefix: str, *key: str, **columns: str) -> str:
    """SQL of SHOWN: key are the parts of the record id, columns what isn't null."""
    slug = lambda p: f"nullif(trim(regexp_replace(coalesce(({p})::VARCHAR, ''), '[^A-Za-z0-9]+', '-', 'g'), '-'), '')"
    raw = " || '|' || ".join([f"'{prefix}'", *[f"coalesce(({p})::VARCHAR, '')" for p in key]])
    record = f"concat_ws('_', '{prefix}', {', '.join(map(slug, key))}, substr(sha1({raw}), 1, 8))"
    of = lambda c: columns.get(c, "NULL::DOUBLE" if c == "value_numeric" else "NULL::VARCHAR")
    return f"{with_} SELECT {record} AS record_id, {', '.join(f'{of(c)} AS {c}' for c in SHOWN[1:])} {select}"


def _json(c: Column) -> Column:
    return F.to_json(c)


SEC_SQL = _facts_sql(
    """WITH o AS (SELECT o.*, lpad(o_custkey::VARCHAR, 10, '0') AS cik, c_name, 'Revenue' || o_orderstatus AS tag, strftime(o_orderdate, '%Y-%m-%d') AS d, o_totalprice::VARCHAR AS val,
  CASE WHEN o_orderkey % 2 = 0 THEN 'CY' || year(o_orderdate) || 'Q' || quarter(o_orderdate) END AS frame, CASE WHEN o_orderpriority LIKE '5%' THEN '10-K/A' ELSE '10-K' END AS form FROM orders o JOIN customer ON c_custkey = o_custkey)""",
    "FROM o", "SEC", "cik", "tag", "'USD'", "coalesce(frame, strftime(o_orderdate - INTERVAL 90 DAY, '%Y-%m-%d') || '..' || d)", "o_orderkey",
    entity_id="cik", entity_name="c_name", record_type="'xbrl_fact'", concept="'us-gaap:' || tag", concept_label="'Revenue of state ' || o_orderstatus", value="val", value_numeric="val::DOUBLE", unit="'USD'",
    period="coalesce(frame, strftime(o_orderdate - INTERVAL 90 DAY, '%Y-%m-%d') || '..' || d)", period_start="strftime(o_orderdate - INTERVAL 90 DAY, '%Y-%m-%d')", period_end="d", version="form || '|' || o_orderkey",
)


@query(SEC_SQL)
def adapter_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies, their orders as reported facts by state."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    frame = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CY"), F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    form = F.when(F.col("o_orderpriority").startswith("5"), "10-K/A").otherwise("10-K")
    # A fact without an end and one without a number are dropped by the adapter.
    fact = F.struct(F.col("o_totalprice").alias("val"), day(F.date_sub("o_orderdate", 90)).alias("start"), day("o_orderdate").alias("end"), F.col("o_orderkey").cast("string").alias("accn"), form.alias("form"), F.year("o_orderdate").alias("fy"), F.lit("FY").alias("fp"), frame.alias("frame"))
    by_tag = o.groupBy("o_custkey", "c_name", "o_orderstatus").agg(F.collect_list(fact).alias("facts"))
    tag = F.struct(F.concat(F.lit("Revenue"), "o_orderstatus").alias("key"), F.struct(F.concat(F.lit("Revenue of state "), "o_orderstatus").alias("label"), F.create_map(F.lit("USD"), "facts").alias("units")).alias("value"))
    one = by_tag.groupBy("o_custkey", "c_name").agg(F.map_from_entries(F.collect_list(tag)).alias("tags"))
    body = F.struct(F.col("o_custkey").alias("cik"), F.col("c_name").alias("entityName"), F.create_map(F.lit("us-gaap"), "tags").alias("facts"))
    return _through(spark, sf_dir, "SEC", one.select(F.concat(F.lit("companies/"), F.col("o_custkey").cast("string")).alias("url"), _json(body).alias("payload")), contact="tests@example.org")


_PART = "WITH p AS (SELECT *, 'NDA' || p_partkey AS app, 'Maker ' || p_brand AS sponsor, p_size || ' MG' AS strength, 2000 + (p_partkey % 20) AS y FROM part)"
_FDA_FIELDS = [("brand_name", "Brand name", "p_name"), ("dosage_form", "Dosage form", "p_type"), ("route", "Route of administration", "p_brand"), ("marketing_status", "Marketing status", "CASE WHEN p_size % 5 > 0 THEN 'Rx' END")]
_DRUG = dict(entity_id="app || '/001'", entity_name="p_name || ' (' || app || ', product 001)'")
FDA_SQL = "\nUNION ALL\n".join(
    [f"SELECT * FROM ({_facts_sql(_PART, f'FROM p WHERE {e} IS NOT NULL', 'FDA', 'app', repr('001'), repr(f'product.{k}'), **_DRUG, record_type=repr('drug_product_attribute'), concept=repr(f'product.{k}'), concept_label=repr(label), value=e)})" for k, label, e in _FDA_FIELDS]
    + [
        f"SELECT * FROM ({_facts_sql(_PART, 'FROM p', 'FDA', 'app', repr('001'), repr('strength'), 'p_brand', '0', **_DRUG, record_type=repr('drug_product_strength'), concept=repr('product.active_ingredient_strength'), concept_label=repr('Strength of ') + ' || p_brand', value='strength', value_numeric='p_size::DOUBLE', unit=repr('MG'))})",
        f"""SELECT * FROM ({_facts_sql(_PART, "FROM p", 'FDA', 'app', "'submission'", "'ORIG'", "'1'", entity_id='app', entity_name="sponsor || ' application ' || app", record_type="'drug_submission'", concept="'submission.status_date'", concept_label="'ORIG submission 1 status date'", value="y || '-03-15'", period="y::VARCHAR", period_end="y || '-03-15'", version="'ORIG-1'")})""",
    ]
)


@query(FDA_SQL)
def adapter_fda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drug applications with a product, its strength and a submission."""
    p = read(spark, sf_dir, "part")
    app = F.concat(F.lit("NDA"), F.col("p_partkey").cast("string"))
    product = F.struct(F.lit("001").alias("product_number"), F.col("p_name").alias("brand_name"), F.col("p_type").alias("dosage_form"), F.col("p_brand").alias("route"), F.when(F.col("p_size") % 5 > 0, "Rx").alias("marketing_status"), F.array(F.struct(F.col("p_brand").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(" MG")).alias("strength"))).alias("active_ingredients"))
    date = F.concat((2000 + F.col("p_partkey") % 20).cast("string"), F.lit("0315"))
    submissions = F.array(F.struct(F.lit("ORIG").alias("submission_type"), F.lit("1").alias("submission_number"), F.lit("AP").alias("submission_status"), date.alias("submission_status_date")), F.struct(F.lit("SUPPL").alias("submission_type"), F.lit("9").alias("submission_number"), F.lit("TA").alias("submission_status"), F.lit("").alias("submission_status_date")))
    body = F.struct(F.array(F.struct(app.alias("application_number"), F.concat(F.lit("Maker "), "p_brand").alias("sponsor_name"), F.array(product).alias("products"), submissions.alias("submissions"))).alias("results"))
    return _through(spark, sf_dir, "FDA", p.select(F.concat(F.lit("drugs/"), app).alias("url"), _json(body).alias("payload")))


_STUDY = "WITH s AS (SELECT *, 'NCT' || s_suppkey AS nct, 'lastupdate:2021-' || lpad((1 + s_suppkey % 12)::VARCHAR, 2, '0') || '-01' AS v, 2010 + s_suppkey % 9 AS y, floor(abs(s_acctbal))::BIGINT AS n FROM supplier)"


def _study_sql(where: str, *key: str, kind: str = "trial_field", **c: str) -> str:
    return f"SELECT * FROM ({_facts_sql(_STUDY, where, 'CT', 'nct', c['concept'], *key, entity_id='nct', entity_name='s_name', record_type=repr(kind), version='v', **c)})"


CT_SQL = "\nUNION ALL\n".join([
    _study_sql("FROM s", concept="'enrollment.count'", concept_label="'Enrollment (participants)'", value="(n::DOUBLE)::VARCHAR", value_numeric="n::DOUBLE", unit="'participants'"),
    _study_sql("FROM s", concept="'study.overall_status'", concept_label="'Overall recruitment status'", value="CASE WHEN s_suppkey % 2 = 0 THEN 'COMPLETED' ELSE 'RECRUITING' END"),
    _study_sql("FROM s", concept="'study.start_date'", concept_label="'Study start date'", value="y || '-02-01'", period="y::VARCHAR"),
    _study_sql("FROM s", concept="'study.last_update_posted_date'", concept_label="'Last update posted date'", value="substr(v, 12)", period="'2021'"),
    _study_sql("FROM s WHERE s_suppkey % 3 > 0", concept="'eligibility.healthy_volunteers'", concept_label="'Accepts healthy volunteers'", value="CASE WHEN s_suppkey % 3 = 1 THEN 'Yes' ELSE 'No' END"),
    _study_sql("FROM s", concept="'study.phase'", concept_label="'Study phase'", value="CASE WHEN s_suppkey % 2 = 0 THEN 'PHASE1/PHASE2' ELSE 'PHASE3' END"),
    _study_sql("FROM s", concept="'arms.count'", concept_label="'Number of arm groups'", value="(1.0 + s_suppkey % 2)::DOUBLE::VARCHAR", value_numeric="(1 + s_suppkey % 2)::DOUBLE", unit="'arms'"),
    _study_sql("FROM s, range(2) AS r(i) WHERE i <= s_suppkey % 2", "'Arm ' || i", "i", kind="trial_arm", concept="'arm.type'", concept_label="'Arm group type: Arm ' || i", value="CASE WHEN i = 0 THEN 'EXPERIMENTAL' ELSE 'PLACEBO' END"),
    _study_sql("FROM s", "0", concept="'study.condition'", concept_label="'Studied condition'", value="'Condition ' || s_nationkey"),
])


@query(CT_SQL)
def adapter_clinical_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as studies, read as VARIANT."""
    s, key = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    text, even = lambda c: c.cast("string"), key % 2 == 0
    updated = F.concat(F.lit("2021-"), F.lpad(text(1 + key % 12), 2, "0"), F.lit("-01"))
    date = lambda c: F.struct(c.alias("date"))
    arm = lambda i, kind: F.struct(F.lit(f"Arm {i}").alias("label"), F.lit(kind).alias("type"))
    protocol = F.struct(
        F.struct(F.concat(F.lit("NCT"), text(key)).alias("nctId"), F.col("s_name").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.when(even, "COMPLETED").otherwise("RECRUITING").alias("overallStatus"), date(F.concat(text(2010 + key % 9), F.lit("-02-01"))).alias("startDateStruct"), date(updated).alias("lastUpdatePostDateStruct")).alias("statusModule"),
        F.struct(F.struct(F.floor(F.abs("s_acctbal")).alias("count"), F.lit("ACTUAL").alias("type")).alias("enrollmentInfo"), F.when(even, F.array(F.lit("PHASE1"), F.lit("PHASE2"))).otherwise(F.array(F.lit("PHASE3"))).alias("phases")).alias("designModule"),
        F.struct(F.when(key % 3 == 1, F.lit(True)).when(key % 3 == 2, F.lit(False)).alias("healthyVolunteers")).alias("eligibilityModule"),
        F.struct(F.when(even, F.array(arm(0, "EXPERIMENTAL"))).otherwise(F.array(arm(0, "EXPERIMENTAL"), arm(1, "PLACEBO"))).alias("armGroups")).alias("armsInterventionsModule"),
        F.struct(F.array(F.concat(F.lit("Condition "), text(F.col("s_nationkey")))).alias("conditions")).alias("conditionsModule"),
    )
    body = F.struct(F.array(F.struct(protocol.alias("protocolSection"))).alias("studies"))
    return _through(spark, sf_dir, "CLINICAL_TRIALS", s.select(F.concat(F.lit("studies/"), text(key)).alias("url"), _json(body).alias("payload")))


_SERIES = """WITH n AS (SELECT event_type AS id, strftime(ts, '%Y-%m-%d') AS d, day(ts) AS k, count(*) AS n FROM events GROUP BY ALL),
d AS (SELECT DISTINCT d, k FROM n), t AS (SELECT DISTINCT id FROM n), x AS (SELECT t.id, d.d, d.k, n.n FROM d CROSS JOIN t LEFT JOIN n USING (id, d)),
s AS (SELECT id, d, NULL AS vintage, CASE WHEN k % 7 > 0 THEN n END AS n FROM x UNION ALL SELECT id, d, '2024-03-01', n FROM x WHERE n IS NOT NULL UNION ALL SELECT id, d, '2024-03-01', NULL FROM x WHERE n IS NULL)"""
FRED_SQL = _facts_sql(
    _SERIES, "FROM s", "FRED", "id", "d", "coalesce(vintage, 'latest')",
    entity_id="'US'", entity_name="'United States'", record_type="CASE WHEN vintage IS NOT NULL THEN 'fred_vintage_observation' WHEN n IS NULL THEN 'observation_missing' ELSE 'fred_observation' END", concept="id", concept_label="'Events of ' || id || ' (Not Adjusted)'",
    value="(n::DOUBLE)::VARCHAR", value_numeric="n::DOUBLE", unit="'Events'", period="d", period_start="d", period_end="d", version="coalesce('vintage:' || vintage, 'latest')",
)


@query(FRED_SQL)
def adapter_fred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and kind as wide CSV series, current and of a vintage; one payload a month."""
    e = read(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.dayofmonth("ts").alias("k"))
    kinds = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").limit(200).collect()]  # columns of a CSV
    wide = e.groupBy("d", "k").pivot("event_type", kinds).count()
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("."))

    def csv(header: list[str], cells: list[Column], url: str) -> DataFrame:
        lines = wide.select(F.substring("d", 1, 7).alias("month"), F.struct("d", F.concat_ws(",", F.col("d"), *cells).alias("line")).alias("x")).groupBy("month").agg(F.array_sort(F.collect_list("x")).getField("line").alias("lines"))  # days of a month
        return lines.select(F.concat(F.lit(url), "month").alias("url"), F.concat(F.lit(",".join(["observation_date", *header]) + "\n"), F.array_join("lines", "\n")).alias("payload"))

    current = csv([*kinds, "unlisted"], [*[F.when(F.col("k") % 7 > 0, cell(c)).otherwise(".") for c in kinds], F.lit("1")], "x/fredgraph.csv?")
    vintage = csv([f"{c}_20240301" for c in kinds], [cell(c) for c in kinds], "x/alfredgraph.csv?")
    catalog = e.select(F.col("event_type").alias("id")).distinct().select("id", F.concat(F.lit("Events of "), "id").alias("title"), F.lit("Events").alias("units"), F.lit("Daily").alias("frequency"), F.lit("Not Adjusted").alias("seasonal_adjustment"), F.lit("events").alias("family"), F.lit("US").alias("geo_code"), F.lit("United States").alias("geo_name"))
    return _through(spark, sf_dir, "FRED", current.unionByName(vintage), catalog=catalog)


WB_SQL = _facts_sql(
    """WITH n AS (SELECT 'C' || lpad(n_nationkey::VARCHAR, 2, '0') AS iso, n_name, year(o_orderdate) AS y, count(*) AS orders, sum((o_totalprice * 100)::BIGINT) AS cents FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
o AS (SELECT iso, n_name, y, 'TX.VAL' AS id, 'Sales (current US$)' AS name, 'current US$' AS u, CASE WHEN y % 4 > 0 THEN cents::VARCHAR END AS v FROM n UNION ALL SELECT iso, n_name, y, 'TX.NUM', 'Orders', NULL, orders::VARCHAR FROM n)""",
    "FROM o", "WB", "iso", "id", "y", entity_id="iso", entity_name="n_name", record_type="CASE WHEN v IS NULL THEN 'observation_missing' ELSE 'indicator_observation' END", concept="id", concept_label="name", value="v", value_numeric="v::DOUBLE", unit="u", period="y::VARCHAR", period_start="y || '-01-01'", period_end="y || '-12-31'",
)


@query(WB_SQL)
def adapter_world_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and orders of nations by year as indicator pages; missing values stay."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    n = o.groupBy("n_nationkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")).join(read(spark, sf_dir, "nation"), "n_nationkey")
    iso = F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    pair = lambda a, b: F.struct(a.alias("id"), b.alias("value"))
    seen = lambda id_, name, v: F.struct(pair(F.lit(id_), F.lit(name)).alias("indicator"), pair(F.lit("XX"), F.col("n_name")).alias("country"), iso.alias("countryiso3code"), F.col("y").cast("string").alias("date"), v.alias("value"), F.lit("").alias("unit"))
    both = F.array(seen("TX.VAL", "Sales (current US$)", F.when(F.col("y") % 4 > 0, F.col("cents"))), seen("TX.NUM", "Orders", F.col("orders")))
    page = n.groupBy("n_nationkey").agg(F.flatten(F.collect_list(both)).alias("list"))  # years of a nation
    # null values must stay in the page.
    body = F.concat(F.lit('[{"page":1},'), F.to_json("list", {"ignoreNullFields": "false"}), F.lit("]"))
    return _through(spark, sf_dir, "WORLD_BANK", page.select(F.concat(F.lit("indicators/"), F.col("n_nationkey").cast("string")).alias("url"), body.alias("payload")))


