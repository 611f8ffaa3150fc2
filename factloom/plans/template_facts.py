"""Facts of the five domains made from the star schema, so that every template has something to ask about.

One SQL text serves Spark and DuckDB alike: the facts are the templates' input, not what is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.envelope import read

TEXT = ("record_id", "domain", "entity_id", "entity_name", "concept", "concept_label", "value", "unit", "period", "version", "record_type", "period_start", "period_end")
#: Metadata keys, and the column that holds each.
META = {"has_frame": "m_frame", "period_kind": "m_kind", "filed": "m_filed", "accn": "m_accn", "application_number": "m_app", "ingredient_name": "m_ing", "is_original": "m_orig", "conditions": "m_conds", "arm_label": "m_arm", "series_family": "m_family"}


def _rows(source: str, **columns: str) -> str:
    text = [f"CAST({columns.get(c, 'NULL')} AS STRING) AS {c}" for c in (*TEXT, *META.values())]
    return f"SELECT {', '.join(text)}, CAST({columns.get('value_numeric', 'NULL')} AS DOUBLE) AS value_numeric FROM {source}"


def _money(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18, 2))) AS DOUBLE)"


_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_SEC = dict(domain="'SEC'", entity_id="'C' || k", entity_name="'Customer ' || k", unit="'USD'", record_type="'xbrl_fact'")
_FDA = dict(domain="'FDA'", entity_id="'P' || p_partkey", entity_name="p_name || ' ' || p_partkey", m_app="'NDA' || CAST(floor(p_partkey / 5) AS BIGINT)")
_TRIAL = dict(domain="'CLINICAL_TRIALS'", entity_id="'NCT' || k", entity_name="'Trial ' || k", record_type="'trial_field'")
_FRED = dict(domain="'FRED'", entity_id="s", entity_name="'Series ' || s", concept="s", concept_label="'Series ' || s", unit="'percent'", period="d", version="'latest'", m_family="CASE WHEN s IN ('UNRATE', 'UNRATENSA') THEN 'unemployment' WHEN s IN ('DGS10', 'GS10') THEN 'ten years' ELSE '' END")
_BANK = dict(domain="'WORLD_BANK'", entity_id="'N' || k", entity_name="nm", period="CAST(y AS STRING)", unit="'units'", version="'latest'")
_INDICATORS = {"NY.GDP.MKTP.CD": "gdp", "SP.POP.TOTL": "pop", "NE.EXP.GNFS.ZS": "n", "NE.IMP.GNFS.ZS": "nf", "NY.GDP.MKTP.KD": "gdp_o", "NY.GDP.PCAP.CD": "top", "SP.POP.GROW": "np", "NY.GDP.MKTP.KD.ZG": "low"}
_TRIAL_DATES = {"study.start_date": "d0", "study.primary_completion_date": "d1", "study.first_posted_date": "df", "study.last_update_posted_date": "dp", "study.results_first_posted_date": "dx"}
_EVENTS = "CASE user_id % 10 WHEN 0 THEN 'DGS10' WHEN 1 THEN 'FEDFUNDS' WHEN 2 THEN 'GS10' WHEN 3 THEN 'UNRATE' WHEN 4 THEN 'UNRATENSA' WHEN 5 THEN 'CAUR' WHEN 6 THEN 'TXUR' WHEN 7 THEN 'NYUR' WHEN 8 THEN 'FLUR' ELSE 'GDP' END"

_PARTS = [
    _rows("oy", record_id="'sec_r_' || k || '_' || y", concept="'us-gaap:Revenues'", concept_label="'Revenues'", period="'CY' || y", version="'v' || y", value_numeric="total", m_frame="'true'", m_kind="'annual'", period_end="''", **_SEC),
    _rows("oy WHERE k % 3 = 0", record_id="'sec_c_' || k || '_' || y", concept="'us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax'", concept_label="'Revenue from contracts'", period="'CY' || y", version="'v' || y", value_numeric="total + 100", m_frame="'true'", m_kind="'annual'", period_end="''", **_SEC),
    _rows("oy", record_id="'sec_o_' || k || '_' || y", concept="'us-gaap:OperatingIncomeLoss'", concept_label="'Operating income'", period="'CY' || y", version="'v' || y", value_numeric="floor(total / 8) - 20000", m_frame="'true'", m_kind="'annual'", period_end="''", **_SEC),
    _rows("oq WHERE q < 4", record_id="'sec_q_' || k || '_' || y || '_' || q", concept="'us-gaap:Revenues'", concept_label="'Revenues'", period="'CY' || y || 'Q' || q", version="'q' || q", value_numeric="total", m_frame="'true'", m_kind="'quarter'", period_end="''", **_SEC),
    _rows("(SELECT o_custkey AS k, o_orderkey, o_totalprice, o_orderdate, year(o_orderdate) + 18 AS y FROM orders) o", record_id="'sec_f_' || o_orderkey", concept="'us-gaap:OrderValue'", concept_label="'Order value'", period="'CY' || y", version="'acc-' || o_orderkey", value_numeric="o_totalprice", m_frame="'false'", m_filed=_DAY, m_accn="o_orderkey", period_start="y || '-01-01'", period_end="y || '-12-31'", **_SEC),
    _rows("part", record_id="'fda_d_' || p_partkey", concept="'product.dosage_form'", concept_label="'Dosage form'", value="p_type", record_type="'drug_product_attribute'", **_FDA),
    _rows("part WHERE p_partkey % 3 <> 0", record_id="'fda_r_' || p_partkey", concept="'product.route'", concept_label="'Route'", value="p_brand", record_type="'drug_product_attribute'", **_FDA),
    _rows("part WHERE p_partkey % 2 = 0", record_id="'fda_m_' || p_partkey", concept="'product.marketing_status'", concept_label="'Status'", value="'Prescription'", record_type="'drug_product_attribute'", **_FDA),
    _rows("part", record_id="'fda_s_' || p_partkey", concept="'product.strength'", concept_label="'Strength'", value="p_size || ' MG'", value_numeric="p_size", unit="CASE p_partkey % 2 WHEN 0 THEN 'MG' ELSE 'ML' END", record_type="'drug_product_strength'", m_ing="p_type || ' ' || p_brand", **_FDA),
    _rows("orders", record_id="'fda_sub_' || o_orderkey", domain="'FDA'", entity_id="'NDA' || o_custkey", entity_name="'Application ' || o_custkey", concept="'submission.status_date'", concept_label="'Status date'", value=_DAY, record_type="'drug_submission'", m_orig="CASE o_orderstatus WHEN 'F' THEN 'true' ELSE 'false' END"),
    _rows("(SELECT c_custkey AS k, * FROM customer) c", record_id="'ct_e_' || k", concept="'enrollment.count'", concept_label="'Enrollment'", value_numeric="floor(c_acctbal)", m_conds="c_mktsegment || ' ' || (k % 50) || ', other'", **_TRIAL),
    *[_rows(f"od WHERE {d} IS NOT NULL", record_id=f"'ct_{d}_' || k", concept=f"'{c}'", concept_label=f"'{c}'", value=d, **_TRIAL) for c, d in _TRIAL_DATES.items()],
    _rows("(SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders) a", record_id="'ct_arm_' || k || '_' || p", concept="'arm.type'", concept_label="'Arm group type: ' || p", value="p", m_arm="p", **_TRIAL),
    _rows("(SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) c", record_id="'ct_age_' || k", concept="'eligibility.maximum_age'", concept_label="'Maximum age'", value="'65 Years'", **_TRIAL),
    _rows("es", record_id="'fred_' || s || '_' || d", record_type="'fred_observation'", value_numeric="hi", **_FRED),
    *[_rows("es WHERE dom % 2 = 0", record_id=f"'fred_v{v}_' || s || '_' || d", record_type="'fred_vintage_observation'", value_numeric=c, **_FRED | {"version": f"'vintage:2024-0{v}-01'"}) for v, c in ((3, "lo"), (4, "hi"))],
    *[_rows("es WHERE dom % 7 = 0", record_id=f"'fred_m{x}_' || s || '_' || d", record_type="'observation_missing'", **_FRED | {"concept": f"s || '{x}'"}) for x in ("", "X")],
    *[_rows("ny", record_id=f"'wb_{c}_' || k || '_' || y", record_type="'indicator_observation'", concept=f"'{c}'", concept_label=f"'Indicator {c}'", value_numeric=v, **_BANK) for c, v in _INDICATORS.items()],
    *[_rows("ny WHERE y % 2 = 1", record_id=f"'wb_m_{c}_' || k || '_' || y", record_type="'observation_missing'", concept=f"'{c}'", concept_label=f"'Indicator {c}'", **_BANK) for c in ("IT.NET.USER.ZS", "SP.POP.TOTL")],
]
_SOURCES = f"""
oy AS (SELECT o_custkey AS k, year(o_orderdate) + 18 AS y, {_money('o_totalprice')} AS total FROM orders GROUP BY o_custkey, year(o_orderdate)),
oq AS (SELECT o_custkey AS k, year(o_orderdate) + 18 AS y, quarter(o_orderdate) AS q, {_money('o_totalprice')} AS total FROM orders GROUP BY o_custkey, year(o_orderdate), quarter(o_orderdate)),
od AS (SELECT o_custkey AS k, min({_DAY}) AS d0, max({_DAY}) AS d1, min(CASE WHEN o_orderstatus = 'F' THEN {_DAY} END) AS df, min(CASE WHEN o_orderstatus = 'P' THEN {_DAY} END) AS dp, max(CASE WHEN o_orderpriority = '1-URGENT' THEN {_DAY} END) AS dx FROM orders GROUP BY o_custkey),
es AS (SELECT s, CAST(d AS STRING) AS d, day(d) AS dom, min(value) AS lo, max(value) AS hi FROM (SELECT {_EVENTS} AS s, CAST(ts AS DATE) AS d, value FROM events) e GROUP BY s, d),
ny AS (SELECT n_nationkey AS k, n_name AS nm, year(o_orderdate) + 8 AS y, {_money('o_totalprice')} AS gdp, count(DISTINCT o_custkey) AS pop, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS nf, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS np,
  {_money("CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END")} AS gdp_o, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, year(o_orderdate))"""
FACTS_SQL = f"{_SOURCES}, tf AS ({' UNION ALL '.join(_PARTS)})"
_SPARK = FACTS_SQL
for _t in ("orders", "customer", "nation", "part", "events"):
    _SPARK = _SPARK.replace(f"FROM {_t} ", f"FROM {{{_t}}} ").replace(f"FROM {_t})", f"FROM {{{_t}}})").replace(f"JOIN {_t} ", f"JOIN {{{_t}}} ")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts in the shape of the adapters' envelope, metadata as a map without empty entries."""
    named = {t: read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "part", "events")}
    flat = spark.sql(f"WITH {_SPARK} SELECT * FROM tf", **named)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in META.items()])
    return flat.select("*", F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("metadata")).drop(*META.values())
