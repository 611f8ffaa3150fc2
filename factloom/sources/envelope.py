"""The fact table over the driver's star schema: wide source rows become long facts of one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_COLUMNS = ["record_id", "domain", "entity_id", "concept", "unit", "period", "version", "value"]
#: Columns of lineitem that become facts, with their units.
LINE_CONCEPTS = {"l_quantity": "units", "l_extendedprice": "USD", "l_discount": "ratio", "l_tax": "ratio"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    period = F.concat(F.lit("CY"), F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return o.select(F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string")).alias("record_id"), F.lit("sales").alias("domain"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity_id"), F.lit("orders:totalprice").alias("concept"), F.lit("USD").alias("unit"), period.alias("period"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_totalprice").alias("value"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", *LINE_CONCEPTS)
    long = li.unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"], list(LINE_CONCEPTS), "concept", "value")
    unit = F.create_map(*[F.lit(x) for kv in LINE_CONCEPTS.items() for x in kv])
    version = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return long.select(F.concat_ws("_", F.lit("lineitem"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "concept").alias("record_id"), F.lit("supply").alias("domain"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("entity_id"), "concept", unit[F.col("concept")].alias("unit"), F.concat(F.lit("CY"), F.year("l_shipdate").cast("string")).alias("period"), version.alias("version"), "value")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("events_"), F.col("event_id").cast("string")).alias("record_id"), F.lit("usage").alias("domain"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("concept"), F.lit("value").alias("unit"), F.date_format("ts", "yyyy-MM-dd").alias("period"), F.col("event_id").cast("string").alias("version"), "value")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_facts(spark, sf_dir).unionByName(line_facts(spark, sf_dir)).unionByName(event_facts(spark, sf_dir))


#: The same in DuckDB, as the beginning of a WITH clause.
FACTS_SQL = """
order_facts AS (SELECT 'orders_' || o_orderkey AS record_id, 'sales' AS domain, 'C' || o_custkey AS entity_id, 'orders:totalprice' AS concept, 'USD' AS unit,
  'CY' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, o_orderkey::VARCHAR AS version, o_totalprice AS value FROM orders),
line_facts AS (SELECT 'lineitem_' || l_orderkey || '_' || l_linenumber || '_' || concept AS record_id, 'supply' AS domain, 'P' || l_partkey AS entity_id, concept,
  CASE concept WHEN 'l_quantity' THEN 'units' WHEN 'l_extendedprice' THEN 'USD' ELSE 'ratio' END AS unit, 'CY' || year(l_shipdate) AS period, l_orderkey || '-' || l_linenumber AS version, value
  FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME concept VALUE value)),
event_facts AS (SELECT 'events_' || event_id AS record_id, 'usage' AS domain, 'U' || user_id AS entity_id, event_type AS concept, 'value' AS unit, strftime(ts, '%Y-%m-%d') AS period, event_id::VARCHAR AS version, value FROM events),
facts AS (SELECT * FROM order_facts UNION ALL SELECT * FROM line_facts UNION ALL SELECT * FROM event_facts)
"""
