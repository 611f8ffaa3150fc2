"""Queries of streams, sinks and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import selection
from factloom.plans.registry import query
from factloom.sources import tables
from factloom.sources.envelope import read
from factloom.sources.shared import shared_folder
from factloom.streaming import log


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, 2.15: events as a stream that comes twice, appended once each."""
    once = read(spark, sf_dir, "events")
    folder = shared_folder(spark)
    once.write.parquet(f"{folder}/in")
    once.write.mode("append").parquet(f"{folder}/in")
    stream = log.source(spark, f"{folder}/in", once.schema)
    log.append(log.deduplicated(stream, "event_id", "ts", "3650 days"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, count(*)::BIGINT AS n, avg((value > 100)::INT) AS rate FROM events GROUP BY 1")
def stream_running_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15: rates by condition as a stream's state."""
    e = read(spark, sf_dir, "events")
    folder = shared_folder(spark)
    e.write.parquet(f"{folder}/in")
    return log.running_rates(log.source(spark, f"{folder}/in", e.schema), "event_type", "value > 100", f"{folder}/rates", f"{folder}/state")


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15: events by day and type."""
    e = read(spark, sf_dir, "events")
    folder = shared_folder(spark)
    e.write.parquet(f"{folder}/in")
    counts = log.windowed_counts(log.source(spark, f"{folder}/in", e.schema), "ts", "event_type", "1 day", "1 day", f"{folder}/counts", f"{folder}/state")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as JSON lines and back by its schema."""
    n = read(spark, sf_dir, "nation")
    path = shared_folder(spark)
    tables.write_jsonl(n, path)
    return tables.read_jsonl(spark, path, n.schema)


@query("SELECT s_suppkey, s_name, s_acctbal > 0 AS positive FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed fields to CSV and back, booleans by their text."""
    s = read(spark, sf_dir, "supplier").withColumn("positive", F.when(F.col("s_acctbal") > 0, "True").otherwise("False"))
    path = shared_folder(spark)
    tables.write_csv(s, path, ["s_suppkey", "s_name", "positive"])
    return tables.read_csv(spark, path, "s_suppkey bigint, s_name string, positive string", ("positive",))


@query("SELECT p_partkey, p_brand, p_size::VARCHAR AS answer, p_size::DOUBLE AS answer_numeric FROM part")
def parquet_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column with its numeric twin."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("answer"), "p_name")
    path = shared_folder(spark)
    tables.write_mirror(p, path, drop=("p_name",), union="answer")
    return spark.read.parquet(path)


@query("SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN 'new' ELSE r_name END AS r_name FROM region")
def retrieval_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of a key replace old ones."""
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return selection.upsert(r, r.filter("r_regionkey < 2").withColumn("r_name", F.lit("new")), ["r_regionkey"])


@query("SELECT c_custkey, 'c_acctbal' AS field FROM customer WHERE c_acctbal < 0")
def frozen_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields differ between two versions of a table."""
    c = read(spark, sf_dir, "customer")
    new = c.withColumn("c_acctbal", F.abs("c_acctbal")).withColumn("c_name", F.upper("c_name"))
    return selection.changed_fields(c, new, "c_custkey", ignore=("c_name",)).select("c_custkey", F.explode("fields").alias("field"))


@query("SELECT lang, source, count(*)::BIGINT AS n, grouping_id(lang, source)::BIGINT AS level FROM documents GROUP BY CUBE (lang, source)")
def summary_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14: the summary table with all its subtotals."""
    return read(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id("lang", "source").alias("level"))


@query("SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS n_user, count(*)::BIGINT AS n_turns, count(DISTINCT role)::BIGINT AS n_roles, max(length(text))::BIGINT AS longest FROM conversations GROUP BY 1 HAVING count(DISTINCT role) >= 1")
def readiness_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, A18, 2.14: distinct sets and presence by class of each group."""
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"), F.max(F.char_length("text")).cast("long").alias("longest"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_discount) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classic scan and aggregation; the filter reaches the scan."""
    li = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
