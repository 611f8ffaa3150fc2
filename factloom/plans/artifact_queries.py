"""Queries of stored artifacts: stages, lookups, documents, manifests and frozen copies; formats and small selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import selection
from factloom.plans import grading
from factloom.plans.registry import query
from factloom.sources.shared import shared_folder
from factloom.sources import envelope, tables
from factloom.sources.envelope import FACTS_SQL, read


@query(f"WITH {FACTS_SQL} SELECT domain, count(*)::BIGINT AS n, min(record_id) AS first_id, max(record_id) AS last_id, true AS sorted FROM facts GROUP BY 1")
def stage_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written by domain, in order of their ids within each file."""
    folder = shared_folder(spark)
    tables.write_domains(envelope.facts(spark, sf_dir), folder)
    return tables.sorted_files(spark, folder, "record_id", "domain").select("domain", "n", F.col("first").alias("first_id"), F.col("last").alias("last_id"), "sorted")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations) AND turn = 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its keys, from a table sorted by them: footers of the files rule out all but one row group."""
    c, folder = read(spark, sf_dir, "conversations"), shared_folder(spark)
    tables.write_sorted(c, folder, ["conv_id", "turn"])
    key = c.agg(F.max("conv_id")).first()[0]
    return tables.lookup(spark, folder, {"conv_id": key, "turn": 1}).select("conv_id", "turn", "text")


@query("SELECT event_type AS name, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small document of counts, written sorted and indented, and read back."""
    folder = shared_folder(spark)
    rows = read(spark, sf_dir, "events").groupBy("event_type").count().collect()  # one row a type
    tables.write_document(spark, {"counts": {r["event_type"]: r["count"] for r in rows}}, folder)
    back = tables.read_document(spark, folder)["counts"]
    return spark.createDataFrame(sorted(back.items()), "name string, n long")


@query("SELECT 'labels' AS name, (SELECT count(*) FROM labels)::BIGINT AS n_rows, false AS changed UNION ALL SELECT 'nation', (SELECT count(*) FROM nation)::BIGINT, true UNION ALL SELECT 'region', (SELECT count(*) FROM region)::BIGINT, false")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of tables with their rows and tree hash; one table is written anew with other rows afterwards."""
    folder = shared_folder(spark)
    for name in ("labels", "nation", "region"):
        read(spark, sf_dir, name).write.parquet(f"{folder}/{name}")
    stated = tables.manifest(spark, folder, ["labels", "nation", "region"])
    read(spark, sf_dir, "nation").limit(1).write.mode("overwrite").parquet(f"{folder}/nation")
    now = {r.name: r for r in tables.manifest(spark, folder, ["labels", "nation", "region"])}
    return spark.createDataFrame([(r.name, r.n_rows, now[r.name].tree_hash != r.tree_hash) for r in stated], "name string, n_rows long, changed boolean")


_FILES = "SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE sha256(coalesce(text, '')) END AS sha FROM documents WHERE doc_id % 11 <> 0"


@query(f"""WITH o AS (SELECT doc_id::VARCHAR AS name, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 13 <> 0), n AS ({_FILES})
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'missing' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.name = n.name WHERE o.sha IS DISTINCT FROM n.sha""")
def frozen_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between frozen artifacts and those at hand."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    now = d.filter("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("sha256")))
    return tables.frozen_changes(d.filter("doc_id % 13 <> 0").drop("doc_id"), now.drop("doc_id"))


@query("SELECT event_type, format('{:.1f}%', 100.0::DOUBLE * x / n) AS share, CASE WHEN p < 0.001 THEN '<0.001' ELSE format('{:.3f}', p) END AS p, format('[{:.2f}, {:.2f}]', lo, hi) AS interval FROM (SELECT event_type, count_if(value > 100) AS x, count(*) AS n, (count(*) % 7) / 2000.0::DOUBLE AS p, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)")
def formatted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, p values and intervals as text."""
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("x"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select("event_type", core.percent_text(F.col("x") / F.col("n")).alias("share"), core.p_text((F.col("n") % 7) / 2000).alias("p"), core.interval_text(F.col("lo"), F.col("hi")).alias("interval"))


@query("SELECT event_type AS question_type, 'D' || least(r, 3) % 3 AS domain, min(event_id) FILTER (WHERE user_id % 3 = CASE WHEN r <= 3 THEN r - 1 ELSE 0 END) AS event_id FROM (SELECT *, dense_rank() OVER (ORDER BY event_type) AS r FROM events) GROUP BY event_type, r".replace("'D' || least(r, 3) % 3", "'D' || CASE WHEN r <= 3 THEN r - 1 ELSE 0 END"))
def example_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example of each type, of a domain that no earlier type has where there is one."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("question_type"), F.concat(F.lit("D"), (F.col("user_id") % 3).cast("string")).alias("domain"))
    return selection.examples(e, "question_type", "domain", "event_id")


@query("(SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE value > 100) UNION ALL (SELECT -user_id FROM events EXCEPT SELECT -user_id FROM events WHERE value > 200)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.7: intersection, difference and union of keys."""
    e = read(spark, sf_dir, "events")
    both = e.filter("event_type = 'error'").select("user_id").intersect(e.filter("value > 100").select("user_id"))
    negative = lambda df: df.select((-F.col("user_id")).alias("user_id"))
    low = negative(e).subtract(negative(e.filter("value > 200")))
    return both.unionByName(low)


@query("SELECT status, event_type, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'failure' ELSE 'result' END AS status, event_type FROM events) GROUP BY 1, 2")
def runtime_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that failed are a table of their own and never count as wrong answers."""
    runs = read(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", F.lit("timeout")))
    results, failures = grading.split_failures(runs, "error")
    shown = lambda df, name: df.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(name).alias("status"), "event_type", "n")
    return shown(results, "result").unionByName(shown(failures, "failure"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE quality END AS resolution, CASE WHEN quality IS NULL THEN 'open' WHEN d.doc_id % 5 = 0 THEN 'stale' ELSE 'frozen' END AS status FROM documents d LEFT JOIN labels USING (doc_id)")
def frozen_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions taken before hold for rows whose content is still the same."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    d = read(spark, sf_dir, "documents").select("doc_id", digest(F.col("text")).alias("content"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("content"))
    frozen = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("resolution")).join(d, "doc_id").withColumn("content", changed)
    return selection.reuse(d, frozen, "doc_id", "content", "resolution").select("doc_id", "resolution", "status")
