"""Queries of structured responses: recovery of JSON, rules, evidence counts, and failures along a ladder. Responses are made of
the driver's tables in eight forms, which SQL knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import selection
from factloom.plans import grading, packing
from factloom.plans.registry import query
from factloom.sources.envelope import read

#: Methods of the forms of a response by order key modulo 8: None where nothing can be recovered.
METHODS = ("strict", "fence", "first_object", "literals", "closers", None, None, "strict")
BASE = """WITH r AS (SELECT l_orderkey AS id, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_extendedprice) AS r FROM lineitem),
g AS (SELECT id, max(q) AS most, max(CASE WHEN r = 1 THEN q END) AS gold, max(r) AS n FROM r GROUP BY 1),
o AS (SELECT g.*, (SELECT min(r.r) FROM r WHERE r.id = g.id AND r.q = g.most) AS first, id % 8 AS k FROM g),
i AS (SELECT *, CASE WHEN id % 16 >= 8 THEN n ELSE first END AS chosen, CASE k {methods} END AS method FROM o)""".format(methods=" ".join(f"WHEN {k} THEN {m!r}" for k, m in enumerate(METHODS) if m))


def _name(c: Column) -> Column:
    return F.concat(F.lit("R"), F.lpad(c.cast("string"), 8, "0"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as instances: their lines are the records, the first line's quantity is right, the greatest one is answered."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").alias("q"))
    li = selection.ranked(li, ["id"], "r", "l_linenumber", "q", "l_partkey", "l_extendedprice")
    g = li.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "q"))).alias("lines"), F.max("q").alias("most"), F.max(F.when(F.col("r") == 1, F.col("q"))).alias("gold"))  # lines of an order
    first = F.get(F.filter("lines", lambda x: x["q"] == F.col("most")), F.lit(0))["r"]
    chosen = F.when(F.col("id") % 16 >= 8, F.size("lines")).otherwise(first)
    k, answer = F.col("id") % 8, F.when(F.col("id") % 8 == 7, "INSUFFICIENT_EVIDENCE").otherwise(F.col("most").cast("string"))
    ids = F.when(k == 7, F.array().cast("array<string>")).otherwise(F.array(_name(chosen)))
    body = F.to_json(F.struct(answer.alias("answer"), ids.alias("selected_evidence"), (k == 7).alias("insufficient_evidence")))
    python = F.regexp_replace(F.regexp_replace(body, ":false", ": False"), ":true", ": True")
    listed = F.concat(F.lit('{"selected_evidence": ['), F.array_join(F.array_repeat(F.concat(F.lit('"'), _name(chosen), F.lit('"')), 25), ", "))
    raw = F.when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" I hope so."))).when(k == 3, python).when(k == 4, F.expr("substring(b, 1, length(b) - 1)")).when(k == 5, F.concat(F.lit("The answer is "), answer)).when(k == 6, listed).otherwise(body)
    g = g.withColumn("b", body).withColumn("raw_output_text", raw)
    none = F.lit(None).cast("double")
    records = F.transform("lines", lambda x: F.struct(_name(x["r"]).alias("display_id"), x["q"].cast("string").alias("value")))
    foils = F.map_from_entries(F.transform(F.filter("lines", lambda x: x["r"] > 1), lambda x: F.struct(_name(x["r"]), F.lit("WRONG_PERIOD"))))
    return g.select(
        "id", "raw_output_text", records.alias("records"), foils.alias("distractors"), F.array(F.array(_name(F.lit(1)))).alias("gold_sets"), F.transform("lines", lambda x: _name(x["r"])).alias("context_display_ids"), F.col("gold").cast("string").alias("gold_answer"),
        F.lit("NUMERIC").alias("answer_type"), F.when(F.col("id") % 3 == 0, "RETRIEVAL_CALCULATION").otherwise("DIRECT_RETRIEVAL").alias("question_type"), F.lit(True).alias("answerable"), F.lit(0.0).alias("tolerance"), none.alias("raw_result"), none.alias("rounded_result"), F.lit(None).cast("int").alias("round_decimals"),
        F.when(F.col("id") % 5 == 0, 512).otherwise(80).alias("generated_tokens"),
    )


@query(f"""{BASE} SELECT id, method, CASE WHEN method IS NOT NULL THEN CASE WHEN k = 7 THEN 'INSUFFICIENT_EVIDENCE' ELSE most::VARCHAR END END AS answer,
  CASE WHEN method IS NOT NULL THEN CASE WHEN k = 7 THEN '' ELSE 'R' || lpad(chosen::VARCHAR, 8, '0') END END AS evidence, k = 6 AS degenerate FROM i""")
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each response's object is recovered, and what it holds."""
    r = grading.recovered(F.col("raw_output_text"))
    out = responses(spark, sf_dir).select("id", r.alias("r"))
    return out.select("id", "r.method", "r.answer", F.array_join("r.selected_evidence", ",").alias("evidence"), "r.degenerate")


@query(f"""{BASE}, e AS (SELECT id, k, chosen = 1 AS evidence_ok, CASE WHEN k IN (5, 6) THEN 'FORMAT_FAILURE' WHEN k = 7 THEN 'UNNECESSARY_ABSTENTION' WHEN most = gold AND chosen = 1 THEN 'CORRECT' WHEN most = gold THEN 'WRONG_EVIDENCE' ELSE 'WRONG_PERIOD' END AS error_type FROM i)
SELECT id, error_type, error_type IN ('CORRECT', 'WRONG_EVIDENCE') AS answer_correct, k NOT IN (5, 6, 7) AND evidence_ok AS evidence_correct, CASE WHEN k NOT IN (5, 6) THEN 'false' END AS hallucination FROM e""")
def grade_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured responses by the ordered rules, with their evidence."""
    out = grading.grade_structured(responses(spark, sf_dir))
    return out.select("id", "error_type", "answer_correct", F.col("evidence.correct").alias("evidence_correct"), F.col("hallucination").cast("string").alias("hallucination"))


@query(f"""{BASE}, c AS (SELECT *, method IS NOT NULL AS usable, CASE WHEN method IS NULL THEN NULL WHEN k = 7 THEN 0 WHEN id % 3 = 0 THEN 2 ELSE 1 END AS expected, CASE WHEN method IS NULL OR k = 7 THEN 0 ELSE 1 END AS selected FROM i)
SELECT id, usable, id % 5 = 0 AS hit_limit, k IN (5, 6) AS missing_answer_field, k IN (0, 3, 4, 7) AS answer_first, expected AS expected_evidence, selected AS n_selected, usable AND selected <> expected AS evidence_violation FROM c""")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected records against the number that the kind of question asks for."""
    out = grading.structure_checks(responses(spark, sf_dir))
    return out.select("id", "usable", "hit_limit", "missing_answer_field", "answer_first", "expected_evidence", "n_selected", "evidence_violation")


LADDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""WITH s AS (SELECT o_custkey, o_orderpriority AS label, bool_or(o_orderkey % 8 IN (5, 6)) AS failed FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL),
n AS (SELECT o_custkey, list(label ORDER BY label) FILTER (WHERE failed) AS bad, list(label ORDER BY label) FILTER (WHERE NOT failed) AS good FROM s GROUP BY 1)
SELECT o_custkey, coalesce(len(good), 0) = 5 AS success_everywhere, coalesce(len(bad), 0) = 5 AS fails_everywhere, coalesce(list_contains(good, '1-URGENT'), false) AND coalesce(len(bad), 0) > 0 AS short_success_long_failure, bad[1] AS first_failure,
  coalesce(array_to_string(bad, ';'), '') AS failures, coalesce(array_to_string(good, ';'), '') AS usable FROM n""")
def format_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as families, priorities as the ladder; a rung fails where one of its orders' responses can't be used."""
    r = responses(spark, sf_dir).select(F.col("id").alias("o_orderkey"), grading.recovered(F.col("raw_output_text"))["method"].isNull().alias("failed"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(r, "o_orderkey")
    return grading.format_transitions(o, "o_custkey", "o_orderpriority", LADDER, F.col("failed"))


@query("""WITH i AS (SELECT o_orderkey AS instance_id, o_custkey AS family_id FROM orders WHERE o_orderkey % 9 > 0), f AS (SELECT c_custkey AS family_id, c_mktsegment FROM customer WHERE c_custkey % 10 > 0),
r AS (SELECT l_orderkey AS instance_id, max_by(l_quantity, l_linenumber::BIGINT * 1000000000 + l_partkey) AS q, count(*) AS attempts FROM lineitem GROUP BY 1)
SELECT instance_id, q, coalesce(attempts, 0)::BIGINT AS attempts, c_mktsegment, CASE WHEN i.instance_id IS NULL THEN 'no_instance' WHEN r.instance_id IS NULL THEN 'no_result' WHEN f.family_id IS NULL THEN 'no_family' ELSE 'joined' END AS status
FROM i FULL JOIN r USING (instance_id) LEFT JOIN f USING (family_id)""")
def results_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several attempts with their instances and families, and what has no partner. Of equal attempts the one
    that stands first in the table counts, as max_by takes it."""
    instances = read(spark, sf_dir, "orders").filter("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("family_id"))
    families = read(spark, sf_dir, "customer").filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("family_id"), "c_mktsegment")
    results = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("attempt"), F.col("l_quantity").alias("q"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return grading.join_results(instances, results, families, place=("file", "row")).select("instance_id", "q", "attempts", "c_mktsegment", "status")


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 4 <> 3 AND text IS NOT NULL)
SELECT c.conv_id::VARCHAR AS family_id, count(*)::BIGINT AS n, coalesce(string_agg('T' || c.turn, ',' ORDER BY c.turn) FILTER (WHERE t.turn IS NULL), '') AS missing FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn GROUP BY 1""")
def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of conversations put together, and the records that they name but that have no text."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("family_id"), F.col("turn").cast("int").alias("position"), "text")
    key = F.concat("family_id", F.lit("/T"), F.col("position").cast("string")).alias("record_id")
    placed = c.select("family_id", F.lit(1).alias("nominal"), F.lit("OK").alias("status"), F.lit(1).alias("tokens"), key, F.lit("before").alias("side"), "position", F.lit(0).alias("gold_start"), F.lit(0).alias("gold_tokens"))
    out = packing.instances(placed, c.filter("position % 4 <> 3").select(key, "text"))
    missing = F.transform("missing_ids", lambda x: F.substring_index(x, "/", -1))
    return out.select("family_id", F.size("record_ids").cast("long").alias("n"), F.array_join(missing, ",").alias("missing"))
