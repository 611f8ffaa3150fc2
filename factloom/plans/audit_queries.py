"""Queries of audits, prompts and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import selection
from factloom.plans import audit
from factloom.plans.registry import query
from factloom.sources import versions
from factloom.sources.envelope import read
from factloom.sources.shared import kept, shared_folder


@query("""WITH h AS (SELECT doc_id, lang, source, md5('audit|' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS a, row_number() OVER (PARTITION BY source ORDER BY h) AS b FROM h)
SELECT doc_id, lang, source FROM r ORDER BY least(a, b), h LIMIT 100""")
def audit_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents over all languages and sources (the limit is the feature)."""
    return audit.quota_sample(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 100, "audit")


@query("""WITH w AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS w FROM orders)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY w, o_orderpriority) AS n FROM w) WHERE n <= 25""")
def audit_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 orders of each status, priorities in turn (the limit is the feature)."""
    return audit.round_robin(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority", 25, "o_orderkey")


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS f, p_retailprice FROM part) SELECT p_partkey, p_brand FROM r ORDER BY f DESC, p_retailprice DESC, p_partkey LIMIT 60""")
def audit_first_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's dearest part, then the dearest others up to 60 (the limit is the feature)."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return audit.first_per_stratum(p, ["p_brand"], 60, F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_brand")


TOKENS = r"list_sum(list_transform(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), lambda x: greatest(1, length(x) // 4)))"


@query(f"""WITH p AS (SELECT doc_id, '<|system|>' || chr(10) || 'Answer from the records alone. Reply with one line: ANSWER: <value>, or ANSWER: INSUFFICIENT_EVIDENCE.' || chr(10) || '<|user|>' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Question: ' || coalesce(source, '') || chr(10) || '<|assistant|>' || chr(10) AS t FROM documents)
SELECT doc_id, sha256(t) AS prompt_sha256, {TOKENS}::BIGINT AS prompt_tokens, (8192 - 128 - {TOKENS})::BIGINT AS prompt_margin FROM p""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with hash, tokens and margin."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"), F.col("source").alias("question"))
    return audit.rendered(d, 8192, 128).select("doc_id", "prompt_sha256", "prompt_tokens", "prompt_margin")


@query("""WITH t AS (SELECT doc_id, lang, length(text)::BIGINT AS stated, length(trim(text))::BIGINT AS n FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*)::BIGINT AS n, count_if(stated <> n)::BIGINT AS mismatches, count_if(n > 4000)::BIGINT AS overflows, min(n) AS least, avg(n) AS mean, max(n) AS greatest, stddev_samp(n) AS sd FROM t GROUP BY 1""")
def budget_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts taken again against stated ones."""
    d = read(spark, sf_dir, "documents").filter("text is not null")
    frozen = d.select("doc_id", "lang", F.char_length("text").cast("long").alias("prompt_tokens"))
    again = d.select("doc_id", F.char_length(F.trim("text")).cast("long").alias("prompt_tokens"), F.lit(4000).cast("long").alias("prompt_budget"))
    return audit.budget_report(frozen, again, "doc_id", "lang")


_KINDS = {"en": "DIRECT_RETRIEVAL", "de": "BINDING"}


def _prompt_sql(text: str) -> str:
    return f"'<|system|>' || chr(10) || '{audit.SYSTEM}' || chr(10) || '<|user|>' || chr(10) || coalesce({text}, '') || chr(10) || chr(10) || 'Question: ' || coalesce(source, '') || chr(10) || '<|assistant|>' || chr(10)"


_TOKENS = r"coalesce(list_sum(list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda x: greatest(1, length(x) // 4))), 0)::BIGINT"


@query(f"""WITH d AS (SELECT doc_id, source, text, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' revised' ELSE text END AS now, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} ELSE lang END AS question_type FROM documents),
p AS (SELECT doc_id, question_type, CASE WHEN doc_id % 11 = 0 THEN 'new' WHEN now IS DISTINCT FROM text THEN 'changed' ELSE 'kept' END AS status, {_prompt_sql('now')} AS t FROM d)
SELECT doc_id, status, question_type, sha256(t) AS prompt_sha256, {_TOKENS.format(t='t')} AS prompt_tokens, 1000000 - {_TOKENS.format(t='t')} AS prompt_margin FROM p""")
def rerendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of documents of which some have changed or are new, rendered again and reclassified."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"), F.col("source").alias("question"), F.col("lang").alias("question_type"))
    none = spark.createDataFrame([], "doc_id long, input_sha256 string, prompt_sha256 string, prompt_tokens long")
    first = kept(audit.rerendered(none, d.filter("doc_id % 11 > 0"), "doc_id", {}, 1_010_000, 10_000))
    now = d.withColumn("context", F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("context", F.lit("")), F.lit(" revised"))).otherwise(F.col("context")))
    return audit.rerendered(first, now, "doc_id", _KINDS, 1_010_000, 10_000).drop("input_sha256")


@query()
def audit_coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 documents, coverage of languages and sources first, balance second (the limit is the feature)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 300).alias("long"))
    return selection.coverage_sample(d, "doc_id", "lang", "source", "long", 40, "audit")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, 2 AS n_versions FROM orders")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15: a table replaced as a whole by a later version, read back through its pointer; a third one is never published."""
    o, root = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), shared_folder(spark)
    first = versions.commit(o, root)
    versions.commit(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice"))), root, replaces=first)
    versions.stage(o.limit(1), root)
    gone = versions.discard(spark, root, keep=(first,))
    return versions.read_version(spark, root).withColumn("n_versions", F.lit(3 - gone))


@query("""SELECT coalesce(e.o_orderpriority, a.o_orderpriority) AS o_orderpriority, e.n AS expected, a.n AS actual FROM (SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) e
FULL JOIN (SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1) a USING (o_orderpriority) WHERE e.n IS DISTINCT FROM a.n""")
def integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts against expected ones."""
    o = read(spark, sf_dir, "orders")
    count = lambda df: df.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return audit.gate(count(o), count(o.filter("o_orderstatus <> 'F'")), "o_orderpriority", "n")


@query("""SELECT event_type, count(*)::BIGINT AS n, count_if(json_valid(props))::BIGINT AS valid FROM events GROUP BY 1""")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON validity by group."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"))


@query("""SELECT conv_id, turn, regexp_matches(text, '[{}\\[\\]]') AS json, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 1 AS extra_lines, length(text) >= 200 AS hit_limit FROM conversations""")
def output_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: how outputs depart from an answer line."""
    c = read(spark, sf_dir, "conversations").withColumn("f", audit.answer_flags(F.col("text"), F.char_length("text"), 200))
    return c.select("conv_id", "turn", "f.json", "f.extra_lines", "f.hit_limit")


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_.:-]+') AS w FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '^\s*ANSWER:\s*\S') AS answer_line, regexp_matches(t, '[{}\[\]]') AS json, regexp_matches(t, '\bR[A-F0-9]{8,12}\b') AS record_id, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) > 1 AS extra_lines,
  len(w) >= 20 AND coalesce(list_max(map_values(list_histogram(w))), 0) >= 12 AS repeats, length(t) >= 200 AS hit_limit FROM t""")
def output_flags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: all flags of an output; output_flags has three of them."""
    c = read(spark, sf_dir, "conversations").withColumn("f", audit.answer_flags(F.col("text"), F.char_length("text"), 200))
    return c.select("conv_id", "turn", "f.*")


@query("""WITH r AS (SELECT o_orderkey, unnest([{'k': 'entity', 'v': 'C' || o_custkey}, {'k': 'value', 'v': o_orderstatus || ':' || o_orderkey}]) AS f FROM orders) SELECT o_orderkey, f.k AS field, f.v AS value FROM r""")
def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RECORD blocks parsed back into fields."""
    o = read(spark, sf_dir, "orders")
    text = core.render_record(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")), [("entity", F.concat(F.lit("C"), F.col("o_custkey").cast("string"))), ("value", F.concat_ws(":", "o_orderstatus", F.col("o_orderkey").cast("string")))], [])
    r = o.select("o_orderkey", F.explode(core.parse_records(text)).alias("r"))
    return r.select("o_orderkey", F.explode("r.fields").alias("field", "value"))


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT o_orderkey AS k, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('merge|q' || o_orderkey)) AS r FROM orders WHERE o_orderkey NOT IN (SELECT k FROM k))
SELECT k AS family, p AS question_type FROM k UNION ALL SELECT f.k, f.p FROM f LEFT JOIN (SELECT p, count(*) AS have FROM k GROUP BY 1) h USING (p) WHERE r <= 400 - coalesce(have, 0)""")
def merged_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept, and new ones up to 400 of each kind (the quota is the feature)."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("family"), F.lit("d").alias("domain"), F.col("o_orderpriority").alias("question_type"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question"), "o_orderstatus")
    want = o.select("domain", "question_type").distinct().withColumn("n", F.lit(400))
    kept = o.filter("o_orderstatus = 'P'").drop("o_orderstatus")
    return audit.merge_families(kept, o.drop("o_orderstatus"), want, F.col("family"), "merge").select("family", "question_type")
