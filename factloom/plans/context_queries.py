"""Queries of conditions, distractors, rendering and packing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import conditions, distractors, selection
from factloom.plans import audit, packing
from factloom.plans.registry import query
from factloom.sources import envelope
from factloom.sources.envelope import FACTS_SQL, read
from factloom.sources.shared import kept, large

WITH = f"WITH {FACTS_SQL}, targets AS (SELECT entity_id AS target_id, * FROM event_facts QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version::BIGINT) = 1)"
LENGTHS = (512, 1024, 2048)


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event facts, and of each user the first one as a target."""
    facts = envelope.event_facts(spark, sf_dir)
    return facts, selection.first_by(facts, ["entity_id"], F.col("version").cast("long")).withColumn("target_id", F.col("entity_id"))


RELATED = """c AS (SELECT t.target_id, f.record_id,
  CASE WHEN f.entity_id = t.entity_id AND f.concept = t.concept AND f.period = t.period AND f.unit = t.unit AND f.version <> t.version THEN 'WRONG_VERSION'
       WHEN f.entity_id = t.entity_id AND f.concept = t.concept AND f.period <> t.period THEN 'WRONG_PERIOD'
       WHEN f.concept = t.concept AND f.period = t.period AND f.entity_id <> t.entity_id THEN 'WRONG_ENTITY'
       WHEN f.entity_id = t.entity_id AND f.concept <> t.concept THEN 'WRONG_FIELD'
       WHEN CASE WHEN t.value = 0 THEN f.value = 0 ELSE abs(f.value - t.value) / abs(t.value) <= 0.05 END THEN 'NEAR_MATCH_VALUE' ELSE 'OTHER_SAME_DOMAIN' END AS tier
  FROM event_facts f JOIN targets t ON f.record_id <> t.record_id)"""


@query(f"{WITH} SELECT t.target_id, count(*)::BIGINT AS n FROM event_facts f JOIN targets t ON f.entity_id = t.entity_id AND f.concept = t.concept GROUP BY 1")
def condition_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that satisfy each target's condition on entity and concept, other keys open."""
    facts, targets = _targets(spark, sf_dir)
    open_ = targets.select("target_id", "entity_id", "concept", *[F.lit(None).cast("string").alias(c) for c in ("period", "unit", "version")])
    return conditions.counts(facts, open_).groupBy(F.col("condition.target_id").alias("target_id")).agg(F.sum("n").alias("n"))


@query(f"""{WITH}, h AS (SELECT f.*, (extract(hour FROM ts) // 6)::VARCHAR AS band, floor(f.value / 20)::INT::VARCHAR AS step FROM event_facts f JOIN (SELECT event_id, ts FROM events) e ON f.record_id = 'events_' || e.event_id),
c AS (SELECT a.*, k FROM targets t JOIN h a ON a.record_id = t.record_id, range(3) AS r(k))
SELECT c.entity_id || '.' || k AS target_id, count(*)::BIGINT AS n FROM c JOIN h b ON b.band = c.band AND
  CASE k WHEN 0 THEN b.entity_id = c.entity_id WHEN 1 THEN b.period = c.period AND b.concept = c.concept AND b.step = c.step ELSE b.step = c.step AND b.period = c.period END
GROUP BY 1""")
def condition_metadata_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that name entries of a fact's metadata, with and without keys beside them."""
    facts, targets = _targets(spark, sf_dir)
    ts = read(spark, sf_dir, "events").select(F.concat(F.lit("events_"), F.col("event_id").cast("string")).alias("record_id"), "ts")
    entries = F.create_map(F.lit("band"), F.floor(F.hour("ts") / 6).cast("string"), F.lit("step"), F.floor(F.col("value") / 20).cast("string"))
    facts = facts.join(ts, "record_id").withColumn("metadata", entries).drop("ts")
    own = facts.join(targets.select("record_id"), "record_id", "left_semi")
    none, band = F.lit(None).cast("string"), F.map_filter("metadata", lambda k, v: k == "band")
    keys = lambda *named: [F.col(k) if k in named else none.alias(k) for k in conditions.KEYS]
    named = lambda k: F.concat("entity_id", F.lit(f".{k}")).alias("target_id")
    conds = own.select(named(0), *keys("entity_id"), band.alias("metadata")).unionByName(own.select(named(1), *keys("concept", "period"), "metadata")).unionByName(own.select(named(2), *keys("period"), "metadata"))
    return conditions.counts(facts, conds).groupBy(F.col("condition.target_id").alias("target_id")).agg(F.sum("n").alias("n"))


def _barred(facts: DataFrame, targets: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    conds = targets.select("target_id", "entity_id", "concept", "period", *[F.lit(None).cast("string").alias(c) for c in ("unit", "version")])
    return distractors.forbidden(facts, targets, conds, absent)


@query(f"""{WITH} SELECT t.target_id, count(DISTINCT f.record_id)::BIGINT AS n FROM event_facts f JOIN targets t ON f.record_id = t.record_id OR (f.entity_id = t.entity_id AND f.concept = t.concept AND f.period = t.period)
  OR (f.concept = 'error' AND f.entity_id = t.entity_id AND (f.period = t.period OR t.version::BIGINT % 2 = 0)) GROUP BY 1""")
def forbidden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold, what satisfies the conditions, and a concept that the question says is absent, of one period or of all."""
    facts, targets = _targets(spark, sf_dir)
    period = F.when(F.col("version").cast("long") % 2 != 0, F.col("period"))
    absent = targets.select("target_id", "domain", F.lit("error").alias("concept"), "entity_id", period.alias("period"))
    return _barred(facts, targets, absent).groupBy("target_id").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT t.target_id, f.record_id FROM event_facts f JOIN targets t ON f.record_id <> t.record_id AND CASE WHEN t.value = 0 THEN f.value = 0 ELSE abs(f.value - t.value) / abs(t.value) <= 0.05 END")
def near_match_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values within 5 % of the target's."""
    facts, targets = _targets(spark, sf_dir)
    t = targets.select("target_id", F.col("record_id").alias("own"), F.col("value").alias("t_value"))
    return conditions.near(facts.select("record_id", "value"), t, "value", "t_value").filter("own <> record_id").select("target_id", "record_id")


@query(f"{WITH}, {RELATED} SELECT * FROM c WHERE tier <> 'OTHER_SAME_DOMAIN'")
def classify_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's related facts with their tier."""
    facts, targets = _targets(spark, sf_dir)
    return distractors.related(facts, targets)


_FLAGS = {"entity": "entity_id", "metric": "concept", "period": "period", "unit": "unit", "version": "version"}
_FLAG_SQL = ", ".join(f"count_if(f.{c} IS NOT DISTINCT FROM t.{c})::BIGINT AS same_{n}, count_if(f.{c} IS DISTINCT FROM t.{c})::BIGINT AS different_{n}" for n, c in _FLAGS.items())


@query(f"{WITH} SELECT t.target_id, {_FLAG_SQL}, count_if(CASE WHEN t.value = 0 THEN f.value = 0 ELSE abs(f.value - t.value) / abs(t.value) <= 0.05 END)::BIGINT AS value_within_5_percent FROM event_facts f JOIN targets t ON f.entity_id = t.entity_id AND f.record_id <> t.record_id GROUP BY 1")
def relation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven relations of an entity's other facts to its target, counted."""
    facts, targets = _targets(spark, sf_dir)
    f, t = facts.alias("f"), targets.alias("t")
    both = f.join(t, (F.col("f.entity_id") == F.col("t.entity_id")) & (F.col("f.record_id") != F.col("t.record_id"))).select("t.target_id", distractors.flags("f", "t").alias("m"))
    names = [f"{kind}_{n}" for n in _FLAGS for kind in ("same", "different")] + ["value_within_5_percent"]
    return both.groupBy("target_id").agg(*[F.count_if(F.col("m")[n]).alias(n) for n in names])


@query(f"{WITH}, {RELATED} SELECT target_id, tier, count(*)::BIGINT AS n FROM c GROUP BY ALL")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3: facts of every tier; the last tier is what the domain has beyond the related ones."""
    facts, targets = _targets(spark, sf_dir)
    n = kept(distractors.related_counts(facts, targets))
    total = facts.count()
    other = targets.select("target_id").join(n.groupBy("target_id").agg(F.sum("n").alias("m")).hint("merge"), "target_id", "left").select("target_id", F.lit("OTHER_SAME_DOMAIN").alias("tier"), (F.lit(total - 1) - F.coalesce("m", F.lit(0))).alias("n"))
    return n.unionByName(other.filter("n > 0"))


ORDERED = f"""{RELATED}, w AS (SELECT * FROM (VALUES ('WRONG_VERSION', 0, 2), ('WRONG_UNIT', 1, 2), ('WRONG_SERIES_VARIANT', 2, 2), ('WRONG_PERIOD', 3, 3), ('WRONG_ENTITY', 4, 3), ('WRONG_FIELD', 5, 3), ('NEAR_MATCH_VALUE', 6, 2)) v(tier, r, weight)),
i AS (SELECT target_id, record_id, tier, r, weight, row_number() OVER (PARTITION BY target_id, tier ORDER BY xor(('0x' || substr(md5('distractors|' || target_id), 1, 15))::BIGINT, ('0x' || substr(md5('distractors|' || record_id), 1, 15))::BIGINT), record_id) AS n FROM c JOIN w USING (tier)),
o AS (SELECT target_id, record_id, tier, (n - 1) // weight AS cycle, (row_number() OVER (PARTITION BY target_id ORDER BY (n - 1) // weight, r, n))::INT AS position FROM i)"""


@query(f"{WITH}, {ORDERED} SELECT target_id, record_id, tier, cycle::BIGINT AS cycle, position FROM o WHERE position <= 60")
def tier_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted round-robin over the related tiers, the first 60 of each target (the limit is the feature)."""
    facts, targets = _targets(spark, sf_dir)
    return distractors.interleaved(facts, targets, 60)


@query("""WITH d AS (SELECT o_orderkey, 'R' || upper(substr(sha256('disp|orders_' || o_orderkey), 1, 6)) AS short, 'R' || upper(substr(sha256('disp|orders_' || o_orderkey), 1, 8)) AS long FROM orders)
SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN long ELSE short END AS display_id FROM d""")
def display_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque ids; those that collide are two digits longer."""
    k = F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string"))
    d = read(spark, sf_dir, "orders").select("o_orderkey", core.display_id("disp", k, 6).alias("short"), core.display_id("disp", k, 8).alias("long"))
    n = F.count("*").over(Window.partitionBy("short"))
    return d.select("o_orderkey", F.when(n > 1, F.col("long")).otherwise(F.col("short")).alias("display_id"))


@query("""WITH s AS (SELECT user_id, event_type, floor(value / 20) AS value, 'events_' || event_id AS id, ts::DATE AS day FROM events), p AS (SELECT a.id, list_sort(list(DISTINCT b.id)) AS ids FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.day = b.day AND abs(a.value - b.value) <= greatest(1e-12 * greatest(abs(a.value), abs(b.value)), 1e-9) GROUP BY 1)
SELECT DISTINCT 'EG' || upper(substr(sha256(array_to_string(ids, '|')), 1, 10)) AS group_id, array_to_string(ids, ',') AS members FROM p WHERE len(ids) > 1""")
def equivalence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the same keys and equal values, stated twice, form a group with an id of its members."""
    facts = envelope.event_facts(spark, sf_dir).withColumns({"version": F.lit("any"), "value": F.floor(F.col("value") / 20).cast("double")})
    return distractors.equivalents(facts).select("group_id", F.array_join("record_ids", ",").alias("members"))


TOKENS = r"list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), lambda x: greatest(1, length(x) // 4)))"


@query(f"SELECT doc_id, coalesce({TOKENS}, 0)::BIGINT AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: whitespace-tokenizer counts of whole texts."""
    return read(spark, sf_dir, "documents").select("doc_id", core.token_count(F.col("text")).alias("tokens"))


@query("""SELECT o_orderkey, '<RECORD id="R' || o_orderkey || '">' || chr(10) || 'entity: Customer ' || o_custkey || chr(10) || 'period: CY' || year(o_orderdate) || chr(10) || 'unit: USD' || chr(10) || 'value: ' || o_orderkey || coalesce(chr(10) || 'status: ' || o_orderstatus, '') || coalesce(chr(10) || 'priority: ' || o_orderpriority, '') || chr(10) || '</RECORD>' AS rendered FROM orders""")
def render_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10"""
    text = core.render_record(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")), [("entity", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))), ("period", F.concat(F.lit("CY"), F.year("o_orderdate").cast("string"))), ("unit", F.lit("USD")), ("value", F.col("o_orderkey")), ("version", F.lit(None).cast("string"))], [("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority"))])
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("rendered"))


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce({TOKENS}, 0)::BIGINT AS tokens FROM conversations)
SELECT conv_id, turn, tokens, (coalesce(sum(tokens) OVER w, 0))::BIGINT AS start, (sum(tokens) OVER (PARTITION BY conv_id))::BIGINT AS total FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cumulative_token_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part of a context starts."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", core.token_count(F.col("text")).alias("tokens"))
    w = Window.partitionBy("conv_id")
    start = F.coalesce(F.sum("tokens").over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", "turn", "tokens", start.alias("start"), F.sum("tokens").over(w).alias("total"))


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates and gold of each target, with tokens and texts, and the texts of all facts."""
    facts, targets = _targets(spark, sf_dir)
    text = core.render_record(core.display_id("pack", F.col("record_id")), [(c, F.col(c)) for c in ("entity_id", "concept", "period", "unit", "value", "version")], [])
    texts = large(facts.select("record_id", text.alias("text")).withColumn("tokens", core.token_count(F.col("text"))))
    chosen = distractors.candidates(facts, targets, max(LENGTHS) // 24 + 256, barred=_barred(facts, targets))
    cand = chosen.join(texts, "record_id").select(F.col("target_id").alias("family_id"), "record_id", "position", "tokens", "text")
    question = F.concat(F.lit("What is the value of "), F.col("concept"), F.lit(" of "), F.col("entity_id"), F.lit(" on "), F.col("period"), F.lit("?"))
    gold = targets.select(F.col("target_id").alias("family_id"), "record_id", F.lit(0).alias("ord"), question.alias("question")).join(texts, "record_id")
    return cand, gold, texts


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cand, gold, texts = _pieces(spark, sf_dir)
    return packing.pack(cand, gold, LENGTHS), texts


#: Tokens that a prompt may have: the instructions, the question and the context.
PROMPT_BUDGET = 1500


def plain_prompt(context: str, question: str) -> str:
    """audit.prompt, for code that runs within a group."""
    return f"<|system|>\n{audit.SYSTEM}\n<|user|>\n{context or ''}\n\nQuestion: {question or ''}\n<|assistant|>\n"


@query()
def pack_within_prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts whose rendered prompts keep within a budget lose records of their heavier side until they do. Each row has
    the tokens of the context and of the prompt as they are counted again from the joined texts."""
    cand, gold, texts = _pieces(spark, sf_dir)
    packed = packing.pack(cand, gold, LENGTHS, fill=0.6, budget=PROMPT_BUDGET, count=core.count_tokens, prompt=plain_prompt)
    joined = packed.join(texts.select("record_id", "text"), "record_id", "left").groupBy("family_id", "nominal", "status", F.col("tokens").alias("context_tokens"))
    whole = joined.agg(F.count("text").alias("n_records"), F.array_join(F.array_sort(F.collect_list(F.struct("position", "text"))).getField("text"), "\n").alias("context"))
    text = audit.prompt(F.col("context"), F.col("question"))
    out = whole.join(gold.select("family_id", "question"), "family_id")
    return out.select("family_id", "nominal", "status", "context_tokens", "n_records", F.when(F.col("status") == "OK", core.token_count(text)).alias("prompt_tokens"), F.when(F.col("status") == "OK", F.sha2("context", 256)).alias("context_sha256"))


@query()
def pack_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's packed contexts of three lengths, one row for each placed record."""
    return _packed(spark, sf_dir)[0]


@query()
def packed_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts put together, with hashes and lineage."""
    packed, texts = _packed(spark, sf_dir)
    return packing.instances(packed, texts).select("family_id", "nominal", "tokens", "relative_position", "context_sha256", F.size("record_ids").alias("n_records"), F.size("added_ids").alias("n_added"))


@query()
def placement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: placed records by length and side."""
    return _packed(spark, sf_dir)[0].groupBy("nominal", "status", "side").agg(F.count("*").alias("n"))


@query()
def trimmed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest contexts trimmed in turn from both ends to 1,600 tokens."""
    packed, texts = _packed(spark, sf_dir)
    placed = packed.filter((F.col("status") == "OK") & (F.col("nominal") == max(LENGTHS))).join(texts.select("record_id", F.col("tokens").alias("size")), "record_id")
    return packing.trimmed(placed, 1600).select("family_id", "nominal", "record_id", "side", "position", "size")


TURNS = """s AS (SELECT conv_id AS family_id, turn AS position, CASE WHEN turn % 2 = 0 THEN 'before' ELSE 'after' END AS side, coalesce({t}, 0)::BIGINT AS size FROM conversations), m AS (SELECT family_id, max(position) // 2 AS middle FROM s GROUP BY 1),
p AS (SELECT family_id, position, size, CASE WHEN position < middle THEN 'before' WHEN position > middle THEN 'after' ELSE 'gold' END AS side FROM s JOIN m USING (family_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY family_id, side ORDER BY CASE WHEN side = 'after' THEN -position ELSE position END) - 1 AS own, count(*) FILTER (WHERE side = 'before') OVER (PARTITION BY family_id) AS nf, count(*) FILTER (WHERE side = 'after') OVER (PARTITION BY family_id) AS nb, sum(size) OVER (PARTITION BY family_id) AS total FROM p),
q AS (SELECT *, CASE side WHEN 'before' THEN own + least(own, nb) WHEN 'after' THEN own + least(own + 1, nf) END AS turn FROM o)""".format(t=TOKENS)


@query(f"""WITH {TURNS} SELECT a.family_id::VARCHAR AS family_id, a.position::INT AS position, a.size FROM q a WHERE a.side = 'gold' OR a.total - coalesce((SELECT sum(b.size) FROM q b WHERE b.family_id = a.family_id AND b.turn < a.turn), 0) <= 60""")
def trimmed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations around their middle turn, trimmed in turn from both ends to 60 tokens."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("family_id"), F.lit(1).alias("nominal"), F.col("turn").cast("int").alias("position"), core.token_count(F.col("text")).alias("size"))
    middle = F.floor(F.max("position").over(Window.partitionBy("family_id")) / 2)
    side = F.when(F.col("position") < middle, "before").when(F.col("position") > middle, "after").otherwise("gold")
    placed = c.withColumn("side", side).withColumn("record_id", F.col("position").cast("string"))
    return packing.trimmed(placed, 60).select("family_id", "position", "size")


@query(f"""{WITH} , n AS (SELECT *, row_number() OVER (PARTITION BY domain, entity_id ORDER BY record_id) AS k FROM event_facts)
SELECT 'Q' || t.target_id AS target_id, n.record_id FROM n JOIN targets t USING (entity_id) WHERE k <= 4""")
def absent_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four facts of an entity stand for what is missing."""
    facts, targets = _targets(spark, sf_dir)
    absent = targets.select(F.concat(F.lit("Q"), "target_id").alias("target_id"), "domain", "entity_id")
    return distractors.anchors(facts, absent).select("target_id", "record_id")


@query(f"""{WITH} SELECT 'Q' || t.target_id AS target_id, f.record_id, 'NEAR_MATCH_VALUE' AS tier FROM event_facts f JOIN targets t ON CASE WHEN t.value = 0 THEN f.value = 0 ELSE abs(f.value - t.value) / abs(t.value) <= 0.05 END""")
def near_without_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a target record only an answer's value relates facts to a question, whatever their unit."""
    facts, targets = _targets(spark, sf_dir)
    alone = targets.select(F.concat(F.lit("Q"), "target_id").alias("target_id"), "domain", "value", *[F.lit(None).cast("string").alias(c) for c in ("record_id", "entity_id", "concept", "period", "unit", "version")])
    return distractors.related(facts, alone)
