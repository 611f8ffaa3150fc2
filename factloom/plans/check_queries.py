"""One query for each data-quality check, over families and contexts made from orders with planted faults, and DuckDB SQL
that finds the same violations. One SQL text, alike in both engines, makes the tables; it is the checks' input only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.plans import validate
from factloom.plans.context_queries import TOKENS
from factloom.plans.registry import ORACLE_SQL, QUERIES
from factloom.sources.envelope import read
from factloom.sources.shared import shared_folder

TIERS = ("WRONG_VERSION", "WRONG_PERIOD", "WRONG_ENTITY", "WRONG_FIELD", "WRONG_UNIT", "NEAR_MATCH_VALUE")
#: Flags of a placement, true where this holds of k, the family's number.
FLAGS = {"different_version": "k % 2 = 0", "different_period": "k % 3 = 0", "different_entity": "k % 4 <> 0", "same_entity": "k % 5 <> 0", "different_metric": "k % 7 <> 0", "same_period": "k % 8 <> 0", "value_within_5_percent": "k % 11 <> 0"}
_BLOCK = """replace(replace(replace({0}, '|', '">v</RECORD>|') || '">v</RECORD>', 'o', '<RECORD id="RAAAAAAA'), '|', ' ')"""
_FACT = "'d' AS domain, 'E' || o_custkey AS entity_id, 'c' || (o_orderkey % 3) AS concept, CASE WHEN o_orderkey % 11 = 0 THEN 'EUR' ELSE 'USD' END AS unit, 'CY' || year(o_orderdate) AS period, 'v' || o_orderkey AS version, o_totalprice AS value FROM orders"
#: Each fault is planted where k leaves a remainder; lists are joined by bars.
TABLES_SQL = f"""
ff AS (SELECT 'o' || o_orderkey AS record_id, {_FACT} UNION ALL SELECT 'o' || (o_orderkey + 10000000) AS record_id, {_FACT} WHERE o_orderkey % 4 = 0),
cu AS (SELECT o_custkey AS k, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey),
base AS (SELECT k, a, 'o' || a AS ra, 'o' || b AS rb, x.value AS va, y.value AS vb, x.concept AS ca, x.period AS pa, k % 5 <> 4 AS answerable FROM cu JOIN ff x ON x.record_id = 'o' || a JOIN ff y ON y.record_id = 'o' || b),
fam0 AS (SELECT k, 'F' || k AS family_id, 'd' AS domain, CASE WHEN k % 50 = 1 THEN ' Asked twice?' ELSE 'What is c of E' || k || CASE k % 61 WHEN 3 THEN ' if missing' WHEN 5 THEN ' rather than a guess' WHEN 9 THEN ', do not infer' ELSE '' END || '?' END AS question,
  CASE k % 5 WHEN 1 THEN 'RETRIEVAL_CALCULATION' WHEN 2 THEN 'TEMPORAL_VERSION' WHEN 4 THEN 'UNANSWERABLE' ELSE 'DIRECT_RETRIEVAL' END AS question_type, CASE WHEN k % 7 = 0 THEN 'OTHER' ELSE 'FRED_VINTAGE_SELECTION' END AS template, answerable,
  CASE WHEN (answerable AND k % 31 <> 0) OR k % 29 = 0 THEN 'x' END AS gold_answer,
  CASE WHEN k % 34 = 0 THEN NULL WHEN k % 38 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN NOT answerable THEN NULL WHEN k % 5 = 1 THEN va + vb ELSE va END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS gold_num,
  CASE WHEN k % 43 = 0 THEN 'STRANGE' WHEN answerable THEN 'NUMERIC' ELSE 'INSUFFICIENT_EVIDENCE' END AS answer_type, CASE WHEN answerable THEN CAST(0.5 AS DOUBLE) END AS tolerance,
  CASE WHEN NOT answerable OR k % 23 = 0 THEN '' ELSE ra || '|' || rb END AS gold, CASE WHEN NOT answerable THEN '' WHEN k % 17 = 0 THEN ra ELSE ra || '|' || rb END AS provenance, k % 19 <> 0 AS described,
  CASE WHEN k % 5 = 1 AND k % 37 <> 0 THEN 'sum' END AS operation, ra, CASE WHEN k % 45 = 1 THEN 'lost' ELSE rb END AS rb, va, CASE WHEN k % 15 = 1 THEN vb + 5 ELSE vb END AS vb, k % 55 = 1 AS half, 'E' || k AS entity_id, ca, pa FROM base),
fam AS (SELECT * FROM fam0 UNION ALL SELECT * FROM fam0 WHERE k % 97 = 3),
ins0 AS (SELECT base.*, n, CASE WHEN answerable THEN ra || '|' || rb ELSE '' END AS own FROM base CROSS JOIN (VALUES (100), (200)) AS v(n)),
ins1 AS (SELECT *, CASE WHEN answerable THEN own || '|' ELSE '' END || 'o' || (k * 3) AS short FROM ins0),
ins2 AS (SELECT *, CASE WHEN n = 100 OR k % 19 = 5 THEN short WHEN k % 11 = 0 THEN 'o' || (k * 3 + 1) || CASE WHEN answerable THEN '|' || own ELSE '' END || '|o' || (k * 3 + 2) WHEN k % 13 = 2 THEN 'o' || (k * 3 + 1) || '|o' || (k * 3) || CASE WHEN answerable THEN '|' || own ELSE '' END ELSE 'o' || (k * 3 + 1) || '|' || short || '|o' || (a + 10000000) END AS records FROM ins1),
ins AS (SELECT k, CASE WHEN k % 99 = 4 THEN 'X' ELSE 'F' END || k AS family_id, n AS nominal, n || 'T' AS label, CASE WHEN k % 27 = 0 AND n = 200 THEN 'Another question?' ELSE 'What is c of E' || k || CASE k % 61 WHEN 3 THEN ' if missing' WHEN 5 THEN ' rather than a guess' WHEN 9 THEN ', do not infer' ELSE '' END || '?' END AS question,
  CASE WHEN k % 28 = 0 AND n = 200 THEN 'y' WHEN answerable THEN 'x' END AS gold_answer, CASE WHEN k % 33 = 0 AND n = 200 THEN ra WHEN k % 36 = 4 THEN ra || '|' || rb ELSE own END AS gold, records, CASE WHEN k % 22 = 0 THEN replace('z' || records, 'zo', 'RBBBBBBB') WHEN k % 24 = 8 THEN replace('z' || records, 'zo', 'Q') WHEN k % 32 = 9 THEN records || '|o' || (k * 3) ELSE records END AS shown,
  {_BLOCK.format('records')} || CASE WHEN k % 21 = 0 THEN '</RECORD>' ELSE '' END AS context, CASE WHEN NOT answerable THEN '' ELSE {_BLOCK.format("ra || '|' || rb")} END || CASE WHEN k % 25 = 0 THEN 'x' ELSE '' END AS gold_block,
  n - 5 + CASE WHEN k % 9 = 0 THEN 10 WHEN k % 10 = 1 THEN -n / 2 ELSE 0 END AS tokens, CASE WHEN k % 14 = 0 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS relative_position, CASE WHEN k % 17 = 3 THEN 50 WHEN n = 200 THEN 100 END AS parent_nominal,
  CASE WHEN k % 3 > 0 THEN 20 + k % 60 END AS prompt_tokens, 70 AS prompt_budget, CASE WHEN k % 26 = 0 THEN 'RX' ELSE own END AS gold_shown FROM ins2),
gone AS (SELECT 'F' || k AS family_id, 400 AS nominal, 'POOL_EXHAUSTED' AS status FROM base WHERE k % 30 <> 0)"""
_SPARK = TABLES_SQL.replace("FROM orders", "FROM {orders}")


def _list(c: str) -> Column:
    return F.when(F.col(c) != "", F.split(c, r"\|")).otherwise(F.array().cast("array<string>"))


def _shown(c: str) -> Column:
    return F.transform(_list(c), lambda x: F.replace(x, F.lit("o"), F.lit("RAAAAAAA")))


def tables(spark: SparkSession, sf_dir: str) -> validate.Tables:
    """The checks' tables, as validate describes them."""
    orders = read(spark, sf_dir, "orders")
    of = lambda name: spark.sql(f"WITH {_SPARK} SELECT * FROM {name}", orders=orders)
    sums = F.col("operation").isNotNull()
    key = F.struct("entity_id", F.col("ca").alias("concept"), F.col("pa").alias("period"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("version"))
    families = of("fam").select(
        "*", _list("gold").alias("gold_ids"), _list("provenance").alias("provenance_ids"), F.when(F.col("described"), F.create_map(F.lit("k"), F.lit("v"))).alias("metadata"), F.when(sums, F.create_map(F.lit("a"), "ra", F.lit("b"), "rb")).alias("operand_ids"),
        F.when(sums & F.col("half"), F.create_map(F.lit("a"), "va")).when(sums, F.create_map(F.lit("a"), "va", F.lit("b"), "vb")).alias("operands"), F.array(key).alias("conditions"), F.when(~F.col("answerable"), F.array(F.lit("c1"))).alias("aliases"),
        F.when(~F.col("answerable"), F.col("entity_id")).alias("missing_entity"), F.lit(None).cast("string").alias("missing_period"),
    ).drop("entity_id")
    instances = of("ins").withColumns({"tokens": F.floor("tokens"), "gold_ids": _list("gold"), "record_ids": _list("records"), "display_ids": _shown("shown"), "gold_display_ids": _shown("gold_shown")})
    placed = instances.select("k", "family_id", "nominal", "gold_ids", F.posexplode("record_ids").alias("position", "record_id"))
    tier = F.when(F.col("k") % 16 == 0, None).when(F.col("k") % 18 == 0, "ODD").otherwise(F.get(F.array(*map(F.lit, TIERS)), ((F.col("k") + F.col("position")) % 6).cast("int")))
    side = F.when(F.array_contains("gold_ids", F.col("record_id")), "gold").when(F.col("position") == 0, "before").otherwise("after")
    flags = F.create_map(*[x for f, sql in FLAGS.items() for x in (F.lit(f), F.expr(sql))])
    placements = placed.select("family_id", "nominal", "record_id", side.alias("side"), "position", F.when(side != "gold", tier).alias("tier"), F.when(side != "gold", flags).alias("flags"))
    placements = placements.filter("not (cast(substring(family_id, 2, 20) as int) % 24 = 0 and position = 0)")
    return {"facts": of("ff"), "families": families, "instances": instances, "placements": placements, "unavailable": of("gone")}


_ARRAYS = f"""
fa AS (SELECT *, CASE WHEN gold = '' THEN []::VARCHAR[] ELSE string_split(gold, '|') END AS gold_ids, CASE WHEN provenance = '' THEN []::VARCHAR[] ELSE string_split(provenance, '|') END AS provenance_ids FROM fam),
i AS (SELECT *, family_id || '_' || label AS key, CASE WHEN gold = '' THEN []::VARCHAR[] ELSE string_split(gold, '|') END AS gold_ids, string_split(records, '|') AS record_ids, string_split(replace(shown, 'o', 'RAAAAAAA'), '|') AS display_ids,
  CASE WHEN gold_shown = '' THEN []::VARCHAR[] ELSE string_split(replace(gold_shown, 'o', 'RAAAAAAA'), '|') END AS gold_display_ids FROM ins),
p0 AS (SELECT *, unnest(record_ids) AS record_id, generate_subscripts(record_ids, 1) - 1 AS position FROM i),
p AS (SELECT k, family_id, nominal, record_id, position, CASE WHEN list_contains(gold_ids, record_id) THEN 'gold' WHEN position = 0 THEN 'before' ELSE 'after' END AS side,
  CASE WHEN k % 16 = 0 THEN NULL WHEN k % 18 = 0 THEN 'ODD' ELSE ({list(TIERS)})[(k + position) % 6 + 1] END AS tier FROM p0 WHERE NOT (substr(family_id, 2)::INT % 24 = 0 AND position = 0)),
ov AS (SELECT fa.*, x.value AS xa, y.value AS xb, x.unit AS ua, y.unit AS ub, (x.value IS NULL)::INT + (y.value IS NULL)::INT AS n_lost FROM fa LEFT JOIN ff x ON x.record_id = fa.ra LEFT JOIN ff y ON y.record_id = fa.rb WHERE operation IS NOT NULL),
leak AS (SELECT DISTINCT p.family_id, p.nominal, p.record_id, fa.answerable FROM p JOIN ff USING (record_id) JOIN fa ON fa.family_id = p.family_id WHERE p.side <> 'gold' AND ff.entity_id = fa.entity_id AND ff.concept = fa.ca AND ff.period = fa.pa)"""
_AT = "FROM (SELECT *, lag(record_ids) OVER w AS old, lag(nominal) OVER w AS last FROM i WINDOW w AS (PARTITION BY family_id ORDER BY nominal)) i WHERE old IS NOT NULL"
_KEPT = "list_filter(record_ids, lambda x: list_contains(old, x))"
_LOST = "len(list_filter(old, lambda x: NOT list_contains(record_ids, x)))"
_OPENED = """regexp_extract_all(context, '<RECORD id="([^"]+)"', 1)"""
_CLOSE = "abs({0} - {1}) <= greatest(1e-12 * greatest(abs({0}), abs({1})), 1e-9)"


def _rows(key: str, problem: str, rest: str) -> str:
    return f"SELECT {key} AS key, '{problem.replace(chr(39), chr(39) * 2)}' AS problem {rest}"


def _varies(column: str, problem: str) -> str:
    return _rows("family_id", problem, f"FROM i GROUP BY family_id HAVING count(DISTINCT {column}) > 1")


_NUMERIC = "answer_type IN ('NUMERIC', 'PERCENT', 'INTEGER')"
_MEANS = [("WRONG_VERSION", "different_version"), ("WRONG_PERIOD", "different_period"), ("WRONG_ENTITY", "different_entity"), ("WRONG_FIELD", "same_entity"), ("WRONG_FIELD", "different_metric"), ("WRONG_UNIT", "same_entity"), ("WRONG_UNIT", "same_period"), ("NEAR_MATCH_VALUE", "value_within_5_percent")]
_SQL: dict[str, list[str]] = {
    "A": [_rows("family_id", "duplicate family", "FROM fa GROUP BY family_id HAVING count(*) > 1"), _rows("family_id || '_' || label", "duplicate instance", "FROM i GROUP BY family_id, nominal, label HAVING count(*) > 1"), _rows("key", "no such family", "FROM i WHERE family_id NOT IN (SELECT family_id FROM fa)")],
    "B": [_rows("trim(question)", "question asked twice", "FROM fa GROUP BY domain, trim(question) HAVING count(*) > 1")],
    "C": [_rows("family_id", "gold records without provenance", "FROM fa WHERE answerable AND len(list_filter(gold_ids, lambda x: NOT list_contains(provenance_ids, x))) > 0"), _rows("family_id", "no metadata", "FROM fa WHERE NOT described")],
    "D": [_rows("family_id", "gold differs from the recomputed result", "FROM ov WHERE n_lost = 0 AND abs(xa + xb - gold_num) > 0.5"), _rows("family_id", "operands differ from the facts", f"FROM ov WHERE n_lost = 0 AND (NOT {_CLOSE.format('va', 'xa')} OR (NOT half AND NOT {_CLOSE.format('vb', 'xb')}))"),
          _rows("family_id", "gold differs from the fact", "FROM fa JOIN ff ON ff.record_id = gold_ids[1] WHERE answerable AND operation IS NULL AND question_type = 'DIRECT_RETRIEVAL' AND abs(value - gold_num) > 0.5")],
    "E": [_rows("key", "gold records are not in the context", "FROM i WHERE len(list_filter(gold_ids, lambda x: NOT list_contains(record_ids, x))) > 0")],
    "F": [_rows("key", "gold records of an unanswerable question", "FROM i JOIN fa USING (family_id) WHERE NOT answerable AND (list_has_any(record_ids, fa.gold_ids) OR len(i.gold_ids) > 0)")],
    "G": [_varies("question", "question varies"), _rows("key", "question differs from the family's", "FROM i JOIN fa USING (family_id) WHERE i.question <> fa.question").replace("key AS", "family_id AS")],
    "H": [_varies("coalesce(gold_answer, '')", "gold answer varies")],
    "I": [_varies("gold", "gold records vary"), _varies("gold_block", "gold block varies")],
    "J": [_rows("key", "records of the shorter context are lost", f"{_AT} AND {_LOST} > 0"), _rows("key", "order of the shorter context is lost", f"{_AT} AND {_LOST} = 0 AND {_KEPT} <> old"), _rows("key", "no growth", f"{_AT} AND len(record_ids) <= len(old)"), _rows("key", "wrong parent", f"{_AT} AND parent_nominal IS DISTINCT FROM last")],
    "K": [_rows("key", "over length", "FROM i WHERE floor(tokens) > nominal"), _rows("key", "under the minimum fill", "FROM i WHERE floor(tokens) < 0.9::DOUBLE * nominal")],
    "L": [_rows("key", "evidence is displaced", "FROM i WHERE abs(relative_position - 0.5) > 0.05")],
    "M": [_rows("key", "tags are not balanced", f"FROM i WHERE len({_OPENED}) <> len(regexp_extract_all(context, '</RECORD>'))"), _rows("key", "ids differ from those declared", f"FROM i WHERE {_OPENED} <> display_ids"), _rows("key", "a record twice", f"FROM i WHERE len(list_distinct({_OPENED})) <> len({_OPENED})")],
    "N": [_rows("family_id", "operands of different units", "FROM ov WHERE coalesce(ua, '') <> coalesce(ub, '')")],
    "O": [_rows("family_id", "unknown answer type", "FROM fa WHERE answer_type = 'STRANGE'"), _rows("family_id", "no gold answer", "FROM fa WHERE answerable AND gold_answer IS NULL"), _rows("family_id", "gold answer of an unanswerable question", "FROM fa WHERE NOT answerable AND gold_answer IS NOT NULL"), _rows("family_id", "numeric answer without a number", f"FROM fa WHERE answerable AND {_NUMERIC} AND gold_num IS NULL"), _rows("family_id", "no evidence", "FROM fa WHERE answerable AND gold = ''"), _rows("family_id", "calculation without operation", "FROM fa WHERE question_type = 'RETRIEVAL_CALCULATION' AND operation IS NULL")],
    "P": [_rows("key", "distractors differ from the context's", "FROM i LEFT JOIN (SELECT family_id, nominal, count(*) AS n FROM p WHERE side <> 'gold' GROUP BY ALL) c USING (family_id, nominal) WHERE len(record_ids) - len(gold_ids) <> coalesce(n, 0)"), _rows("family_id", "distractor without tier", "FROM p WHERE side <> 'gold' AND (tier IS NULL OR tier = 'ODD')")],
    "Q": [_rows("family_id", "gold is not finite", "FROM fa WHERE isinf(gold_num) OR isnan(gold_num)")],
    "R": [_rows("key", "gold block is not there exactly once", "FROM i WHERE gold_block <> '' AND (length(context) - length(replace(context, gold_block, ''))) // length(gold_block) <> 1")],
    "S": [_rows("family_id", "a record satisfies the question's condition", "FROM leak WHERE NOT answerable"), _rows("p.family_id", "a record of a forbidden concept", "FROM p JOIN ff USING (record_id) JOIN fa ON fa.family_id = p.family_id WHERE NOT answerable AND ff.concept = 'c1' AND ff.entity_id = fa.entity_id")],
    "T": [_rows("family_id", "operands without values", "FROM ov WHERE half"), _rows("family_id", "operands that are no facts", "FROM ov WHERE n_lost > 0"), _rows("family_id", "operands outside the evidence", "FROM ov WHERE NOT (list_contains(gold_ids, ra) AND list_contains(gold_ids, rb))")],
    "U": [_rows("t", "no such question", f"FROM (SELECT unnest({list(validate.QUESTION_TYPES)}) AS t) x WHERE t NOT IN (SELECT question_type FROM fa)")],
    "V": [_rows("family_id", "a distractor satisfies the question's condition", "FROM leak WHERE answerable")],
    "W": [_rows("key", "display ids differ in number", "FROM i WHERE len(display_ids) <> len(record_ids)"), _rows("key", "a display id twice", "FROM i WHERE len(list_distinct(display_ids)) <> len(display_ids)"), _rows("key", "malformed display id", "FROM i WHERE len(list_filter(display_ids, lambda x: NOT regexp_matches(x, '^R[A-Z0-9]{8,}$'))) > 0")],
    "X": [_rows("p.family_id", "a distractor is equivalent to the evidence", "FROM p JOIN ff USING (record_id) WHERE side <> 'gold' AND EXISTS (SELECT 1 FROM p g JOIN ff h USING (record_id) WHERE g.side = 'gold' AND g.family_id = p.family_id AND g.nominal = p.nominal AND h.entity_id = ff.entity_id AND h.concept = ff.concept AND h.unit = ff.unit AND h.version = ff.version AND h.period = ff.period AND h.value = ff.value)")],
    "Y": [_rows("family_id", f"{t} without {f}", f"FROM p WHERE side <> 'gold' AND tier = '{t}' AND NOT ({FLAGS[f]})") for t, f in _MEANS],
    "Z": [_rows("family_id", "wording gives away answerability", "FROM fa WHERE " + " OR ".join(f"regexp_matches(question, '{p}')" for p in core.LEAK_PATTERNS))],
    "AA": [_rows("key", "over the prompt budget", "FROM i WHERE prompt_tokens > prompt_budget"), _rows("key", "prompt tokens differ when counted again", f"FROM i WHERE prompt_tokens IS NOT NULL AND {TOKENS.replace('text', 'context')} + {TOKENS.replace('text', 'question')} <> prompt_tokens")],
    "AB": [_rows("family_id", "lengths that are neither there nor declared unavailable", "FROM fa LEFT JOIN (SELECT family_id, count(DISTINCT nominal) AS n FROM (SELECT family_id, nominal FROM i UNION ALL SELECT family_id, nominal FROM gone) GROUP BY 1) s USING (family_id) WHERE coalesce(n, 0) <> 3")],
    "AC": [_rows("key", "gold display ids differ from the context's", "FROM i WHERE list_transform(gold_ids, lambda g: display_ids[list_position(record_ids, g)]) <> gold_display_ids")],
    "AD": [_rows("family_id", "not a temporal template", "FROM fa WHERE question_type = 'TEMPORAL_VERSION' AND template = 'OTHER'")],
}


def _query(check: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validate.CHECKS[check][2](tables(spark, sf_dir))

    run.__doc__ = f"2.11: the violations of check {check} ({validate.CHECKS[check][0]}) on tables with planted faults."
    return run


for _check, _parts in _SQL.items():
    QUERIES[f"check_{_check.lower()}"] = _query(_check)
    ORACLE_SQL[f"check_{_check.lower()}"] = f"WITH {TABLES_SQL}, {_ARRAYS} " + " UNION ALL ".join(_parts)


def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11: violations of every check, counted, with what is shown of them. Each table is made once, for all checks."""
    folder, made = shared_folder(spark), {}
    for name, df in tables(spark, sf_dir).items():
        df.write.parquet(f"{folder}/{name}")
        made[name] = spark.read.parquet(f"{folder}/{name}")
    return validate.report(made, sorted(_SQL)).select("check_id", "severity", F.col("n_failed").cast("long").alias("n_failed"), "truncated", F.size("failures").cast("long").alias("n_shown"))


QUERIES["check_report"] = check_report
_COUNTS = ", ".join(f"v_{c.lower()} AS ({' UNION ALL '.join(parts)})" for c, parts in sorted(_SQL.items()))
ORACLE_SQL["check_report"] = f"WITH {TABLES_SQL}, {_ARRAYS}, {_COUNTS} " + " UNION ALL ".join(f"SELECT '{c}' AS check_id, '{validate.CHECKS[c][1]}' AS severity, count(*) AS n_failed, count(*) > {validate.CAP} AS truncated, least(count(*), {validate.CAP})::BIGINT AS n_shown FROM v_{c.lower()}" for c in sorted(_SQL))


def nesting_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that don't hold the next shorter one of their family in order."""
    before = F.lag("record_ids").over(Window.partitionBy("family_id").orderBy("nominal"))
    i = tables(spark, sf_dir)["instances"].select("family_id", F.col("nominal").cast("long").alias("nominal"), "record_ids", before.alias("before")).filter("before is not null")
    kept = F.filter("record_ids", lambda x: F.array_contains("before", x))
    return i.filter(kept != F.col("before")).select("family_id", "nominal", F.lit("order or content of the shorter context is lost").alias("problem"))


QUERIES["nesting_violations"] = nesting_violations
ORACLE_SQL["nesting_violations"] = f"WITH {TABLES_SQL}, {_ARRAYS} SELECT family_id, nominal::BIGINT AS nominal, 'order or content of the shorter context is lost' AS problem {_AT} AND {_KEPT} <> old"
