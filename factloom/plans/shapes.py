"""Queries over the driver's tables: facts, normalisation and the shapes of question templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import calc, selection
from factloom.plans.registry import query
from factloom.sources import envelope
from factloom.sources.envelope import FACTS_SQL, read

WITH = f"WITH {FACTS_SQL}"


@query(f"{WITH} SELECT * FROM line_facts")
def facts_unpivot_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.line_facts(spark, sf_dir)


@query(f"{WITH} SELECT * FROM order_facts")
def facts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.order_facts(spark, sf_dir)


@query(f"{WITH} SELECT * FROM event_facts")
def facts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.event_facts(spark, sf_dir)


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


YEARLY = "y AS (SELECT o_custkey, year(o_orderdate)::INT AS yr, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY ALL)"


@query(f"WITH {YEARLY} SELECT c.o_custkey, c.yr, c.total AS current_total, p.total AS previous_total, (c.total - p.total) / p.total * 100 AS growth_percent FROM y c JOIN y p ON c.o_custkey = p.o_custkey AND c.yr = p.yr + 1 WHERE p.total <> 0")
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's growth over the year before. The self-join reuses one shuffle by customer and year."""
    y = _yearly(spark, sf_dir)
    at = Window.partitionBy("o_custkey").orderBy("yr")
    # lag over the customer's years with a check for gaps: one shuffle instead of a self-join's two
    out = y.withColumn("previous_total", F.lag("total").over(at)).withColumn("previous_yr", F.lag("yr").over(at)).filter("previous_yr = yr - 1")
    return out.select("o_custkey", "yr", F.col("total").alias("current_total"), "previous_total", calc.growth_percent(F.col("total"), F.col("previous_total")).alias("growth_percent")).filter("growth_percent is not null")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence of a key in path and position order."""
    return selection.first_by(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, 'PT_' || trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '-') || '_' || trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-') || '_' || substr(sha1('PT|' || coalesce(p_name, '') || '|' || coalesce(p_brand, '')), 1, 8) AS record_id FROM part")
def record_id_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable, collision-safe record ids."""
    return read(spark, sf_dir, "part").select("p_partkey", core.record_id("PT", F.col("p_name"), F.col("p_brand")).alias("record_id"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, user_id FROM events WHERE props->>'$.k' IS NOT NULL")
def json_props_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column read with a schema, exploded as a map."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "k"))
    return e.filter("key = 'k'").select("event_id", "k", "user_id")


@query("""SELECT o_custkey, n::INT AS column_no, v AS cell FROM (
  SELECT o_custkey, unnest(range(1, 4)) AS n, unnest(string_split(o_custkey || ',' || o_orderstatus || ',' || year(o_orderdate), ',')) AS v FROM orders)""")
def csv_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV payload in a string column, wide to long by position."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.concat_ws(",", F.col("o_custkey").cast("string"), "o_orderstatus", F.year("o_orderdate").cast("string")).alias("line"))
    return o.select("o_custkey", F.posexplode(F.split("line", ",")).alias("p", "cell")).select("o_custkey", (F.col("p") + 1).alias("column_no"), "cell")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderstatus AS other FROM orders")
def date_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact dates to ISO, other texts as they are."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("d"), "o_orderstatus")
    return o.select("o_orderkey", core.canonical_date(F.col("d")).alias("iso"), core.canonical_date(F.col("o_orderstatus")).alias("other"))


@query("SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS num, TRY_CAST(p_brand AS DOUBLE) AS bad FROM part")
def number_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite numbers or null."""
    return read(spark, sf_dir, "part").select("p_partkey", core.canonical_number(F.col("p_size").cast("string")).alias("num"), core.canonical_number(F.col("p_brand")).alias("bad"))


PERIOD_ROWS = """p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'CY' || year(o_orderdate) || 'Q' || quarter(o_orderdate) WHEN 1 THEN 'CY' || year(o_orderdate) END AS frame,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS s, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS e FROM orders)"""


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    year, quarter = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    frame = F.when(k == 0, F.concat(F.lit("CY"), year, F.lit("Q"), quarter)).when(k == 1, F.concat(F.lit("CY"), year))
    return o.select("o_orderkey", frame.alias("frame"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("s"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd").alias("e"))


@query(f"WITH {PERIOD_ROWS} SELECT o_orderkey, coalesce(frame, s || '..' || e, 'AS_OF_' || e) AS label FROM p")
def period_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2"""
    return _periods(spark, sf_dir).select("o_orderkey", core.period_label(F.col("frame"), F.col("s"), F.col("e")).alias("label"))


@query(f"WITH {PERIOD_ROWS} SELECT o_orderkey, CASE WHEN frame LIKE '%Q%' THEN 'quarterly' WHEN frame IS NOT NULL THEN 'annual' WHEN s IS NULL THEN 'instant' ELSE 'duration' END AS kind FROM p")
def period_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3"""
    return _periods(spark, sf_dir).select("o_orderkey", core.period_kind(F.col("frame"), F.col("s")).alias("kind"))


@query(f"""WITH {PERIOD_ROWS}, l AS (SELECT o_orderkey, coalesce(frame, s || '..' || e, 'AS_OF_' || e) AS x FROM p)
SELECT o_orderkey, CASE WHEN x LIKE 'CY%Q%' THEN strftime(make_date(substr(x, 3, 4)::INT, substr(x, 8, 1)::INT * 3 - 2, 1), '%Y-%m-%d') WHEN x LIKE 'CY%' THEN substr(x, 3, 4) || '-01-01' WHEN x LIKE '%..%' THEN split_part(x, '..', 1) ELSE x END AS first,
       CASE WHEN x LIKE 'CY%Q%' THEN strftime(last_day(make_date(substr(x, 3, 4)::INT, substr(x, 8, 1)::INT * 3, 1)), '%Y-%m-%d') WHEN x LIKE 'CY%' THEN substr(x, 3, 4) || '-12-31' WHEN x LIKE '%..%' THEN split_part(x, '..', 2) ELSE x END AS last FROM l""")
def period_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6"""
    p = _periods(spark, sf_dir).select("o_orderkey", core.period_span(core.period_label(F.col("frame"), F.col("s"), F.col("e"))).alias("x"))
    return p.select("o_orderkey", "x.first", "x.last")


@query("""SELECT n.l_partkey, n.yr, n.ext AS numerator, coalesce(a.v, b.v) AS denominator, n.ext / coalesce(a.v, b.v) * 100 AS ratio_percent FROM
 (SELECT l_partkey, year(l_shipdate)::INT AS yr, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS ext FROM lineitem GROUP BY ALL) n
 LEFT JOIN (SELECT l_partkey, year(l_shipdate)::INT AS yr, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a USING (l_partkey, yr)
 LEFT JOIN (SELECT l_partkey, year(l_shipdate)::INT AS yr, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY ALL) b USING (l_partkey, yr)
 WHERE coalesce(a.v, b.v) <> 0""")
def ratio_prioritised_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerator over a preferred denominator with a fallback; both come out of one aggregation."""
    d = lambda c: F.col(c).cast("decimal(18,2)")
    li = read(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("yr")).agg(F.sum(d("l_extendedprice")).cast("double").alias("numerator"), F.sum(F.when(F.col("l_returnflag") == "R", d("l_quantity"))).cast("double").alias("a"), F.sum(d("l_quantity")).cast("double").alias("b"))
    out = li.withColumn("denominator", F.coalesce("a", "b"))
    return out.select("l_partkey", "yr", "numerator", "denominator", calc.ratio_percent(F.col("numerator"), F.col("denominator")).alias("ratio_percent")).filter("ratio_percent is not null")


@query("""SELECT event_id, user_id, value, (SELECT max_by(p.value, p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.event_id < e.event_id AND p.value <> 0) AS previous FROM events e""")
def asof_prev_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last earlier value of the series that isn't zero."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return selection.previous_nonzero(e, ["user_id", "event_type"], "event_id", "value").select("event_id", "user_id", "value", "previous")


@query("""WITH q AS (SELECT o_custkey, year(o_orderdate)::INT AS yr, quarter(o_orderdate)::INT AS qtr, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL),
y AS (SELECT o_custkey, year(o_orderdate)::INT AS yr, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL)
SELECT q.o_custkey, q.yr, q.qtr, q.v AS quarter_value, y.v AS year_value FROM q JOIN y USING (o_custkey, yr) WHERE q.qtr <= 3 AND q.v <> y.v""")
def quarter_vs_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters beside the year that holds them, where the values differ."""
    q = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qtr")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    q = q.withColumn("y", F.sum("v").over(Window.partitionBy("o_custkey", "yr")))
    return q.filter("qtr <= 3 and v <> y").select("o_custkey", "yr", "qtr", F.col("v").cast("double").alias("quarter_value"), F.col("y").cast("double").alias("year_value"))


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, max(value) AS v FROM events GROUP BY ALL)
SELECT a.day, a.event_type AS a_type, b.event_type AS b_type, a.v - b.v AS spread FROM d a JOIN d b ON a.day = b.day AND a.event_type < b.event_type AND a.v <> b.v""")
def series_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series at the same period; the pairs of series are a broadcast dimension of at most 25 rows."""
    d = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max("value").alias("v"))
    a, b = d.select("day", F.col("event_type").alias("a_type"), F.col("v").alias("a")), d.select("day", F.col("event_type").alias("b_type"), F.col("v").alias("b"))
    return a.join(b, "day").filter("a_type < b_type and a <> b").select("day", "a_type", "b_type", calc.difference(F.col("a"), F.col("b")).alias("spread"))


@query("""SELECT o_custkey, yr, arg_max(v, k) AS latest, count(DISTINCT v)::BIGINT AS n_values FROM (SELECT o_custkey, year(o_orderdate)::INT AS yr, o_totalprice AS v, o_orderkey AS k FROM orders) GROUP BY ALL HAVING count(DISTINCT v) >= 2 AND count(DISTINCT k) >= 2""")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of periods with several values and filings, the value of the last filing."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.max_by("o_totalprice", "o_orderkey").alias("latest"), F.countDistinct("o_totalprice").alias("n_values"), F.countDistinct("o_orderkey").alias("n_filings"))
    return o.filter("n_values >= 2 and n_filings >= 2").drop("n_filings")


@query("""SELECT user_id, event_type, arg_min(value, event_id) AS earliest, arg_max(value, event_id) AS latest FROM events GROUP BY ALL HAVING count(DISTINCT value) >= 2""")
def version_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest vintage beside the latest, where values differ."""
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("earliest"), F.max_by("value", "event_id").alias("latest"), F.countDistinct("value").alias("n"))
    return e.filter("n >= 2").drop("n")


@query("""WITH g AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id, md5('bind|' || event_type || '|' || strftime(ts, '%Y-%m-%d') || '|' || user_id) AS h FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY h) AS r, count(*) OVER (PARTITION BY event_type, day) AS c FROM g)
SELECT event_type, day, max(CASE WHEN r = 1 THEN user_id END) AS target, string_agg(CASE WHEN r BETWEEN 2 AND 4 THEN user_id::VARCHAR END, ',' ORDER BY r) AS foils FROM n WHERE c >= 3 GROUP BY ALL""")
def entity_binding_ge3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of groups of three entities or more, one picked by hash and up to three foils."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    g = read(spark, sf_dir, "events").select("event_type", day, "user_id").distinct()
    at = Window.partitionBy("event_type", "day")
    g = g.withColumn("h", core.order_key("bind", F.col("event_type"), F.col("day"), F.col("user_id"))).withColumn("r", F.row_number().over(at.orderBy("h"))).withColumn("c", F.count("*").over(at)).filter("c >= 3 and r <= 4")
    foils = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", F.col("user_id").cast("string").alias("u"))))), lambda x: x["u"]), ",")
    return g.groupBy("event_type", "day").agg(F.max(F.when(F.col("r") == 1, F.col("user_id"))).alias("target"), foils.alias("foils"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12")
def count_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of 2 to 12 members."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).filter("n_lines between 2 and 12")


@query("SELECT l_partkey, max(l_quantity) AS greatest, min(l_quantity) AS least, max(l_quantity) / min(l_quantity) AS ratio FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) >= 2 AND min(l_quantity) <> 0")
def max_min_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest over least of each key."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("greatest"), F.min("l_quantity").alias("least")).filter("greatest <> least and least <> 0")
    return g.withColumn("ratio", calc.ratio(F.col("greatest"), F.col("least")))


@query("SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE > o_orderdate::DATE")
def days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive durations from two dated facts of an entity."""
    li, o = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", days.alias("days")).filter("days > 0")


@query("SELECT l_orderkey, min(l_shipdate) FILTER (WHERE l_linenumber = 1) AS original, count(*) FILTER (WHERE l_linenumber > 1)::BIGINT AS supplements FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber > 1) >= 2 AND count(*) FILTER (WHERE l_linenumber = 1) > 0")
def orig_vs_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original's date where there are two supplements or more."""
    first = F.col("l_linenumber") == 1
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(first, F.col("l_shipdate"))).alias("original"), F.count_if(~first).alias("supplements"))
    return g.filter("supplements >= 2 and original is not null")


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate)::INT AS yr, max(o_totalprice) AS v FROM orders GROUP BY ALL), m AS (SELECT o_custkey, max(v) AS best FROM y GROUP BY 1)
SELECT o_custkey, best, max(yr) AS "at" FROM y JOIN m USING (o_custkey) WHERE v = best GROUP BY ALL HAVING count(*) = 1""")
def argmax_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of the greatest value, ties rejected."""
    y = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.max("o_totalprice").alias("v"))
    return selection.argmax_unique(y, ["o_custkey"], "v", "yr")


@query("SELECT u.user_id, t.event_type, d.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t, (SELECT min(strftime(ts, '%Y-%m-%d')) AS day FROM events) d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type AND strftime(e.ts, '%Y-%m-%d') = d.day)")
def cross_minus_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity x concept at a fixed period, less what is reported. Concepts (a closed list) ride along as an array,
    so no cross join is planned."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    day = e.agg(F.min("day")).first()[0]
    types = selection.few_values(e, "event_type")
    reported = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("day") == day, F.col("event_type"))).alias("have"))
    return reported.select("user_id", F.explode(F.array_except(F.array(*map(F.lit, types)), F.col("have"))).alias("event_type"), F.lit(day).alias("day"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def missing_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without the attribute."""
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('seed1|' || o_orderkey), o_orderkey) AS n FROM orders) WHERE n = 1")
def hash_sample_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key after a seeded shuffle."""
    return selection.first_by(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], core.order_key("seed1", F.col("o_orderkey")), "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 25")
def topn_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 25 of each group (the limit is the feature)."""
    o = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return selection.top_by(o, ["o_orderpriority"], 25, F.col("o_totalprice").desc(), "o_orderkey")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderstatus <> 'F', md5('pref|' || o_orderkey)))::INT AS place FROM orders QUALIFY place <= 200")
def preferred_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred rows first, then by seeded hash; the first 200 (the limit is the feature)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "F").alias("other"), core.order_key("pref", F.col("o_orderkey")).alias("h")).orderBy("other", "h").limit(200)
    return o.select("o_orderkey", F.row_number().over(Window.orderBy("other", "h")).alias("place"))


@query("""SELECT o_custkey, yr FROM (SELECT o_custkey, yr, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('w6|' || o_custkey || '|' || yr)) AS n FROM (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS yr FROM orders)) WHERE n <= 4""")
def sample_of_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four periods of each entity by hash (the limit is the feature)."""
    y = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("yr")).distinct()
    return selection.top_by(y, ["o_custkey"], 4, core.order_key("w6", F.col("o_custkey"), F.col("yr")))


@query("SELECT r_regionkey, r_name, n, floor(100 * n / s)::BIGINT + (row_number() OVER (ORDER BY floor(100 * n / s) - 100 * n / s, r_regionkey) <= 100 - sum(floor(100 * n / s)) OVER ())::INT::BIGINT AS seats FROM (SELECT r_regionkey, r_name, count(*)::BIGINT AS n, sum(count(*)) OVER () AS s FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL)")
def allocation_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8"""
    g = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"))
    return selection.allocate_rows(g, "n", 100)


@query("SELECT s_suppkey, 'N' || s_nationkey || '_' || lpad((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::VARCHAR, 4, '0') AS family_id FROM supplier")
def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9"""
    s = selection.ranked(read(spark, sf_dir, "supplier"), ["s_nationkey"], "n", "s_suppkey")
    return s.select("s_suppkey", F.format_string("N%d_%04d", "s_nationkey", "n").alias("family_id"))


@query("SELECT o_orderkey, md5('run|' || o_orderkey) AS h FROM orders")
def execution_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded order of a run, as sortable keys; positions follow by range partitioning when written."""
    return read(spark, sf_dir, "orders").select("o_orderkey", core.order_key("run", F.col("o_orderkey")).alias("h"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('run|' || o_orderkey), o_orderkey) AS position FROM orders")
def execution_order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place in the seeded order of a run."""
    return selection.positions(read(spark, sf_dir, "orders").select("o_orderkey"), core.order_key("run", F.col("o_orderkey")), "o_orderkey")


def _longer(k: int) -> str:
    """Ids of 2 + 2k digits: of those still open the first of each takes it, the others go on."""
    return f"i{k} AS (SELECT id, substr(h, 1, {2 + 2 * k}) AS p, row_number() OVER (PARTITION BY substr(h, 1, {2 + 2 * k}) ORDER BY id) AS r FROM d WHERE id IN ({'SELECT id FROM d' if k == 0 else f'SELECT id FROM i{k - 1} WHERE r > 1'}))"


@query(f"WITH d AS (SELECT o_orderkey AS id, upper(sha256('disp|' || o_orderkey)) AS h FROM orders), {', '.join(map(_longer, range(8)))} " + " UNION ALL ".join(f"SELECT id AS o_orderkey, 'R' || p AS display_id FROM i{k} WHERE r = 1" for k in range(8)))
def unique_display_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque ids of two digits, two more for whatever still collides, again and again."""
    return selection.unique_ids(read(spark, sf_dir, "orders"), "o_orderkey", "disp", digits=2).withColumnRenamed("unique_id", "display_id")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY min(l_orderkey * 10 + l_linenumber), 1 LIMIT 10)")
def first_groups_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the first ten groups in order of encounter (the limit is the feature)."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    first = li.groupBy("l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")).orderBy("at", "l_partkey").limit(10)
    return li.join(F.broadcast(first.select("l_partkey")), "l_partkey", "left_semi")


_LENGTH = "512 * (1 + doc_id % 300)"


@query(f"SELECT doc_id, CASE WHEN {_LENGTH} % 1024 = 0 THEN ({_LENGTH} // 1024) || 'K' ELSE ({_LENGTH})::VARCHAR END AS label FROM documents")
def length_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of contexts as labels."""
    return read(spark, sf_dir, "documents").select("doc_id", core.length_label(512 * (1 + F.col("doc_id") % 300)).alias("label"))


# Messages of failed runs, and their classes for other errors and for errors of a value.
_FAILURES = (
    ("CUDA out of memory. Tried to allocate 2 GiB", "CUDA_OOM", "CUDA_OOM"), ("worker ran out of memory", "CPU_OOM", "CPU_OOM"), ("Cannot allocate memory", "CPU_OOM", "CPU_OOM"),
    ("Token budget exceeded: 9000", "GENERATION_ERROR", "TOKEN_BUDGET_FAILURE"), ("cuda device-side assert", "GENERATION_ERROR", "GENERATION_ERROR"),
)


@query("SELECT o_orderkey, CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN CASE WHEN o_orderstatus = 'F' THEN '{v}' ELSE '{o}' END" for i, (_, o, v) in enumerate(_FAILURES)) + " END AS failure FROM orders")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a run's failure by its message and kind."""
    o = read(spark, sf_dir, "orders")
    message = F.element_at(F.array(*[F.lit(m) for m, _, _ in _FAILURES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", core.failure_class(message, F.col("o_orderstatus") == "F").alias("failure"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round_even(l_quantity / 8, 2) AS eighth FROM lineitem")
def rounded_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves to even, as binary values have them."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", core.python_round(F.col("l_quantity") / 8, 2).alias("eighth"))


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN o_totalprice ELSE -floor(o_totalprice * 40) / 32 END AS v, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4)::INT END AS d FROM orders),
t AS (SELECT *, format('{:,}', abs(trunc(v))::BIGINT) AS whole, rtrim(lpad(((round(abs(v) * 1000000))::HUGEINT % 1000000)::VARCHAR, 6, '0'), '0') AS part FROM v)
SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || whole || CASE WHEN part <> '' THEN '.' || part ELSE '' END AS shown, CASE WHEN d IS NOT NULL THEN 0.5 * pow(10.0, -d) WHEN v = floor(v) THEN 0.5 ELSE 0.0000005 END AS tolerance FROM t""")
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as answers show them, and half of the last place shown."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    v = F.when(k % 3 == 0, F.floor(price).cast("double")).when(k % 3 == 1, price).otherwise(-F.floor(price * 40) / 32)
    places = F.when(k % 4 > 0, (k % 4).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"), places.alias("d")).select("o_orderkey", core.format_value(F.col("v")).alias("shown"), core.tolerance(F.col("v"), F.col("d")).alias("tolerance"))
