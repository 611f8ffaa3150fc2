"""What the findings of round 3 asked for."""

from pyspark.sql import functions as F

from factloom.operators import conditions, distractors, selection
from factloom.plans import grading

FACT = "record_id string, domain string, entity_id string, concept string, unit string, period string, version string, value double"


def test_of_equal_attempts_the_first_in_the_table_counts(spark, tmp_path):
    rows = [(i % 50, 1, float(i)) for i in range(5000)]
    spark.createDataFrame(rows, "instance_id long, attempt int, q double").coalesce(1).write.parquet(str(tmp_path / "r"))
    results = spark.read.parquet(str(tmp_path / "r")).select("*", F.col("_metadata.row_index").alias("row")).orderBy(F.col("q").desc())
    instances = spark.range(50).select(F.col("id").alias("instance_id"), F.col("id").alias("family_id"))
    got = grading.join_results(instances, results, instances.select("family_id"), place=("row",)).collect()
    assert {r.instance_id: r.q for r in got} == {i: float(i) for i in range(50)} and all(r.attempts == 100 for r in got)


def test_conditions_are_counted_without_pairs(spark):
    schema = FACT + ", metadata map<string,string>"
    rows = [(f"r{i:03}", "d", f"E{i % 3}", f"c{i % 2}", "u", f"p{i % 5}", "v", 1.0, None if i % 7 == 0 else {"a": str(i % 4)} | ({"b": None} if i % 5 == 0 else {})) for i in range(120)]
    facts = spark.createDataFrame(rows, schema)
    wanted = [("E1", None, {"a": "1"}), (None, "c1", None), (None, None, {"a": "2", "b": None}), (None, None, {}), ("E9", None, None), ("E1", None, {"a": "1"})]
    conds = spark.createDataFrame([(str(k), e, c, None, None, None, m) for k, (e, c, m) in enumerate(wanted)], "target_id string, entity_id string, concept string, period string, unit string, version string, metadata map<string,string>")
    counted = conditions.counts(facts, conds)
    holds = lambda f, e, c, m: (e is None or f[2] == e) and (c is None or f[3] == c) and all((f[8] or {}).get(k) == v for k, v in (m or {}).items())
    want = {str(k): n for k, w in enumerate(wanted) if (n := sum(holds(f, *w) for f in rows))}
    assert {r.condition.target_id: r.n for r in counted.collect()} == want
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 4  # facts are counted before each join


def test_what_is_absent_meets_facts_by_all_it_names(spark):
    facts = spark.createDataFrame([(f"r{i:02}", "d", f"E{i % 3}", f"c{i % 2}", "u", f"p{i % 5}", "v", 1.0) for i in range(60)], FACT)
    wanted = [("c0", "E1", "p2"), ("c1", "E2", None), ("c0", None, "p3"), ("c1", None, None), ("c9", None, None)]
    absent = spark.createDataFrame([(f"t{k}", "d", *w) for k, w in enumerate(wanted)], "target_id string, domain string, concept string, entity_id string, period string")
    none = spark.createDataFrame([], "target_id string, entity_id string, concept string, period string, unit string, version string")
    out = distractors.forbidden(facts, facts.limit(0).withColumn("target_id", F.lit("x")), none, absent)
    want = {(f"t{k}", f.record_id) for k, (c, e, p) in enumerate(wanted) for f in facts.collect() if f.concept == c and e in (None, f.entity_id) and p in (None, f.period)}
    assert {tuple(r) for r in out.collect()} == want
    assert " OR " not in out._jdf.queryExecution().optimizedPlan().toString()  # no join on part of the names


def test_first_related_facts_are_those_of_all_pairs(spark, monkeypatch):
    rows = [(f"r{i:04}", "d" if i % 9 else "e", None if i % 50 == 7 else f"E{i % 40}", f"c{i % 3}", "u" if i % 4 else "w", f"CY{2000 + i % 2}", "v", None if i % 97 == 0 else float(i * 7919 % 400) - 20, "c1" if i % 11 == 0 else None) for i in range(2400)]
    facts = spark.createDataFrame(rows, FACT + ", family string")
    own = facts.filter("record_id < 'r0012'").withColumn("target_id", F.concat(F.lit("t"), F.expr("substring(record_id, 1, 4)"), F.expr("cast(substring(record_id, 5) as int) % 8")))
    alone = own.filter("record_id = 'r0003'").withColumns({"target_id": F.lit("Q"), **{c: F.lit(None).cast("string") for c in ("record_id", "entity_id", "concept", "period", "unit", "version", "family")}})
    targets = own.unionByName(alone).localCheckpoint()
    barred = facts.sample(0.3, 7).select("record_id").crossJoin(targets.select("target_id").distinct()).localCheckpoint()
    first = lambda df: {tuple(r) for r in selection.top_by(df, ["target_id", "tier"], 5, "h", "record_id").select("target_id", "record_id", "tier", "h").collect()}
    monkeypatch.setattr(distractors, "DRAWN", 0.2)  # so that rows are left short and ask again
    all_ = distractors.related(facts, targets, "s").localCheckpoint()
    assert first(distractors.first_related(facts, targets, 5, "s")) == first(all_)
    without = lambda df: df.join(barred, ["target_id", "record_id"], "left_anti")
    want = without(distractors.strongest(all_))
    drawn = distractors.first_related(facts, targets, 5, "s", without, several=True).localCheckpoint()
    assert first(distractors.strongest(drawn)) == first(want) and drawn.count() < want.count()


def test_related_facts_are_counted_without_pairs(spark):
    values = [0.0, -1.0, 1.0, 1.049, 1.05, 1.051, 0.953, 0.95, 0.949, 1e9, 1.04e9, -1.03, None]
    rows = [(f"r{i:03}", "d" if i % 7 else "e", None if i % 19 == 0 else f"E{i % 23}", f"c{i % 3}", "u" if i % 4 else None, f"p{i % 4}", "v", values[i * 5 % 13]) for i in range(300)]
    facts = spark.createDataFrame(rows, FACT).localCheckpoint()
    targets = facts.filter("record_id < 'r040'").withColumn("target_id", F.col("record_id"))
    want = {(r.target_id, r.tier): r["count"] for r in distractors.related(facts, targets).groupBy("target_id", "tier").count().collect()}
    assert {(r.target_id, r.tier): r.n for r in distractors.related_counts(facts, targets).collect()} == want


def test_large_files_of_lines_are_split(tmp_path, monkeypatch):
    from factloom.sources import payloads

    lines = ["é" * (i * 7 % 23 + 1) + str(i) for i in range(500)]
    for end in ("", "\n"):
        (tmp_path / "a.jsonl").write_text("\n".join(lines) + end)
        for size in (1 << 20, 1000, 64, 1):
            monkeypatch.setattr(payloads, "BUNDLE", size)
            reader = payloads.PayloadReader({"path": str(tmp_path), "lines": "true"})
            parts = reader.partitions()
            got = sorted((p, t) for part in parts for batch in reader.read(part) for p, t in zip(*[c.to_pylist() for c in batch.columns]))
            assert [t for _, t in got] == lines and len({p for p, _ in got}) == 500 and (len(parts) > 1) == (size < 1 << 20)


def test_near_values_are_those_of_all_pairs(spark):
    inf = float("inf")
    values = [0.0, -0.0, 1.0, 1.05, 0.95, 0.9499, 1.0501, -1.0, -1.04, 2.0, 1e-300, 1.04e-300, 1e300, 9.6e299, inf, -inf, float("nan"), None, *[1.003**i for i in range(100)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value double").repartition(3)
    got = conditions.near(df.select(F.col("id").alias("a"), F.col("value").alias("v")), df.select(F.col("id").alias("b"), F.col("value").alias("w")), "v", "w")
    finite = [(i, v) for i, v in enumerate(values) if v is not None and abs(v) < inf]
    want = {(i, j) for i, v in finite for j, w in finite if (v == 0 if w == 0 else abs(v - w) / abs(w) <= 0.05)}
    rows = [tuple(r)[:4] for r in got.select("a", "b").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_candidates_draw_what_a_list_takes(spark, monkeypatch):
    rows = [(f"r{i:04}", "d" if i % 9 else "e", f"E{i % 40}", f"c{i % 3}", "u", f"CY{2000 + i % 2}", "v", float(i * 7919 % 400) - 20) for i in range(1200)] + [(f"s{i}", "f", f"E{i}", "c0", "u", f"CY{i % 2}", "v", 5.0) for i in range(30)]
    facts = spark.createDataFrame(rows, FACT).localCheckpoint()
    targets = facts.filter("record_id < 'r0012' or record_id in ('s3', 's4')").withColumn("target_id", F.concat(F.lit("t"), "record_id")).localCheckpoint()
    foils = targets.crossJoin(facts.select(F.col("record_id").alias("other"), F.col("domain").alias("d")).filter("other like '%7'")).filter("d = domain and other <> record_id").select("target_id", F.col("other").alias("record_id")).localCheckpoint()
    barred = facts.sample(0.2, 3).select("record_id").crossJoin(targets.select("target_id")).localCheckpoint()
    asked, drawn = [], distractors._drawn
    monkeypatch.setattr(distractors, "_drawn", lambda *a: asked.append(a[5]) or drawn(*a))
    f, t = facts.alias("f"), distractors.completed(targets).alias("t")
    for some in (None, foils):
        all_ = distractors.completed(facts).alias("f").join(t, (F.col("f.domain") == F.col("t.domain")) & (F.col("f.record_id") != F.col("t.record_id"))).select("t.target_id", "f.record_id", distractors.tier("f", "t").alias("tier"), distractors.core.rank_key("s", F.col("f.record_id")).bitwiseXOR(distractors.core.rank_key("s", F.col("t.target_id"))).alias("h"))
        all_ = all_.join(barred, ["target_id", "record_id"], "left_anti")
        all_ = all_.withColumn("later", F.lit(True)) if some is None else all_.join(some.withColumn("foil", F.lit(1)), ["target_id", "record_id"], "left").withColumn("later", F.col("foil").isNull()).drop("foil")
        all_ = all_.withColumn("tier_rank", distractors._rank()).withColumn("weight", distractors._weight())
        chosen = selection.interleave(all_, ["target_id"], "tier_rank", "weight", "later", "h", "record_id")
        for limit in (20, 90):
            want = {tuple(r) for r in chosen.filter(F.col("position") <= limit).filter("tier <> 'OTHER_SAME_DOMAIN'").select("target_id", "record_id", "tier", "position").collect()}
            got = [tuple(r) for r in distractors.candidates(facts, targets, limit, "s", barred, some).collect()]
            assert {r for r in got if r[2] != "OTHER_SAME_DOMAIN"} == want
            n = {r.target_id: r["count"] for r in chosen.filter(F.col("position") <= limit).groupBy("target_id").count().collect()}
            assert {k: sum(r[0] == k for r in got) for k in n} == n
    assert asked[:2] == [9, 6]  # three cycles of a list of 20


def test_files_are_found_sorted_without_lists_of_their_rows(spark, tmp_path):
    from factloom.sources import tables

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for change, want in ((None, True), ("k005", False), ("k006", False), ("k007", False), ("k039", False)):
            ids = [f"k{i:03}" for i in range(40)]
            df = spark.createDataFrame([(d, "k000" if d == "b" and k == change else k) for d in "ab" for k in ids], "d string, k string").coalesce(1)
            df.write.mode("overwrite").partitionBy("d").parquet(str(tmp_path / "t"))
            out = tables.sorted_files(spark, str(tmp_path / "t"), "k", "d")
            assert {tuple(r) for r in out.collect()} == {("a", 40, "k000", "k039", True), ("b", 40, "k000", "k038" if change == "k039" else "k039", want)}
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_answers_are_normalised_once(spark):
    from factloom.functions import core

    df = spark.createDataFrame([("$1,200 %", "NUMERIC")], "v string, kind string").select(core.normalize_answer(F.col("v"), F.col("kind")).alias("n")).select("n.kind", "n.num", "n.txt")
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace") <= 9  # three for each of kind, num and txt
    records = spark.createDataFrame([([("R1", "7"), ("R2", "1,200")], "1200")], "records array<struct<display_id:string,value:string>>, v string")
    kind, tol = F.lit("NUMERIC"), F.lit(0.0)
    found = records.select(grading.context_match(F.col("records"), core.normalize_answer(F.col("v"), kind), kind, tol).alias("m"), grading.context_match(F.col("records"), core.normalize_answer(F.lit("8"), kind), kind, tol).alias("none")).first()
    assert found.m.display_id == "R2" and found.none is None


def test_first_keys_are_those_of_all_rows(spark, monkeypatch):
    """Where few keys have nearly all rows, where there are fewer keys or rows than asked for, and else."""
    rows = [(f"k{i % 7 if i % 3 else i}", f"{i * 7919 % 1000:04}", f"q{i % 5}") for i in range(900)]
    many = [("big", f"{i:04}", "q") for i in range(500)] + [(f"k{i}", f"{600 + i}", "q") for i in range(5)]
    read = {}
    for name, data, n in (("mixed", rows, 20), ("one key", many, 4), ("few keys", many, 50), ("few rows", rows[:10], 40), ("none", [], 3)):
        df = spark.createDataFrame(data, "_key string, _h string, question string").localCheckpoint()
        first = {}
        for k, h, q in sorted(data, key=lambda r: (r[1], r[2], r[0])):
            first.setdefault(k, (k, h, q))
        out = selection.first_keys(df, "_key", n, "_h", "question")
        assert [tuple(r)[1:] for r in out.orderBy("_h", "question").collect()] == [x[1:] for x in list(first.values())[:n]], name
        read[name] = out.inputFiles()
    # No more than the rows that come first are sorted by key, except where they don't have enough keys.
    assert spark.read.parquet(*read["mixed"]).count() == 20 * selection.AHEAD and not read["one key"]


def test_records_of_counted_products_and_of_filings_are_grouped_once(spark, tmp_path, monkeypatch):
    """Nothing is spread out for distinct counts, and candidates of templates are not shuffled by their keys."""
    from factloom.plans import templates
    from factloom.plans.template_facts import facts

    plans = []
    first_keys = selection.first_keys
    monkeypatch.setattr(selection, "first_keys", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or first_keys(df, *a))
    f = facts(spark, "/root/testdata/sf0.001")
    for name in ("FDA_PRODUCT_COUNT", "SEC_FILING_VERSION_SELECTION", "SEC_YOY_GROWTH_PERCENT"):
        templates.TEMPLATES[name][2](f, 5, "s").collect()
    assert len(plans) == 3 and not any("Expand" in p or "Window" in p for p in plans)


def test_violations_are_counted_and_shown_without_a_task_for_each_check(spark, monkeypatch):
    from factloom.plans import validate

    n = {"one": 1000, "none": 0, "few": 3}
    bad = lambda k: lambda t: t["x"].filter(F.col("id") < n[k]).select(F.format_string("k%05d", 2000 - F.col("id")).alias("key"), F.lit("p").alias("problem"))
    monkeypatch.setattr(validate, "CHECKS", {k: (k, "error", bad(k)) for k in n})
    out = validate.report({"x": spark.range(1500).repartition(4)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {r.check_id: r for r in out.collect()}
    want = {k: [f"k{i:05}" for i in range(2001 - v, 2001)][: validate.CAP] for k, v in n.items()}
    assert {k: (r.n_failed, r.truncated, [f.key for f in r.failures]) for k, r in got.items()} == {k: (n[k], n[k] > validate.CAP, want[k]) for k in n}
    assert "WindowGroupLimit" in plan  # tasks send CAP rows of a check at most


def test_facts_are_sorted_once_for_equivalents(spark):
    rows = [(f"r{i:02}", "d", f"E{i % 4}", "c", "u", "CY2020", "v", float(i % 8 // 4)) for i in range(40)]
    out = distractors.equivalents(spark.createDataFrame(rows, FACT))
    assert sorted(r.record_ids for r in out.collect()) == sorted([f"r{i:02}" for i in range(40) if i % 8 == k] for k in range(8))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_words_alone_ask_for_no_context_trees(spark, monkeypatch):
    from factloom.llm import context_tree

    texts = ["The cat sat", None, "", "a cat, a dog " * 9, "rare Words here", "the end"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    whole = context_tree.score(docs, hot_words=2)
    columns = whole.columns[:6]
    want = sorted(map(tuple, whole.select(*columns).collect()))
    monkeypatch.setattr(context_tree, "fit_grams", None)
    got = context_tree.score(docs, hot_words=2, words_only=True)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want
