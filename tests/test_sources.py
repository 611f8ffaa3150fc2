import json

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.plans import audit, templates, validate
from factloom.sources import adapters, payloads, tables, versions


def raw(spark, *payloads, url="u"):
    rows = [(f"p{i:03}", url, "t", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "path string, request_url string, retrieved_at string, payload string")


def company(i, concepts=("Revenues", "OperatingIncomeLoss")):
    years = lambda c: [{"val": 100 + i * 10 + y * 7 + len(c), "start": f"{2018 + y}-01-01", "end": f"{2018 + y}-12-31", "accn": f"a{i}{y}", "form": "10-K", "fy": 2018 + y, "fp": "FY", "filed": f"{2019 + y}-02-01", "frame": f"CY{2018 + y}"} for y in range(3)]
    more = [{"val": 30 + i, "start": "2018-01-01", "end": "2018-03-31", "accn": f"q{i}", "form": "10-Q", "filed": "2018-05-01", "frame": "CY2018Q1"}, {"val": 99 + i, "start": "2018-01-01", "end": "2018-12-31", "accn": f"z{i}", "form": "10-K/A", "filed": "2020-05-01"}, {"val": None, "end": "2018-01-01"}, {"val": 5}]
    return {"cik": i, "entityName": f"Acme{i}", "facts": {"us-gaap": {c: {"label": c, "units": {"USD": years(c) + more}} for c in concepts}}}


CATALOG = "id string, title string, units string, frequency string, seasonal_adjustment string, family string, geo_code string, geo_name string"


@pytest.fixture(scope="module")
def facts(spark):
    """All domains, small."""
    sec = adapters.sec(raw(spark, *[company(i, ("Revenues", "OperatingIncomeLoss", "Extra") if i == 0 else ("Revenues", "OperatingIncomeLoss")) for i in range(4)]))
    products = lambda a: [{"product_number": f"00{k}", "brand_name": f"B{a}{k}", "dosage_form": "TABLET", "route": "ORAL" if k else "", "marketing_status": "Rx", "active_ingredients": [{"name": "X", "strength": f"{5 * (k + 1 + a)}MG"}]} for k in range(3)]
    subs = [{"submission_type": "ORIG", "submission_number": "1", "submission_status_date": "20200131"}, *[{"submission_type": "SUPPL", "submission_number": str(k), "submission_status_date": f"2021013{k}"} for k in range(2)], {"submission_type": "SUPPL", "submission_number": "9"}]
    fda = adapters.fda(raw(spark, {"results": [{"application_number": f"NDA00{a}", "sponsor_name": "S", "products": products(a), "submissions": subs} for a in range(2)]}, {"results": "none"}))

    def study(k):
        return {"protocolSection": {"identificationModule": {"nctId": f"NCT{k}", "briefTitle": f"T{k}"}, "statusModule": {"overallStatus": "DONE", "startDateStruct": {"date": "2020-01-01"}, "primaryCompletionDateStruct": {"date": f"2021-0{k + 1}-01"}, "completionDateStruct": {"date": "2022-01-01"}, "studyFirstPostDateStruct": {"date": "2019-12-01"}}, "designModule": {"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 50 + k, "type": "ACTUAL"}}, "eligibilityModule": {"healthyVolunteers": False}, "armsInterventionsModule": {"armGroups": [{"label": "A", "type": "EXPERIMENTAL"}, {"label": "B", "type": "PLACEBO"}, {"label": "C"}], "interventions": [{"name": "Dr", "type": "DRUG"}]}, "outcomesModule": {"primaryOutcomes": [{"measure": "m", "timeFrame": "1y"}]}, "conditionsModule": {"conditions": ["c1", "c2"]}}}

    trials = adapters.clinical_trials(raw(spark, {"studies": [study(k) for k in range(3)] + [{"protocolSection": {}}]}))
    series = [("UNRATE", "Rate", "Percent", "Monthly", "Seasonally Adjusted", "u", "US", "United States"), ("UNRATENSA", "Rate", "Percent", "Monthly", "Not Seasonally Adjusted", "u", "US", "United States"), ("GDP", "Gross", "Bn", "Quarterly", "SA", "g", "US", "United States")]
    catalog = spark.createDataFrame(series, CATALOG)
    current = "observation_date,UNRATE,UNRATENSA,ZZZ\n2020-01-01,3.5,4.0,1\n2020-02-01,3.6,3.9,1\n2020-03-01,,.,1\nbadrow\n2020-04-01,not-a-number,5,1\n1980-01-01,1,1,1"
    vintage = "observation_date,GDP_20210429,GDP_20220429\n2019-01-01,7,7.5\n2017-01-01,8,8"
    fred = adapters.fred(raw(spark, current, url="x/fredgraph.csv").unionByName(raw(spark, vintage, url="x/alfredgraph.csv")), catalog)
    obs = lambda c, y, ind, v: {"indicator": {"id": ind, "value": f"{ind} (current US$)"}, "country": {"id": c[:2], "value": c}, "countryiso3code": c, "date": str(y), "value": v}
    wb = adapters.world_bank(raw(spark, [{"page": 1}, [obs(c, y, ind, (y - 2000) * (3 if ind.endswith("CD") else 2) + len(ind)) for c in ("USA", "FRA") for y in range(2006, 2012) for ind in ("NY.GDP.MKTP.CD", "SP.POP.TOTL", "NY.GDP.MKTP.KD")] + [obs("USA", 2012, "SP.POP.TOTL", None), {"indicator": None}, 7]], "not json"))
    return sec.unionByName(fda).unionByName(trials).unionByName(fred).unionByName(wb).persist()


def test_record_ids_are_unique_and_filled(facts):
    assert facts.count() == facts.select("record_id").distinct().count() and facts.filter("record_id is null or record_id rlike '[ ]' or concept is null").count() == 0
    n = {r.domain: r["count"] for r in facts.groupBy("domain").count().collect()}
    assert n["SEC"] == 9 * 5 and n["WORLD_BANK"] == 37 and n["FRED"] == 4 + 2 + 1 + 2


def test_sec(facts):
    r = facts.filter("record_id like 'SEC_0000000001_Revenues_USD_CY2018_a10%'").first()
    assert (r.value_numeric, r.version, r.period, r.metadata["period_kind"], r.metadata["is_amendment"]) == (118.0, "10-K|a10", "CY2018", "annual", "false")
    assert facts.filter("domain = 'SEC' and metadata.is_amendment = 'true'").count() == 9 and facts.filter("period = '2018-01-01..2018-12-31'").count() == 9


def test_fred(facts):
    kinds = {(r.concept, r.period, r.version): (r.record_type, r.value_numeric) for r in facts.filter("domain = 'FRED'").collect()}
    assert kinds["UNRATE", "2020-03-01", "latest"] == ("observation_missing", None) and kinds["GDP", "2019-01-01", "vintage:2021-04-29"] == ("fred_vintage_observation", 7.0)
    assert ("UNRATE", "2020-04-01", "latest") not in kinds and ("UNRATE", "1980-01-01", "latest") not in kinds and ("GDP", "2017-01-01", "vintage:2021-04-29") not in kinds


def test_corrupt_payload_file_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text("{not json at all")
    with pytest.raises(Exception):
        adapters.raw_payloads(spark, str(tmp_path)).collect()
    (tmp_path / "a.json").write_text(json.dumps({"request_url": "u", "retrieved_at": "t", "payload": {"results": []}}))
    assert json.loads(adapters.raw_payloads(spark, str(tmp_path)).first().payload) == {"results": []}


def write_envelopes(folder, *contents):
    folder.mkdir(parents=True)
    for k, payload in enumerate(contents):
        (folder / f"p{k}.json").write_text(json.dumps({"request_url": f"u{k}", "retrieved_at": "t", "payload": payload}, indent=1))


def test_payload_source_reads_whole_files_and_lines(spark, tmp_path, monkeypatch):
    write_envelopes(tmp_path / "fda" / "deep", {"results": []}, "a,b\n1,2", [1, {"x": None}])
    (tmp_path / "fda" / "_SUCCESS").write_text("")
    got = {r.request_url: r.payload for r in payloads.raw(spark, str(tmp_path / "fda")).collect()}
    assert json.loads(got["u0"]) == {"results": []} and got["u1"] == "a,b\n1,2" and json.loads(got["u2"]) == [1, {"x": None}]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "part-0.txt").write_text("\n".join(json.dumps({"request_url": f"u{k}", "retrieved_at": "t", "payload": "é" * 90_000}) for k in range(30)) + "\n\n")
    rows = payloads.raw(spark, f"file:{lines}", lines=True).collect()
    assert sorted(r.request_url for r in rows) == sorted(f"u{k}" for k in range(30)) and {r.payload for r in rows} == {"é" * 90_000} and len({r.path for r in rows}) == 30
    reader = payloads.PayloadReader({"path": str(tmp_path / "fda")})
    assert [len(b.files) for b in reader.partitions()] == [3]
    monkeypatch.setattr(payloads, "BUNDLE", 1)
    assert [len(b.files) for b in reader.partitions()] == [1, 1, 1]
    (tmp_path / "none").mkdir()
    assert payloads.raw(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no payloads"):
        payloads.raw(spark, str(tmp_path / "missing")).collect()


def test_payload_source_names_a_corrupt_file(spark, tmp_path):
    write_envelopes(tmp_path / "fda", {"results": []})
    (tmp_path / "fda" / "bad.json").write_text("{not json at all")
    with pytest.raises(Exception, match="corrupt raw payload .*bad.json"):
        payloads.load(spark, str(tmp_path), "FDA").collect()


def test_registry_and_gates(spark, tmp_path):
    assert payloads.available() == ["CLINICAL_TRIALS", "FDA", "FRED", "SEC", "WORLD_BANK"]
    write_envelopes(tmp_path / "sec", company(1))
    with pytest.raises(PermissionError, match="contact"):
        payloads.load(spark, str(tmp_path), "SEC")
    with pytest.raises(PermissionError, match="catalog"):
        payloads.load(spark, str(tmp_path), "FRED")
    with pytest.raises(KeyError, match="no adapter of domain X"):
        payloads.load(spark, str(tmp_path), "X")
    assert payloads.load(spark, str(tmp_path), "SEC", contact="a@b.c", concepts=("Revenues",)).count() == 5
    payloads.register("OWN", lambda raw, **_: raw.select("payload"))
    try:
        write_envelopes(tmp_path / "own", "x")
        assert payloads.load(spark, str(tmp_path), "OWN").first().payload == "x"
    finally:
        del payloads.REGISTRY["OWN"]


def test_versions_are_replaced_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    root, table = f"file://{tmp_path}/t", lambda n: spark.range(n)
    assert versions.current(spark, root) is None
    one = versions.commit(table(3), root)
    pinned = versions.read_version(spark, root)
    with pytest.raises(FileExistsError):  # the overwrite guard
        versions.commit(table(9), root)
    two = versions.commit(table(5), root, replaces=one)
    assert pinned.count() == 3 and versions.read_version(spark, root).count() == 5 and versions.read_version(spark, root, one).count() == 3
    late = versions.stage(table(7), root)  # a writer that was overtaken
    with pytest.raises(FileExistsError):
        versions.publish(spark, root, late, replaces=one)

    def dies(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):  # a writer killed between the two steps
        m.setattr(versions, "publish", dies)
        versions.commit(table(8), root, replaces=two)
    assert versions.current(spark, root) == two and versions.read_version(spark, root).count() == 5
    half = versions.stage(table(4), root)
    (tmp_path / "t" / half / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        versions.publish(spark, root, half, replaces=two)
    assert versions.discard(spark, root) == 4 and versions.read_version(spark, root).count() == 5


def test_rerendering_counts_only_what_changed(spark):
    schema = "k int, context string, question string, question_type string"
    rows = [(1, "a b", "q", "OLD"), (2, "c", "q", "X"), (3, None, None, "OLD")]
    none = spark.createDataFrame([], "k int, input_sha256 string, prompt_sha256 string, prompt_tokens long")
    first = audit.rerendered(none, spark.createDataFrame(rows, schema), "k", {}, 200, 20)
    # A planted hash and count show that a kept row isn't rendered again.
    frozen = first.withColumn("prompt_sha256", F.lit("planted")).withColumn("prompt_tokens", F.lit(7).cast("long"))
    again = {r.k: r for r in audit.rerendered(frozen, spark.createDataFrame([(1, "a b", "q", "OLD"), (2, "c d", "q", "X"), (3, None, None, "OLD"), (4, "e", "q", "OLD")], schema), "k", {"OLD": "NEW"}, 100, 20).collect()}
    assert {k: r.status for k, r in again.items()} == {1: "kept", 2: "changed", 3: "kept", 4: "new"}
    assert again[1].prompt_sha256 == "planted" and again[1].prompt_margin == 73 and again[2].prompt_sha256 != "planted"
    assert [again[k].question_type for k in (1, 2, 3, 4)] == ["NEW", "X", "NEW", "NEW"]
    with pytest.raises(Exception, match="prompt budget overflow: 9 has"):
        audit.rerendered(none, spark.createDataFrame([(9, "x y z " * 100, "q", "X")], schema), "k", {}, 100, 20).collect()


def test_quota_sample_equals_ranks_over_whole_strata(spark):
    import hashlib

    rows = [(i, "abc"[i % 3], "x" if i < 190 else "y") for i in range(200)]
    got = audit.quota_sample(spark.createDataFrame(rows, "k int, a string, b string"), "k", ["a", "b"], 15, "s").collect()
    h = {r[0]: hashlib.md5(f"s|{r[0]}".encode()).hexdigest() for r in rows}
    best = {r[0]: min(sum(h[o[0]] <= h[r[0]] for o in rows if o[c] == r[c]) for c in (1, 2)) for r in rows}
    assert {r.k for r in got} == set(sorted(best, key=lambda k: (best[k], h[k]))[:15]) and got[0].asDict().keys() == {"k", "a", "b"}


def test_configuration_is_yaml_with_names_filled_in():
    text = "a: ${X:-7}\nb: [1, '${Y}-z']\nc:\n  d: ${Z:-no}\n  e: plain\n  f: ${EMPTY}\n"
    assert tables.run_config(text, {"Y": "y", "Z": ""}) == {"a": 7, "b": [1, "y-z"], "c": {"d": False, "e": "plain", "f": ""}}
    assert tables.run_config("a: ${X:-7}", {"X": "3.5"}) == {"a": 3.5} and tables.run_config("", {}) == {} and tables.run_config('{"k": "${X:-v}"}', {}) == {"k": "v"}


def test_command_line_runs_stages_from_payloads_to_contexts(spark, tmp_path, capsys, monkeypatch):
    for i in range(4):
        write_envelopes(tmp_path / "raw" / "sec" / str(i), company(i))
    facts = f"file://{tmp_path}/facts"
    config = tmp_path / "c.yaml"
    config.write_text(f"root: {tmp_path}/raw\ndomain: ${{DOMAIN:-SEC}}\ncontact: a@b.c\nout: {facts}\n")
    assert cli.main(["normalize", "--config", str(config)], spark) == 0
    first = json.loads(capsys.readouterr().out)["version"]
    assert versions.current(spark, facts) == first and versions.read_version(spark, facts).filter("domain = 'SEC'").count() == 4 * 2 * 5
    with pytest.raises(SystemExit, match="has a version"):
        cli.main(["normalize", "--config", str(config)], spark)
    assert cli.main(["normalize", "--config", str(config), "--replace"], spark) == 0 and versions.current(spark, facts) != first
    assert cli.main(["generate-questions", "--facts", facts, "--domain", "SEC", "--total", "6", "--out", f"{tmp_path}/q"], spark) == 0
    assert versions.read_version(spark, f"{tmp_path}/q").count() == 6
    versions.read_version(spark, facts).withColumn("value", F.col("value_numeric")).write.parquet(f"{tmp_path}/f")
    spark.read.parquet(f"{tmp_path}/f").limit(2).withColumn("target_id", F.col("record_id")).write.parquet(f"{tmp_path}/t")
    assert cli.main(["build-contexts", "--facts", f"{tmp_path}/f", "--targets", f"{tmp_path}/t", "--lengths", "200", "400", "--out", f"{tmp_path}/x"], spark) == 0
    assert {r.nominal for r in versions.read_version(spark, f"{tmp_path}/x").select("nominal").distinct().collect()} == {200, 400}
    assert cli.main(["stats", "--facts", facts], spark) == 0 and "SEC" in capsys.readouterr().out
    assert cli.main(["query", "--name", "pricing_summary", "--data", "/root/testdata/sf0.001"], spark) == 0
    for bad in (["normalize", "--domain", "SEC"], ["nothing"], ["query", "--name", "nothing", "--data", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
    config.write_text("surprise: 1\n")
    with pytest.raises(SystemExit):
        cli.main(["stats", "--facts", facts, "--config", str(config)], spark)


def test_command_line_validates(spark, tmp_path):
    for name, df in as_tables(spark, *data()).items():
        df.write.parquet(f"{tmp_path}/{name}")
    args = ["validate", "--tables", str(tmp_path), "--checks", "A", "U"]
    assert cli.main(args, spark) in (0, 1) and cli.main([*args, "--strict"], spark) == 1  # not all question types are there


@pytest.mark.parametrize("name", list(templates.TEMPLATES))
def test_every_template_yields_families(facts, name):
    rows = templates.TEMPLATES[name][2](facts, 3, "s").collect()
    assert 1 <= len(rows) <= 3 and len({r.question for r in rows}) == len(rows)
    for r in rows:
        assert r.answerable == bool(r.gold_ids) == (r.gold_answer is not None) and (r.answerable or r.question_type == "UNANSWERABLE")
        assert r.question_type != "RETRIEVAL_CALCULATION" or r.operation


def test_seeds_and_quota(facts):
    draw = lambda seed: [(r.family_id, r.question) for r in templates.generate(facts, "WORLD_BANK", 8, seed).orderBy("family_id").collect()]
    a = draw("one")
    assert a == draw("one") and a != draw("two") and len(a) == 8 and a[0][0] == "WORLD_BANK_0001"
    kinds = {r.question_type for r in templates.generate(facts, "SEC", 10).collect()}
    assert kinds == set(validate.QUESTION_TYPES)


FAMILY = "family_id string, domain string, question string, question_type string, template string, answerable boolean, gold_answer string, gold_num double, answer_type string, unit string, tolerance double, gold_ids array<string>, provenance_ids array<string>, metadata map<string,string>, operation string, operand_ids map<string,string>, operands map<string,double>, stated_result double, conditions array<struct<entity_id:string,concept:string,period:string,unit:string,version:string>>, aliases array<string>, missing_entity string, missing_period string, version_required boolean"
INSTANCE = "family_id string, nominal long, label string, question string, gold_answer string, gold_ids array<string>, record_ids array<string>, display_ids array<string>, context string, gold_block string, tokens long, relative_position double, parent_nominal long, prompt_tokens long, prompt_budget long, gold_display_ids array<string>"
PLACED = "family_id string, nominal long, record_id string, side string, position int, tier string, flags map<string,boolean>"


def data():
    """Two families, one of them without an answer, in contexts of 100 and 200 tokens."""
    facts = [(f"r{i}", "d", f"E{i}", "c", "u", "CY2020", "v", float(10 + i)) for i in range(8)]
    key = lambda e: [(e, "c", "CY2020", "u", "v")]
    families = [
        ("F1", "d", "What is c of E0 and E1 together?", "RETRIEVAL_CALCULATION", "T", True, "21", 21.0, "NUMERIC", "u", 0.5, ["r0", "r1"], ["r0", "r1"], {"k": "v"}, "sum", {"a": "r0", "b": "r1"}, {"a": 10.0, "b": 11.0}, 21.0, key("E0") + key("E1"), None, None, None, False),
        ("F2", "d", "What is z of E9?", "UNANSWERABLE", "T", False, None, None, "INSUFFICIENT_EVIDENCE", None, None, [], [], {"k": "v"}, None, None, None, None, [("E9", "z", None, None, None)], ["z"], "E9", None, False),
    ]
    show = lambda r: f"RAAAAAAA{r[1:]}"
    block = lambda r: f'<RECORD id="{show(r)}">\nvalue: {r}\n</RECORD>'
    instances, placed = [], []
    for f, gold in (("F1", ["r0", "r1"]), ("F2", [])):
        for n, before, after in ((100, ["r2"], ["r3"]), (200, ["r4", "r2"], ["r3", "r5"])):
            ids = before + gold + after
            question = families[0][2] if f == "F1" else families[1][2]
            instances.append((f, n, f"{n}T", question, "21" if gold else None, gold, ids, [show(r) for r in ids], "\n".join(map(block, ids)), "\n".join(map(block, gold)), n - 5, 0.5, None if n == 100 else 100, None, None, [show(r) for r in gold]))
            placed += [(f, n, r, "gold" if r in gold else "before" if r in before else "after", k, None if r in gold else "WRONG_ENTITY", None if r in gold else {"different_entity": True}) for k, r in enumerate(ids)]
    return facts, families, instances, placed


FACTS = "record_id string, domain string, entity_id string, concept string, unit string, period string, version string, value double"


def as_tables(spark, facts, families, instances, placed):
    return {"facts": spark.createDataFrame(facts, FACTS), "families": spark.createDataFrame(families, FAMILY), "instances": spark.createDataFrame(instances, INSTANCE), "placements": spark.createDataFrame(placed, PLACED), "unavailable": spark.createDataFrame([], "family_id string, nominal long, status string")}


def test_clean_data_passes_every_check(spark):
    t = as_tables(spark, *data())
    rows = {r.check_id: r for r in validate.report(t).collect()}
    assert len(rows) == 30 and {c for c, r in rows.items() if r.n_failed} == {"U"}  # three question types are not there
    assert validate.exit_code(validate.report(t, ["U", "A"])) == 0 and validate.exit_code(validate.report(t, ["U"]), strict=True) == 1


def at(schema, name):
    return [c.strip().split(" ")[0] for c in schema.replace("map<string,string>", "m").replace("map<string,double>", "m").replace("map<string,boolean>", "m").replace("struct<entity_id:string,concept:string,period:string,unit:string,version:string>", "s").split(",")].index(name)


def changed(rows, schema, k, **values):
    row = list(rows[k])
    for name, v in values.items():
        row[at(schema, name)] = v
    return rows[:k] + [tuple(row)] + rows[k + 1 :]


F_, I_, P_ = "families", "instances", "placed"
MUTATIONS = [
    ("A", F_, 0, dict(family_id="F2")), ("B", F_, 1, dict(question=" What is c of E0 and E1 together? ")), ("C", F_, 0, dict(provenance_ids=["r0"])), ("D", F_, 0, dict(gold_num=1020.0)), ("D", F_, 0, dict(operands={"a": 10.0, "b": 12.0})),
    ("E", I_, 0, dict(record_ids=["r2", "r0", "r3"])), ("F", I_, 2, dict(gold_ids=["r0"])), ("G", I_, 1, dict(question="other?")), ("H", I_, 1, dict(gold_answer="22")), ("I", I_, 1, dict(gold_block="x")), ("J", I_, 1, dict(record_ids=["r4", "r0", "r1", "r3", "r5"])), ("J", I_, 1, dict(record_ids=["r3", "r4", "r2", "r0", "r1", "r5"])),
    ("J", I_, 1, dict(parent_nominal=50)), ("K", I_, 0, dict(tokens=101)), ("K", I_, 0, dict(tokens=50)), ("L", I_, 0, dict(relative_position=0.6)), ("M", I_, 0, dict(context="<RECORD id=\"X\">")), ("N", "facts", 1, dict(unit="w")), ("O", F_, 0, dict(gold_answer=None)), ("O", F_, 0, dict(answer_type="ODD")),
    ("P", P_, 0, dict(tier=None)), ("Q", F_, 0, dict(gold_num=float("inf"))), ("R", I_, 0, dict(gold_block="not there")), ("S", F_, 1, dict(aliases=["c"], missing_entity="E2")), ("T", F_, 0, dict(operand_ids={"a": "r0", "b": "r7"})), ("V", F_, 0, dict(conditions=[("E2", "c", None, None, None)])),
    ("W", I_, 0, dict(display_ids=["bad", "RAAAAAAA0", "RAAAAAAA1", "RAAAAAAA3"])), ("Y", P_, 0, dict(flags={"different_entity": False})), ("Z", F_, 0, dict(question="What is it, rather than a guess?")), ("AA", I_, 0, dict(prompt_tokens=7, prompt_budget=5)), ("AC", I_, 0, dict(gold_display_ids=["RAAAAAAA1", "RAAAAAAA0"])), ("AD", F_, 0, dict(question_type="TEMPORAL_VERSION")),
]


@pytest.mark.parametrize("check,table,row,values", MUTATIONS)
def test_mutations_are_caught(spark, check, table, row, values):
    parts = dict(zip(("facts", "families", "instances", "placed"), data()))
    schema = {"facts": FACTS, "families": FAMILY, "instances": INSTANCE, "placed": PLACED}[table]
    parts[table] = changed(parts[table], schema, row, **values)
    assert validate.violations(as_tables(spark, *parts.values()), [check]).count() > 0


def test_missing_instance_and_equivalent_distractor_are_caught(spark):
    facts, families, instances, placed = data()
    assert validate.violations(as_tables(spark, facts, families, instances[:-1], placed), ["AB"]).count() == 1
    same = facts[:2] + [("r2", "d", "E0", "c", "u", "2020-01-01..2020-12-31", "v", 10.0)] + facts[3:]
    assert validate.violations(as_tables(spark, same, families, instances, placed), ["X"]).count() > 0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "t1"), (2, None, "t2")], "k int, v string, retrieved_at string")
    assert tables.write_jsonl(df, f"{tmp_path}/j") == 2 and tables.read_jsonl(spark, f"{tmp_path}/j", df.schema).count() == 2 and tables.read_jsonl(spark, f"{tmp_path}/none", df.schema).count() == 0
    (tmp_path / "bad.json").write_text('{"k": 1}\n\n{"k": oops}\n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, f"{tmp_path}/bad.json", "k int").collect()
    assert tables.malformed_lines(spark, f"{tmp_path}/bad.json", "k int").count() == 1
    h = tables.content_hash(df)
    assert h == tables.content_hash(df.withColumn("retrieved_at", F.lit("later")).orderBy(F.desc("k")).repartition(3)) != tables.content_hash(df.withColumn("v", F.lit("b")))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.txt").write_bytes(b"a\r\nb")
    (tmp_path / "f/y.txt").write_bytes(b"a\nb")
    assert len({r.sha256 for r in tables.file_hashes(spark, f"{tmp_path}/f", crlf=True).collect()}) == 1 and len({r.sha256 for r in tables.file_hashes(spark, f"{tmp_path}/f").collect()}) == 2
    assert tables.run_config('{"a": "${A_NAME:-x}", "b": "${B_NAME}"}', {"B_NAME": "y"}) == {"a": "x", "b": "y"}
