import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import calc, conditions, distractors, selection, stats
from factloom.plans import grading, packing


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("operation,operands,want", [
    ("ratio_percent", {"numerator": 1.0, "denominator": 4.0}, 25.0), ("ratio_percent", {"numerator": 1.0, "denominator": 0.0}, None),
    ("growth_percent", {"current": 3.0, "previous": 2.0}, 50.0), ("growth_percent", {"current": 3.0, "previous": 0.0}, None),
    ("difference", {"a": 3.0, "b": 5.0}, -2.0), ("ratio", {"numerator": 3.0, "denominator": 2.0}, 1.5), ("sum", {"a": 1.0, "b": 2.5}, 3.5),
    ("count", {"a": 1.0, "b": 2.5}, 2.0), ("days_between", {"start": 10.0, "end": 40.0}, 30.0), ("sum", {"a": float("nan")}, None),
])
def test_calculations(spark, operation, operands, want):
    df = spark.createDataFrame([(operation, operands)], "o string, m map<string,double>")
    assert df.select(calc.result(F.col("o"), F.col("m")).alias("x")).first().x == want


def test_numbers_dates_and_labels(spark):
    assert one(spark, core.format_value(F.col("v")), v=1234567.0) == "1,234,567" and one(spark, core.format_value(F.col("v")), v=0.125) == "0.125"
    assert one(spark, core.tolerance(F.col("v"), F.lit(2)), v=1.0) == 0.005 and one(spark, core.tolerance(F.col("v"), F.lit(None).cast("int")), v=3.0) == 0.5
    assert one(spark, core.length_label(F.lit(4096))) == "4K" and one(spark, core.epoch_days(F.lit("2020-02"))) == 18293 and one(spark, core.epoch_days(F.lit("x"))) is None
    assert one(spark, core.base_label(F.lit("GDP (current US$)"))) == "gdp" and one(spark, core.unit_of_name(F.lit("GDP (current US$)"))) == "current US$"
    assert one(spark, core.python_round(F.col("v"), 2), v=2.675) == 2.67 and one(spark, core.python_round(F.col("v"), 2), v=0.125) == 0.12
    assert one(spark, core.strength_magnitude(F.lit("5.5mg per ML"))) == 5.5 and one(spark, core.strength_unit(F.lit("5.5mg per ML"))) == "MG"
    span = lambda p: one(spark, core.period_span(F.lit(p)))
    assert span("CY2021Q3") == span("2021-07-01..2021-09-30") and span("CY2021Q4I") is None and span("CY2020") == ("2020-01-01", "2020-12-31")
    assert one(spark, core.failure_class(F.lit("CUDA out of memory"), F.lit(False))) == "CUDA_OOM"


@pytest.mark.parametrize("text,kind,num,txt", [("$1,234.5", "NUMERIC", 1234.5, None), ("12%", "PERCENT", 12.0, None), ("abc", "NUMERIC", None, None), ("03/04/2021", "DATE", None, "2021-03-04"), ("March 4, 2021", "DATE", None, "2021-03-04"), ("  A  b ", "STRING", None, "a b"), ("Insufficient_Evidence", "NUMERIC", None, "insufficient_evidence")])
def test_normalize_answer(spark, text, kind, num, txt):
    got = one(spark, core.normalize_answer(F.lit(text), F.lit(kind)))
    assert (got.num, got.txt) == (num, txt)


BASE = dict(record_id="t", domain="d", entity_id="E1", concept="c1", unit="USD", period="CY2024", version="v1", value=100.0, label="L (a)", family=None, variant=None)


@pytest.mark.parametrize("change,want", [
    ({"version": "v2"}, "WRONG_VERSION"), ({"unit": "shares"}, "WRONG_UNIT"), ({"period": "CY2023"}, "WRONG_PERIOD"), ({"entity_id": "E2"}, "WRONG_ENTITY"),
    ({"concept": "c2", "period": "CY2023", "label": "X"}, "WRONG_FIELD"), ({"entity_id": "E2", "concept": "c2", "period": "CY1", "value": 100.5}, "NEAR_MATCH_VALUE"), ({"entity_id": "E2", "concept": "c2", "period": "CY1", "value": 999999.0}, None),
    ({"concept": "c2", "unit": "EUR"}, "WRONG_UNIT"),
])
def test_tiers(spark, change, want):
    schema = ", ".join(f"{k} {'double' if k == 'value' else 'string'}" for k in BASE)
    fact, target = spark.createDataFrame([tuple((BASE | {"record_id": "f"} | change).values())], schema), spark.createDataFrame([tuple(BASE.values())], schema).withColumn("target_id", F.lit("T"))
    got = [r.tier for r in distractors.related(fact, target).collect()]
    assert got == ([want] if want else [])
    assert fact.alias("f").crossJoin(target.alias("t")).select(distractors.tier("f", "t").alias("x")).first().x == (want or "OTHER_SAME_DOMAIN")


def test_variants_share_a_family(spark):
    schema = ", ".join(f"{k} {'double' if k == 'value' else 'string'}" for k in BASE)
    a, b = BASE | {"family": "u", "variant": "sa"}, BASE | {"record_id": "f", "concept": "c2", "label": "Z", "family": "u", "variant": "nsa"}
    got = distractors.related(spark.createDataFrame([tuple(b.values())], schema), spark.createDataFrame([tuple(a.values())], schema).withColumn("target_id", F.lit("T"))).collect()
    assert [r.tier for r in got] == ["WRONG_SERIES_VARIANT"]


def test_near_loses_nothing(spark):
    values = [0.0, -1.0, 1.0, 1.049, 1.051, 0.953, 0.949, 1e9, 1.04e9, -1.03, 1e-9]
    a, b = spark.createDataFrame([(v,) for v in values], "x double"), spark.createDataFrame([(v,) for v in values], "y double")
    got = {(r.x, r.y) for r in conditions.near(a, b, "x", "y").collect()}
    assert got == {(x, y) for x in values for y in values if (x == 0 if y == 0 else abs(x - y) / abs(y) <= 0.05)}


def test_candidates_leave_out_what_is_barred_and_fill_every_list(spark):
    rows = [(f"r{i:03}", "d", f"E{i % 40}", f"c{i % 3}", "u", f"CY{2000 + i % 20}", "v", None if i == 77 else float(i % 50), "observation_missing" if i % 31 == 0 else "fact") for i in range(400)]
    facts = spark.createDataFrame(rows, "record_id string, domain string, entity_id string, concept string, unit string, period string, version string, value double, record_type string")
    targets = facts.filter("record_id in ('r001', 'r002', 'r005')").withColumn("target_id", F.col("record_id"))
    barred = spark.createDataFrame([(t, f"r{i:03}") for t in ("r001", "r002") for i in range(40, 200)], "target_id string, record_id string")
    foils = spark.createDataFrame([("r001", "r399"), ("r005", "r390")], "target_id string, record_id string")
    for limit in (60, 390):
        got = distractors.candidates(facts, targets, limit, barred=barred, foils=foils).collect()
        by = {t: [r for r in got if r.target_id == t] for t in ("r001", "r002", "r005")}
        hidden = {f"r{i:03}" for i in range(400) if i % 31 == 0} | {"r077"}
        for t, own in by.items():
            open_ = {r[0] for r in rows} - hidden - {t} - ({f"r{i:03}" for i in range(40, 200)} if t != "r005" else set())
            assert len(own) == min(limit, len(open_)) and {r.record_id for r in own} <= open_ and sorted(r.position for r in own) == list(range(1, len(own) + 1))
        for t, foil in (("r001", "r399"), ("r005", "r390")):
            at = next(r for r in by[t] if r.record_id == foil)
            assert at.position == min(r.position for r in by[t] if r.tier == at.tier)


def test_open_conditions_match_by_whatever_they_name(spark):
    facts = spark.createDataFrame([(f"r{i}", f"E{i % 3}", f"c{i % 2}", f"p{i % 5}", "u" if i % 4 else "w", f"v{i}") for i in range(60)], "record_id string, entity_id string, concept string, period string, unit string, version string")
    wanted = [("E1", "c0", None, None, None), ("E1", None, None, None, None), (None, "c1", "p2", None, None), (None, None, "p3", None, None), (None, None, None, "w", None), (None, None, None, None, "v7"), (None,) * 5, ("E2", None, None, None, "v8")]
    conds = spark.createDataFrame([(str(k), *w) for k, w in enumerate(wanted)], "target_id string, entity_id string, concept string, period string, unit string, version string")
    got = sorted((r.condition.target_id, r.record_id) for r in conditions.matches(facts, conds).collect())
    want = sorted((str(k), f.record_id) for f in facts.collect() for k, w in enumerate(wanted) if all(x is None or x == y for x, y in zip(w, f[1:])))
    assert got == want


def test_conditions_ask_for_metadata(spark):
    schema = "record_id string, entity_id string, concept string, period string, unit string, version string, metadata map<string,string>"
    rows = [(f"r{i:02}", f"E{i % 3}", f"c{i % 2}", "p", "u", "v", None if i % 7 == 0 else {"basis": "real" if i % 2 else "nominal", "arm": str(i % 4)} | ({"none": None} if i % 5 == 0 else {})) for i in range(60)]
    facts = spark.createDataFrame(rows, schema)
    wanted = [
        ("E1", None, {"basis": "real"}), ("E1", None, {"basis": "nominal", "arm": "2"}), (None, None, {"basis": "real"}), (None, "c1", {}), (None, None, {"missing": "x"}), ("E2", None, {"missing": None}), (None, None, {"basis": None}), (None, None, None), ("E1", None, {"basis": "real"}),
    ]
    conds = spark.createDataFrame([(str(k), e, c, None, None, None, m) for k, (e, c, m) in enumerate(wanted)], "target_id string, entity_id string, concept string, period string, unit string, version string, metadata map<string,string>")
    got = sorted((r.condition.target_id, r.record_id) for r in conditions.matches(facts, conds).collect())
    holds = lambda f, e, c, m: (e is None or f[1] == e) and (c is None or f[2] == c) and all((f[6] or {}).get(k) == v for k, v in (m or {}).items())
    assert got == sorted((str(k), f[0]) for f in rows for k, w in enumerate(wanted) if holds(f, *w))
    assert len({r for t, r in got if t == "0"}) < sum(f[1] == "E1" for f in rows)


def test_conditions_plan_no_nested_loop(spark):
    facts = spark.createDataFrame([("r", "E", "c", "p", "u", "v")], "record_id string, entity_id string, concept string, period string, unit string, version string")
    plan = conditions.matches(facts, facts.withColumnRenamed("record_id", "target_id"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_of_targets_with_one_id_take_the_strongest_relation(spark):
    rows = [(f"r{i:03}", "d", f"E{i % 20}", f"c{i % 3}", "u", f"CY{2000 + i % 10}", "v", float(i % 50)) for i in range(200)]
    facts = spark.createDataFrame(rows, "record_id string, domain string, entity_id string, concept string, unit string, period string, version string, value double")
    targets = facts.filter("record_id in ('r001', 'r002')").withColumn("target_id", F.lit("T"))
    got = distractors.candidates(facts, targets, 150).collect()
    assert len(got) == 150 and len({r.record_id for r in got}) == 150 and not {r.record_id for r in got} & {"r001", "r002"}
    want = {r.record_id: r.tier for r in distractors.strongest(distractors.related(facts, targets)).collect()}
    assert all(want.get(r.record_id, "OTHER_SAME_DOMAIN") == r.tier for r in got)


def test_unique_ids_lengthen_until_they_are(spark, monkeypatch):
    import hashlib

    keys = [f"k{i:04}" for i in range(900)]
    got = {r.k: r.unique_id for r in selection.unique_ids(spark.createDataFrame([(k,) for k in keys + keys[:5] + [None]], "k string"), "k", "s", digits=2).collect()}
    want: dict = {}
    for k in keys:
        h, n = hashlib.sha256(f"s|{k}".encode()).hexdigest().upper(), 2
        while f"R{h[:n]}" in want.values():
            n += 2
        want[k] = f"R{h[:n]}"
    assert got == want and len({len(v) for v in want.values()}) >= 3  # some collide twice
    with pytest.raises(ValueError):
        selection.unique_ids(spark.createDataFrame([(k,) for k in keys], "k string"), "k", "s", digits=2, most=2)


def test_positions_number_all_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    got = selection.positions(df, F.col("x").desc()).collect()
    assert {(r.x, r.position) for r in got} == {(999 - i, i + 1) for i in range(1000)} and selection.positions(df.limit(0), "x").count() == 0


def test_coverage_comes_before_balance(spark):
    import hashlib
    import random

    rng = random.Random(8)
    for n, total in ((400, 14), (30, 40), (300, 3)):
        rows = [(f"f{i:03}", rng.choice("abbbbbcdd"), rng.choice(["x"] * 8 + ["y", "z"]), rng.random() > 0.1) for i in range(n)]
        got = {r.pick: r.f for r in selection.coverage_sample(spark.createDataFrame(rows, "f string, kind string, domain string, ok boolean"), "f", "kind", "domain", "ok", total, "s").collect()}
        order = sorted(rows, key=lambda r: hashlib.md5(f"s|{r[0]}".encode()).hexdigest())
        chosen: list = []

        def take(wanted):
            found = next((r for r in order if r not in chosen and wanted(r)), None)
            chosen.extend([found] if found else [])
            return found

        for k in sorted({r[1] for r in rows}):
            take(lambda r, k=k: r[1] == k)
        for d in sorted({r[2] for r in rows}):
            if all(r[2] != d for r in chosen):
                take(lambda r, d=d: r[2] == d)
        while sum(not r[3] for r in chosen) < 2 and take(lambda r: not r[3]):
            pass
        while len(chosen) < min(total, n):
            kinds, domains = [r[1] for r in chosen], [r[2] for r in chosen]
            chosen.append(min((r for r in rows if r not in chosen), key=lambda r: (domains.count(r[2]) + kinds.count(r[1]), kinds.count(r[1]), r[0])))
        assert [got[i] for i in sorted(got)] == [r[0] for r in chosen[:total]]


def test_bootstrap_draws_are_poisson_and_cover(spark):
    import numpy as np

    draws = stats.poisson_draws(np.arange(3000) * 977, np.arange(400))
    share = [float((draws == k).mean()) for k in range(5)]
    assert all(abs(s - math.exp(-1) / math.factorial(k)) < 0.002 for k, s in enumerate(share)) and abs(np.corrcoef(draws[0], draws[1])[0, 1]) < 0.2
    rows = [(c, k, (c * 37 + i) % 10 < 3 + 2 * (k == "b")) for c in range(200) for k in "ab" for i in range(3)] + [(None, "a", True)]
    got = {r.k: r for r in stats.bootstrap(spark.createDataFrame(rows, "c int, k string, y boolean"), "c", "k", F.col("y"), 2000).collect()}
    for k, r in got.items():
        by = {}
        for c, kk, y in rows[:-1]:
            if kk == k:
                by.setdefault(c, []).append(y)
        rng, own = np.random.default_rng(1), [(sum(v), len(v)) for v in by.values()]
        plain = [sum(own[i][0] for i in pick) / sum(own[i][1] for i in pick) for pick in rng.integers(0, len(own), (2000, len(own)))]
        assert abs(r.low - np.percentile(plain, 2.5)) < 0.01 and abs(r.high - np.percentile(plain, 97.5)) < 0.01 and r.low < r.rate < r.high


def test_gee_tells_what_separates_and_what_depends(spark):
    rows = [(c, g, float((c * 7 + i * 3 + g) % 4 == 0) if g < 2 else 0.0) for c in range(80) for g in range(3) for i in range(2)]
    df = spark.createDataFrame(rows, "c int, g int, y double")
    coded, names = stats.dummies(df, "g", 0, [0, 1, 2])
    fit = stats.gee_logit(coded, "c", "y", names)
    assert fit.attrs["separated"] == ["g=2"] and fit.attrs["converged"]
    at = fit.set_index("name")
    assert at.loc["g=2", "coef"] is None and at.loc["g=2", "p"] is None and abs(at.loc["g=1", "coef"]) < 2 and at.loc["g=1", "se"] > 0
    assert stats.wald(fit, ["g=2"]) == (None, 0, None) and stats.wald(fit, names)[1] == 1
    alone, _ = stats.dummies(df.filter("g < 2"), "g", 0, [0, 1])
    small = stats.gee_logit(alone, "c", "y", ["g=1"]).set_index("name")
    assert abs(small.loc["g=1", "coef"] - at.loc["g=1", "coef"]) < 0.05
    twice = stats.gee_logit(alone.withColumn("again", F.col("`g=1`")), "c", "y", ["g=1", "again"])
    assert set(twice.attrs["separated"]) == {"g=1", "again"}


def test_gee_correlation_is_scaled_and_corrected(spark):
    """Worked by hand on two clusters of two rows and an intercept: mean 1/2, residuals (1, 1) and (1, -1), scale 4 / 3, one
    pair's product of 1 and one of -1 add up to 0; with (1, 1) and (-1, -1) to 2, over 4 / 3 and 2 - 1 pairs, cut at 0.95."""
    fit = lambda ys: stats.gee_logit(spark.createDataFrame([(i // 2, y) for i, y in enumerate(ys)], "c int, y double"), "c", "y", [])
    assert fit([1.0, 1.0, 0.0, 0.0]).attrs["alpha"] == 0.95
    six = fit([1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0])  # products 1, 1, -1, -1, 1, 1 over 12 / 11 and 5 pairs
    assert abs(six.attrs["scale"] - 12 / 11) < 1e-6 and abs(six.attrs["alpha"] - 2 / (12 / 11) / 5) < 1e-6


def test_equivalents_equal_all_pairs(spark):
    import random

    rng = random.Random(6)
    values = [1.0, 1.0 + 8e-10, 1.0 + 1.6e-9, 1.0 + 2.4e-9, 2.0, 0.0, 5e-10, -5e-10, 1e15, 1e15 + 1]  # some chains drift
    rows = [(f"r{i:03}", "d", rng.choice(["E1", "E2", None]), "c", rng.choice(["u", None]), rng.choice(["CY2020", "CY2020", "CY2021"]), "v", rng.choice([*values, None])) for i in range(160)]
    rows += [(f"h{i:03}", "d", "HOT", "c", "u", "CY2020", "v", 7.0) for i in range(300)]
    facts = spark.createDataFrame(rows, "record_id string, domain string, entity_id string, concept string, unit string, period string, version string, value double")
    got = {tuple(r.record_ids) for r in distractors.equivalents(facts).collect()}
    same = lambda a, b: a[2:6] == b[2:6] and abs(a[7] - b[7]) <= max(1e-12 * max(abs(a[7]), abs(b[7])), 1e-9)
    known = [r for r in rows if r[7] is not None]
    groups = {tuple(sorted(b[0] for b in known if same(a, b))) for a in known}
    assert got == {g for g in groups if len(g) > 1} and max(map(len, got)) == 300


def test_mcnemar_is_exact_for_few_and_many_pairs(spark):
    from fractions import Fraction

    pairs = [(b, c) for b in range(0, 26) for c in range(0, 26)] + [(129, 23), (400, 500), (2000, 2100), (0, 900), (3000, 3000), (7, 1200)]
    got = spark.createDataFrame(pairs, "b long, c long").select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n, k = r.b + r.c, min(r.b, r.c)
        want = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
        assert math.isclose(r.p, want, rel_tol=1e-11), (r.b, r.c, r.p, want)
    assert abs(spark.range(1).select(stats.mcnemar_p(F.lit(500_030_000), F.lit(499_970_000)).alias("p")).first().p - math.erfc((60_000 - 1) / math.sqrt(1e9) / math.sqrt(2))) < 1e-6


def test_interleave_equals_round_robin(spark):
    import random

    rng, weights = random.Random(1), {0: 2, 1: 3, 2: 4}
    rows = [(f"r{i:02}", rng.randrange(3)) for i in range(40)]
    df = spark.createDataFrame([(1, r, t, weights[t]) for r, t in rows], "k int, r string, t int, w int")
    got = [r.r for r in selection.interleave(df, ["k"], "t", "w", "r", limit=25).orderBy("position").collect()]
    left, want = {t: sorted(r for r, x in rows if x == t) for t in weights}, []
    while any(left.values()):
        for t, w in weights.items():
            want += left[t][:w]
            left[t] = left[t][w:]
    assert got == want[:25]


def test_allocate(spark):
    def seats(weights, total, least=1):
        rows = spark.createDataFrame(list(weights.items()), "k string, w double")
        return {r.k: r.seats for r in selection.allocate_rows(rows, "w", total, least).collect()}

    assert seats({"a": 0.2, "b": 0.3, "c": 0.5}, 10) == {"a": 2, "b": 3, "c": 5}
    assert seats({"a": 0.98, "b": 0.01, "c": 0.01}, 5) == {"a": 3, "b": 1, "c": 1} and seats({"a": 0.98, "b": 0.01, "c": 0.01}, 5, 0) == {"a": 5, "b": 0, "c": 0}
    assert seats({"a": 1.0, "b": 1.0, "c": 1.0}, 2) == {"a": 1, "b": 1, "c": 0} and seats({"a": 1.0, "b": 0.0}, 3) == {"a": 3, "b": 0} and seats({"a": 1.0}, 0) == {"a": 0}


def brute_growth(sizes, gold, lengths, target, tolerance, fill):
    """Each step by looking at every pending record."""
    pending, sides, ended, out = list(enumerate(sizes)), ([], []), False, []
    for nominal in lengths:
        if ended:
            out.append((nominal, "POOL_EXHAUSTED", 0, [], 0))
            continue
        weigh = lambda k: sum(sizes[i] for i in sides[k])
        while True:
            room, apart = nominal - gold - weigh(0) - weigh(1), abs(weigh(0) - weigh(1))
            ahead = sorted((abs(n - apart), i, n) for i, n in pending[: packing.WINDOW] if n <= room)
            chosen = [(i, n) for _, i, n in ahead] or [(i, n) for i, n in pending[packing.WINDOW :] if n <= room]
            if not chosen:
                break
            pending.remove(chosen[0])
            sides[weigh(0) > weigh(1)].append(chosen[0][0])
        total = gold + weigh(0) + weigh(1)
        ended = total > nominal or total < fill * nominal
        off = total and abs((weigh(0) + gold / 2) / total - target) > tolerance + 1e-9
        status = "PROMPT_BUDGET_EXCEEDED" if total > nominal else "POOL_EXHAUSTED" if ended else "POSITION_TOLERANCE_UNSATISFIABLE" if off else "OK"
        out.append((nominal, status, total, [*sides[0][::-1], *sides[1]], len(sides[0])) if status == "OK" else (nominal, status, total, [], 0))
    return out


def test_growth_equals_brute_force_nests_and_centres():
    import random

    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1, rng.choice([5, 60, 400])) for _ in range(rng.randrange(0, 90))]
        args = sizes, rng.randrange(0, 80), [100, 250, 700], 0.5, rng.choice([0.01, 0.05, 0.2]), 0.9
        assert list(packing.grow(*args)) == brute_growth(*args)
    tokens = [rng.randrange(5, 60) for _ in range(400)]
    last = set()
    for nominal, status, total, records, n in packing.grow(tokens, 40, [512, 1024, 2048], 0.5, 0.05, 0.9):
        assert status == "OK" and 0.9 * nominal <= total <= nominal and total == 40 + sum(tokens[i] for i in records)
        assert last < set(records) and abs(sum(tokens[i] for i in records[:n]) - sum(tokens[i] for i in records[n:])) < 0.1 * nominal
        last = set(records)
    assert [s for _, s, *_ in packing.grow([10] * 20, 10, [100, 500, 900], 0.5, 0.2, 0.9)] == ["OK", "POOL_EXHAUSTED", "POOL_EXHAUSTED"]
    assert [s for _, s, *_ in packing.grow([], 200, [100], 0.5, 0.05, 0.9)] == ["PROMPT_BUDGET_EXCEEDED"]


def brute_budget(sizes, gold, lengths, target, tolerance, fill, measure, budget):
    """Growth and shrinking one record at a time, each time over whole lists."""
    pending, before, after, ended, out = list(range(len(sizes))), [], [], False, []
    weigh = lambda side: sum(sizes[i] for i in side)
    for nominal in lengths:
        if ended:
            out.append((nominal, "POOL_EXHAUSTED", 0, [], 0))
            continue
        while True:
            room, apart = nominal - gold - weigh(before) - weigh(after), abs(weigh(before) - weigh(after))
            near = [i for i in pending[: packing.WINDOW] if sizes[i] <= room] or [i for i in pending if sizes[i] <= room][:1]
            if not near:
                break
            best = min(near, key=lambda i: (abs(sizes[i] - apart), i))
            pending.remove(best)
            (before if weigh(before) <= weigh(after) else after).append(best)
        for k, most in ((0, nominal), (1, budget)):
            while measure(before[::-1], after)[k] > most and before + after:
                side = before if before and (weigh(before) >= weigh(after) or not after) else after
                pending.insert(0, side.pop())
        tokens, prompt = measure(before[::-1], after)
        off = tokens and abs((weigh(before) + gold / 2) / tokens - target) > tolerance + 1e-9
        status = "PROMPT_BUDGET_EXCEEDED" if prompt > budget or tokens > nominal else "POOL_EXHAUSTED" if tokens < fill * nominal else "POSITION_TOLERANCE_UNSATISFIABLE" if off else "OK"
        ended = status in ("PROMPT_BUDGET_EXCEEDED", "POOL_EXHAUSTED")
        out.append((nominal, status, tokens, [*before[::-1], *after], len(before)) if status == "OK" else (nominal, status, tokens, [], 0))
    return out


def test_shrinking_under_a_prompt_budget_equals_brute_force():
    import random

    rng, seen = random.Random(9), set()
    for _ in range(400):
        sizes = [rng.randrange(1, rng.choice([5, 30, 90])) for _ in range(rng.randrange(0, 70))]
        gold, apart = rng.randrange(0, 40), rng.choice([0, 1, 3])
        calls = []

        def measure(before, after):
            calls.append(1)
            whole = gold + sum(sizes[i] + apart for i in [*before, *after])  # more than the records' own tokens
            return whole, whole + 25

        args = sizes, gold, [100, 250, 500], 0.5, rng.choice([0.05, 0.3]), rng.choice([0.3, 0.8]), measure, rng.choice([60, 180, 300, 1000])
        want, plain = brute_budget(*args), len(calls)
        calls.clear()
        got = list(packing.grow(*args))
        assert got == want and len(calls) <= plain + 3 * 8  # a bisection each length, not a probe each record
        seen |= {s for _, s, *_ in got}
        for nominal, status, tokens, records, n in got:
            assert status != "OK" or (tokens <= nominal and measure(records[:n], records[n:])[1] <= args[-1])
    assert seen == {"OK", "POOL_EXHAUSTED", "PROMPT_BUDGET_EXCEEDED", "POSITION_TOLERANCE_UNSATISFIABLE"}


def test_packs_keep_prompts_within_their_budget(spark):
    rows = [("f", f"r{i:02}", i, core.count_tokens(t := f"record {i} holds value {i * 37}"), t) for i in range(60)]
    cand = spark.createDataFrame(rows, "family_id string, record_id string, position int, tokens long, text string")
    gold = spark.createDataFrame([("f", "g", 0, core.count_tokens("gold is 5"), "gold is 5", "What is gold?")], "family_id string, record_id string, ord int, tokens long, text string, question string")
    prompt = lambda context, question: f"system text. {context} Question: {question}"
    out = packing.pack(cand, gold, (60, 120), fill=0.5, tolerance=0.3, budget=90, count=core.count_tokens, prompt=prompt).collect()
    texts = {r[1]: r[4] for r in rows} | {"g": "gold is 5"}
    for nominal in (60, 120):
        own = sorted((r for r in out if r.nominal == nominal), key=lambda r: r.position)
        context = "\n".join(texts[r.record_id] for r in own)
        assert own[0].status == "OK" and own[0].tokens == core.count_tokens(context) <= nominal and core.count_tokens(prompt(context, "What is gold?")) <= 90
    assert {r.record_id for r in out if r.nominal == 60} <= {r.record_id for r in out if r.nominal == 120}


def test_count_tokens_equals_its_column(spark):
    texts = ["", "a b", "élan vital, 12.5%", "日本語テキスト", "x" * 30, "a_b-c\nd", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(core.token_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [core.count_tokens(t) for t in texts]


def test_trimming_goes_in_turn_from_both_ends(spark):
    import random

    rng, rows, want = random.Random(5), [], set()
    for f in range(40):
        sides = ["before"] * rng.randrange(6) + ["gold"] * rng.randrange(1, 3) + ["after"] * rng.randrange(6)
        sizes = [rng.randrange(1, 20) for _ in sides]
        rows += [(str(f), 1, f"{f}-{k}", s, k, n) for k, (s, n) in enumerate(zip(sides, sizes))]
        kept, front = list(range(len(sides))), True
        while sum(sizes[k] for k in kept) > 45 and any(sides[k] != "gold" for k in kept):
            side = "before" if front else "after"
            own = [k for k in kept if sides[k] == side] or [k for k in kept if sides[k] not in (side, "gold")]
            kept.remove(own[0] if sides[own[0]] == "before" else own[-1])
            front = not front
        want |= {f"{f}-{k}" for k in kept}
    out = packing.trimmed(spark.createDataFrame(rows, "family_id string, nominal long, record_id string, side string, position int, size long"), 45)
    assert {r.record_id for r in out.collect()} == want


INSTANCE = dict(question_type="DIRECT_RETRIEVAL", answer_type="NUMERIC", answerable=True, gold_answer="100", tolerance=0.5, gold_sets=[["R1"]], context_display_ids=["R1", "R2", "R3"], records=[("R1", "100"), ("R2", "90"), ("R3", "70")], distractors={"R2": "WRONG_PERIOD", "R3": "NEAR_MATCH_VALUE"}, raw_result=None, rounded_result=None, round_decimals=None)
SCHEMA = "raw_output_text string, question_type string, answer_type string, answerable boolean, gold_answer string, tolerance double, gold_sets array<array<string>>, context_display_ids array<string>, records array<struct<display_id:string,value:string>>, distractors map<string,string>, raw_result double, rounded_result double, round_decimals int"
CALC = dict(question_type="RETRIEVAL_CALCULATION", gold_answer="33.33", tolerance=0.005, raw_result=33.3333333, rounded_result=33.33, round_decimals=2)


@pytest.mark.parametrize("raw,change,error,halluc", [
    ("100", {}, "FORMAT_FAILURE", None), ("ANSWER: 100.2", {}, "CORRECT", False), ("ANSWER: insufficient_evidence", {}, "UNNECESSARY_ABSTENTION", False), ("ANSWER: 5", {"answerable": False, "gold_answer": None}, "FAILED_TO_ABSTAIN", True),
    ("ANSWER: INSUFFICIENT_EVIDENCE", {"answerable": False, "gold_answer": None}, "CORRECT", False), ("ANSWER: 90", {}, "WRONG_PERIOD", False), ("ANSWER: 70", {}, "AMBIGUOUS_REVIEW_REQUIRED", False), ("ANSWER: 12345", {}, "UNSUPPORTED_VALUE", True),
    ("ANSWER: 33.3", CALC, "CALCULATION_ERROR", False), ("ANSWER: 70", CALC, "CALCULATION_ERROR", False),
])
def test_answer_rules(spark, raw, change, error, halluc):
    r = grading.grade_answer_only(spark.createDataFrame([(raw, *(INSTANCE | change).values())], SCHEMA)).first()
    assert (r.error_type, r.hallucination) == (error, halluc)


def test_recovery_in_the_jvm_equals_the_plain_one(spark):
    import json
    import random

    rng, texts = random.Random(2), ["", None, "null", "[]", "{", '{"answer": "x", "selected_evidence": [], "insufficient_evidence": false} and more', '{"answer": 1.50, "selected_evidence": ["R1"], "insufficient_evidence": true}', '{"answer": "a}b", "selected_evidence": [], "insufficient_evidence": false}']
    parts = ["answer", "selected_evidence", "insufficient_evidence"]
    for _ in range(300):
        own = {"answer": rng.choice(["12", None, 5, True, "é\n\"q\"", ["x"]]), "selected_evidence": rng.choice([[], ["R12345678"], ["R12345678"] * rng.randrange(30), [1, "a"], None, "R1"]), "insufficient_evidence": rng.choice([True, False, None, "no"])}
        text = json.dumps({k: own[k] for k in rng.sample(parts, rng.choice([2, 3, 3, 3, 3]))}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        texts.append(rng.choice([text, text, f" {text} ", f"```json\n{text}\n```", text.replace("true", "True"), text[:-1], f"so {text} ok", text + text, text.replace(": ", ":")]))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", grading.recovered(F.col("t")).alias("r")).collect()
    for r in got:
        assert r.r.asDict() == grading.recover(texts[r.i]), texts[r.i]
    assert sum(r.r.method == "strict" for r in got) > 20 and len({r.r.method for r in got}) >= 5


def response(answer, ids=("R1",), insufficient=False):
    import json

    return json.dumps({"selected_evidence": list(ids), "answer": answer, "insufficient_evidence": insufficient})


@pytest.mark.parametrize("raw,change,error,halluc", [
    ("{", {}, "FORMAT_FAILURE", None), (response("100"), {}, "CORRECT", False), (response("100", ["R2"]), {}, "WRONG_EVIDENCE", False), (response("90", ["R2"]), {}, "WRONG_PERIOD", False), (response("7"), {}, "UNSUPPORTED_VALUE", True),
    (response("70"), {"answerable": False, "gold_answer": None}, "FAILED_TO_ABSTAIN", False), (response("71"), {"answerable": False, "gold_answer": None}, "FAILED_TO_ABSTAIN", True), (response("INSUFFICIENT_EVIDENCE", [], True), {"answerable": False, "gold_answer": None, "gold_sets": []}, "CORRECT", False),
    (f"```json\n{response('100')}\n```", {}, "CORRECT", False), (f"Sure: {response('100')} done", {}, "CORRECT", False), (response("100").replace("false", "False"), {}, "CORRECT", False), (response("100")[:-1], {}, "CORRECT", False),
])
def test_structured_rules(spark, raw, change, error, halluc):
    r = grading.grade_structured(spark.createDataFrame([(raw, *(INSTANCE | change).values())], SCHEMA)).first()
    assert (r.error_type, r.hallucination) == (error, halluc)


@pytest.mark.parametrize("b,c,p", [(41, 17, 0.00223255), (0, 0, 1.0), (5, 5, 1.0), (129, 23, 4.33e-19)])
def test_mcnemar(spark, b, c, p):
    n = b + c
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
    got = one(spark, stats.mcnemar_p(F.lit(b).cast("long"), F.lit(c).cast("long")))
    assert math.isclose(got, exact, rel_tol=1e-9) and math.isclose(got, p, rel_tol=1e-2)


def test_gee_recovers_odds(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    u = np.repeat(rng.normal(0, 0.5, 400), 5)
    x = np.tile(np.arange(5.0), 400)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(-1 + 0.3 * x + u)))).astype(float)
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in zip(np.repeat(np.arange(400), 5), x, y)], "c long, x double, y double")
    fit = stats.gee_logit(df, "c", "y", ["x"])
    assert abs(fit["coef"][1] - 0.28) < 0.1 and 0 < fit.attrs["alpha"] < 0.3
    flat = stats.gee_logit(df, "c", "y", ["x"], exchangeable=False)
    beta = np.zeros(2)
    design = np.column_stack([np.ones(2000), x])
    for _ in range(20):
        mu = 1 / (1 + np.exp(-design @ beta))
        beta = beta + np.linalg.solve(design.T @ (design * (mu * (1 - mu))[:, None]), design.T @ (y - mu))
    assert np.allclose(flat["coef"], beta, atol=1e-6)
    b, alpha, score, info, meat = fit["coef"].to_numpy(), fit.attrs["alpha"], np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2))
    for k in range(0, 2000, 5):  # the estimating equations and the sandwich, cluster by cluster with whole matrices
        d, mu = design[k : k + 5], 1 / (1 + np.exp(-design[k : k + 5] @ b))
        root = np.sqrt(mu * (1 - mu))
        v = np.linalg.inv(root[:, None] * ((1 - alpha) * np.eye(5) + alpha) * root)
        left = (d * (mu * (1 - mu))[:, None]).T @ v
        u = left @ (y[k : k + 5] - mu)
        score, info, meat = score + u, info + left @ (d * (mu * (1 - mu))[:, None]), meat + np.outer(u, u)
    assert np.allclose(score, 0, atol=1e-4) and np.allclose(fit["se"], np.sqrt(np.diag(np.linalg.inv(info) @ meat @ np.linalg.inv(info))), rtol=1e-6)
    coded, names = stats.dummies(df.withColumn("k", F.col("x").cast("int")), "k", 0)
    many = stats.gee_logit(stats.interactions(coded.withColumn("odd", (F.col("c") % 2).cast("double")), names, ["odd"])[0], "c", "y", [*names, "odd", *[f"{n}:odd" for n in names]])
    chi, n, p = stats.wald(many, [f"{n}:odd" for n in names])
    assert names == ["k=1", "k=2", "k=3", "k=4"] and n == 4 and 1e-6 < p <= 1
    chi, n, p = stats.wald(fit, ["x"])
    assert n == 1 and math.isclose(p, math.erfc(math.sqrt(chi / 2)), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(stats.chi2_sf(6.904, 2), 0.0317, rel_tol=1e-2)


def test_ols(spark):
    fit = stats.ols(spark.range(50).select(F.col("id").cast("double").alias("x")), 3 + 2 * F.col("x"), {"x": F.col("x")})
    assert math.isclose(fit["x"], 2) and math.isclose(fit["intercept"], 3) and math.isclose(fit["r2"], 1)


def test_repetition_is_seen_in_the_whole_text(spark):
    from factloom.plans import audit

    words = " ".join(f"w{i}" for i in range(600))
    rows = [(0, words + " loop" * 12), (1, words + " loop" * 11), (2, "a " * 19), (3, "a, " * 12 + "b c d e f g h i"), (4, None), (5, words + " loop" * 5000)]
    flags = spark.createDataFrame(rows, "i int, t string").select("i", audit.answer_flags(F.col("t"), F.lit(1), 9).alias("f"))
    assert {r.i for r in flags.collect() if r.f.repeats} == {0, 3, 5}


def test_conditions_beyond_the_bound_are_an_error(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("event_type"))
    assert len(selection.few_values(df.filter("id < 1000"), "event_type")) == 1000
    with pytest.raises(ValueError):
        selection.few_values(df, "event_type")
