"""Personal data, vector codes and the Merkle manifest against brute force, and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import merkle, pii, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    found = [(m.start(), list(RULES).index(k), m.end()) for k, p in RULES.items() for m in re.finditer(p, text) if holds(k, m[0])]
    return [(list(RULES)[k], s, e) for s, k, e in sorted(found)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    words = "the of and que les der die das los con pour nicht etwas year people".split()
    x, y, kinds = pii.examples([" ".join(rng.choice(words) for _ in range(20)) for _ in range(200)], 3000)
    held = np.arange(len(y)) % 4 == 0
    return pii.calibrate(pii.boost(x[~held], y[~held]), x[held], y[held], [k for k, h in zip(kinds, held) if h], 0.97)


@pytest.mark.parametrize("alphabet", ["a1@.-_ +", "0123456789.-  +()", "12 3.4@ab.-é+("])
def test_base_spans_equal_plain_rules(alphabet):
    rng = random.Random(alphabet)
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [tuple(s) for s in pii.base_spans(text)] == brute_spans(text), text


@pytest.mark.parametrize("text", ["1" * 10**6, "1." * 300_000, "a@" * 300_000, "(1" * 300_000, "1:" * 300_000, "a at " * 200_000, "+1" + " " * 10**6, "a.b@c." * 200_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)
    sum(1 for _ in pii.proposals(text))


def test_boosted_trees_find_written_data_and_leave_lookalikes(model):
    find = lambda text: [(s.kind, text[s.start : s.end]) for s, _ in pii.further_spans(text, pii.base_spans(text), model)]
    assert find("please write to jane.roe [at] example [dot] org today") == [("email_written", "jane.roe [at] example [dot] org")]
    assert find("call me on (743) 555-3824 now") == [("phone_local", "(743) 555-3824")]
    assert find("our account GB82 WEST 1234 5698 7654 32 is open") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert find("server 2001:db8:0:1:1:1:1:1 is down") == [("ip6", "2001:db8:0:1:1:1:1:1")]
    assert find("ssn 123-45-6789, she said") == [("ssn", "123-45-6789")]
    for clean in ("on 2023-04-05 at 12:30:45 we met", "between 1990-1995 they sold 1 234 567 € of it", "ISBN 978-3-16-148410-0", "look at this dot product here", "call +1 (743) 555-3824 now", "account GB83 WEST 1234 5698 7654 32"):
        assert find(clean) == [], clean


def test_boosted_trees_hold_on_other_contexts(model):
    x, y, kinds = pii.examples(["other words stand here", "ganz andere Worte stehen da"], 2000, seed=77)
    chosen = model.probability(x) >= np.array([model.threshold[k] for k in kinds])
    assert y[chosen].mean() > 0.9 and chosen[y == 1].mean() > 0.9


def test_pii_report_and_redaction(spark, model):
    long = "x 70.23.22.57 " * 30_000
    rows = [(1, "mail a.b@c.de or +1 (743) 555-3824", "en", "a", 1), (1, "mail a.b@c.de or +1 (743) 555-3824", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "😀 é 4111 1111 1111 1111.", "en", "b", 2), (None, long, "en", "c", 3), (5, "reach jane [at] example [dot] org", "en", "c", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("base", "more", "kind", "start", "spans", "score")})
    out = pii.report(docs, model).collect()
    assert len(out) == len(rows)
    want = Counter()
    for r in rows:
        base = brute_spans(r[1] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        want[(r[0], *[sum(k == kind for k, _, _ in base) for kind in RULES], hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    assert next(r.spans for r in out if r.doc_id == 5) == "email_written:6:33"
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[1] == "mail [EMAIL] or [PHONE]" and clean[2] is None and clean[4] == "😀 é [CARD]." and clean[None] == "x [IP] " * 30_000
    assert pii.report(empty(spark)).count() == 0


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label), one length, in order; whole numbers without a bound."""
    whole = [[int(np.floor(c * scale)) if abs(c) < 1e290 else int(c) * scale for c in v] for _, v, _ in rows]
    n = len(whole[0])
    cuts = [n * k // parts for k in range(parts + 1)]
    part = [[w[a:b] for w in whole] for a, b in zip(cuts[:-1], cuts[1:])]
    ids = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1])):
        ids.setdefault(rows[i][0], i)
    books = [[p[i] for i in list(ids.values())[:entries]] for p in part]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in zip(part, books):
            codes = [near(x, book)[1] for x in p]
            for k in range(len(book)):
                own = [x for x, c in zip(p, codes) if c == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
    last = [[near(x, book) for x in p] for p, book in zip(part, books)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [("".join(f"{p[i][1]:02x}" for p in last), sum(p[i][0] for p in last), digest) for i in range(len(rows))]


def fits(x):
    return x if x is not None and x < 1 << 63 else None


@pytest.mark.parametrize("kind", ["float", "large", "few", "uneven", "repeated"])
def test_vector_codes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    n, d = {"few": (5, 16), "uneven": (60, 19)}.get(kind, (120, 16))
    x = np.round(rng.standard_normal((n, d)), 2).tolist()
    if kind == "large":
        x[3][2], x[4], x[9][5] = 1e5, [1e30] * d, -1e308
    ids = [k // 2 if kind == "repeated" else k for k in range(n)]
    ids[-1] = None
    rows = [(i, v, None if i is not None and i % 5 == 0 else (i or 0) % 3) for i, v in zip(ids, x)]
    bad = [(900, None, 1), (901, [1.0, None] + [0.0] * (d - 2), 1), (902, [float("nan")] * d, 1), (903, [float("inf")] * d, 1)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("code", "error", "length", "rank", "of", "total")})
    got = vector_codes.compress(vectors.repartition(5)).collect()
    want = brute_codes(rows)
    assert Counter((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in got) == Counter((r[0], c, fits(e), s) for r, (c, e, s) in zip(rows, want))
    sums = {}
    for (_, _, label), (_, e, _) in zip(rows, want):
        sums[label] = None if fits(e) is None or sums.get(label, 0) is None else sums.get(label, 0) + e
    assert all(r.label_error == fits(sums[r.label]) for r in got)


def test_vantage_point_tree_visits_ties_and_prunes():
    rng = np.random.default_rng(1)
    for low, m in ((-3, 16), (-40, 1), (-4000, 64)):
        entries, x = rng.integers(low, -low, (m, 4)), rng.integers(2 * low, -2 * low, (500, 4))
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        for kind in (np.int64, object):
            code, best, seen = vector_codes.nearest(x.astype(kind), entries.astype(kind))
            assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and seen <= d.size
    clusters = rng.integers(-5, 5, (64, 8)) + 1000 * rng.integers(-9, 9, (64, 8))
    assert vector_codes.nearest(clusters[rng.integers(0, 64, 2000)], clusters)[2] < 0.7 * 64 * 2000


def test_vector_codes_of_other_lengths_and_none(spark):
    schema = "vec_id long, embedding array<float>, label string"
    out = vector_codes.compress(spark.createDataFrame([(1, [1.0] * 8, "a"), (2, [], None), (2, [], None), (3, [0.5] * 3, "a")], schema)).collect()
    assert sorted(r.vec_id for r in out) == [1, 2, 2, 3] and all(r.code == "00" * 8 and r.error == 0 for r in out)
    assert len({r.codebooks_sha256 for r in out}) == 3
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """(root, for each node the siblings before and after it on each level)."""
    known = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for r in range(0, len(nodes), 8):
            run = nodes[r : r + 8]
            for k in range(len(run)):
                for i in below[r + k]:
                    known[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            under.append([i for b in below[r : r + 8] for i in b])
        nodes, below = up, under
    return nodes[0], known


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = climb([trees[g][0] for g in order])
    out = Counter()
    for g, up in zip(order, above):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            r = x[3]
            node = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else x[2]
            for before, after in path + up:
                node = h(before, node, after)
            out[(r[0], x[2], trees[g][0], root, h(*[s for pair in path + up for s in pair]), node, node == root)] += 1
    return out


@pytest.mark.parametrize("rows_each,few", [(100_000, 10_000), (23, 10_000), (23, 0), (7, 0)])
def test_manifest_equals_brute_force(spark, rows_each, few):
    rng = random.Random(rows_each)
    rows = [(i if rng.random() < 0.9 else i - 1, rng.choice(["Text A", "b", "", None, "É Z"]) , rng.choice(["en"] * 6 + ["de", "fr", None, ""]), rng.choice(["s", None]), rng.choice([1, None])) for i in range(400)]
    rows += [(None, "N", "en", None, None), (7, "X" * 100_000, f"only-{1}", "s", 1), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1)] + [(5000 + i, "T", f"l{i:02d}", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("grp", "key", "leaf", "part", "at", "root", "changed", "level")})
    got = merkle.manifest(docs.repartition(3), rows_each=rows_each, few=few).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(rows)


def test_manifest_of_hot_copies_one_row_and_none(spark):
    rows = [(1, "Same", "en", "s", 4)] * 300 + [(2, "Other", "en", "s", 5)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), rows_each=20).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(rows)
    one = merkle.manifest(spark.createDataFrame(rows[-1:], DOCS)).collect()
    assert Counter(tuple(r) for r in one) == brute_manifest(rows[-1:])
    assert merkle.manifest(empty(spark)).count() == 0


def test_proofs_verify_and_see_changes(spark):
    rows = [(i, f"Text {i}", "en" if i % 3 else None, "s", i) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    proven = docs.join(merkle.manifest(docs, proofs=True, rows_each=40).select("doc_id", "proof", "root"), "doc_id")
    seen = lambda df: {r.v for r in df.select(merkle.verify(df).alias("v")).collect()}
    assert seen(proven) == {True}
    for c, v in (("text", F.concat("text", F.lit("."))), ("n_chars", F.lit(None).cast("long")), ("source", F.lit("other"))):
        assert seen(proven.withColumn(c, v)) == {False}
