"""Secret scans over whole texts, in DataFrame operations only.

Three patterns give the base spans. Beside them, candidate strings of a character class are searched by the Shannon
entropy of a window that slides over them: each step takes one character out of the class's counts and one in, and the
entropy follows from the two counts that change, so a candidate takes time in proportion to its length. A candidate is reported from its first to the end of its last window at
or above the class's limit. An allow-list pattern takes the run of letters and digits it stands in out of a candidate
(all of it if the pattern is anchored); what is left on either side is searched on its own. Strings of one case with
digits have classes of their own, reported where no other span holds them. Spans are in code points, end exclusive.

SQL has neither these two classes nor the rest of a candidate beside an allowed run: it agrees on tables without both.

Null texts count as empty and have no spans; very long texts and candidates are searched whole; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW, GROUP = 20, 128
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")


class CharClass(NamedTuple):
    kind: str
    pattern: str
    #: Patterns that a candidate must match.
    must: tuple[str, ...]
    #: Characters counted one by one; candidates are lower-cased first if fold.
    alphabet: str
    fold: bool
    limit: float


CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", ("[0-9]", "[A-Fa-f]"), "0123456789abcdef", True, 3.01),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", ("[0-9]", "[A-Z]", "[a-z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", False, 3.83),
)
#: Keys of one case (base36, base32). Of random ones of 20 characters 0.96 and 0.95 have a window at the limit and a digit.
ONE_CASE = (
    CharClass("entropy_lower", r"[a-z0-9]{20,}", ("[0-9]", "[g-z]"), "abcdefghijklmnopqrstuvwxyz0123456789", False, 3.5),
    CharClass("entropy_upper", r"[A-Z0-9]{20,}", ("[0-9]", "[G-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", False, 3.5),
)
#: What is no secret: UUIDs, documented samples and counting or repeated fillers.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy",
    r"(?i)0123456789|123456789abc|abcdefghij|xxxxxx|000000",
)


def _let(value: Column, of) -> Column:
    """of(value), with value computed once."""
    return F.transform(F.array(value), of)[0]


def _placed(items: Column) -> Column:
    """Array of (start, end, found) of items (gap, size, skip, found) that follow each other. Sums run within groups of
    GROUP items and over the groups' sums, so arrays that grow by appending stay short."""
    spans = "array<struct<start:int,end:int,found:string>>"
    length = lambda x: x["gap"] + x["size"] + x["skip"]

    def one(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        return F.struct((a["at"] + length(x)).alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["found"].alias("found"))).alias("out"))

    def of(groups: Column) -> Column:
        add = lambda a, g: F.struct((a["at"] + F.aggregate(g, F.lit(0), lambda n, x: n + length(x))).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        firsts = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda a: a["out"])
        return F.flatten(F.zip_with(groups, firsts, lambda g, at: F.aggregate(g, F.struct(at.alias("at"), F.array().cast(spans).alias("out")), one, lambda a: a["out"])))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), lambda k: F.slice(all_, k * GROUP + 1, GROUP))
    return _let(items, lambda all_: F.when(F.size(all_) > 0, _let(cut(all_), of)).otherwise(F.array().cast(spans)))


def _matches(text: Column, pattern: str, group: Column) -> Column:
    """Array of (start, end, found) of all matches: lengths of what stands between and in them, summed up."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    items = F.transform(F.arrays_zip(between.alias("b"), found.alias("f"), group.alias("g")), lambda x: F.struct(F.char_length(x["b"]).alias("gap"), F.char_length(x["f"]).alias("size"), F.lit(0).alias("skip"), x["g"].alias("found")))
    return F.when(text.rlike(pattern), _placed(F.filter(items, lambda x: x["size"].isNotNull()))).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def _rest(candidate: Column, allow: tuple[str, ...]) -> Column:
    """Array of (start, end, found) of what allow patterns leave of a candidate."""
    whole, inner = [a for a in allow if a.startswith("^")], [a for a in allow if not a.startswith("^")]
    out = F.array(F.struct(F.lit(0).alias("start"), F.char_length(candidate).alias("end"), candidate.alias("found")))
    if inner:
        # Tried at starts of runs only, so time is linear in the run.
        cover = "(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:" + "|".join(f"(?:{a})" for a in inner) + ")[A-Za-z0-9]*"
        parts = F.arrays_zip(F.split(candidate, cover, -1).alias("b"), F.regexp_extract_all(candidate, F.lit(cover), F.lit(0)).alias("f"))
        items = F.transform(parts, lambda x: F.struct(F.lit(0).alias("gap"), F.char_length(x["b"]).alias("size"), F.coalesce(F.char_length(x["f"]), F.lit(0)).alias("skip"), x["b"].alias("found")))
        out = F.when(candidate.rlike(cover), _placed(items)).otherwise(out)
    return F.when(_all([~candidate.rlike(a) for a in whole]), out).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("int").alias("end"))


def _windows(candidate: Column, c: CharClass, window: int) -> Column:
    """(first, last) of the candidate's windows at or above the limit: start of the first, end of the last; else -1.

    The class's counts are packed into a few 64-bit integers. A step takes a character in and the one that leaves the
    window out; the sum of k * log2(k) over all counts k, in units of 2**-32, follows from the two counts that change."""
    bits = window.bit_length()
    per, unit = 62 // bits, 1 << 32
    n_words = -(-len(c.alphabet) // per)
    f = [round(k * math.log2(k) * unit) if k else 0 for k in range(window + 2)]
    table = lambda values: F.array(*map(F.lit, values))
    up, down = table([f[k + 1] - f[k] for k in range(window + 1)]), table([0] + [f[k - 1] - f[k] for k in range(1, window + 2)])
    code_of, ones = table([c.alphabet.find(chr(k)) for k in range(128)]), table([1 << (bits * k) for k in range(per)])
    most = math.floor((math.log2(window) - c.limit) * window * unit)  # of the sum, in a window at the limit
    codes = F.transform(F.split(F.lower(candidate) if c.fold else candidate, ""), lambda x: F.element_at(code_of, F.ascii(x) + 1))
    steps = _let(codes, lambda all_: F.zip_with(all_, F.slice(F.concat(F.array_repeat(F.lit(-1), window), all_), 1, F.size(all_)), lambda i, o: F.struct(i.alias("i"), o.alias("o"))))
    count = lambda words, code: F.call_function("shiftright", F.element_at(words, F.floor(code / per).cast("int") + 1), (code % per) * bits).bitwiseAND(F.lit((1 << bits) - 1))
    start = F.struct(F.array(*[F.lit(0).cast("long")] * n_words).alias("words"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    hot = lambda a: (a["n"] >= window) & (a["sum"] <= most)
    first = lambda a: F.when(hot(a) & (a["first"] < 0), a["n"] - window).otherwise(a["first"])
    last = lambda a: F.when(hot(a), a["n"]).otherwise(a["last"])

    def step(a: Column, x: Column) -> Column:
        leaves = x["o"] >= 0
        n_out = F.when(leaves, count(a["words"], F.greatest(x["o"], F.lit(0)))).otherwise(0).cast("int")
        n_in = (count(a["words"], x["i"]) - F.when(x["i"] == x["o"], 1).otherwise(0)).cast("int")
        within = lambda code, k: (code >= k * per) & (code < (k + 1) * per)
        one = lambda code, k: F.when(within(code, k), F.element_at(ones, code - k * per + 1)).otherwise(0)
        words = F.array(*[a["words"][k] + one(x["i"], k) - one(x["o"], k) for k in range(n_words)])
        total = a["sum"] + F.element_at(down, n_out + 1) + F.element_at(up, n_in + 1)
        return F.struct(words.alias("words"), total.alias("sum"), (a["n"] + 1).alias("n"), first(a).alias("first"), last(a).alias("last"))

    return F.aggregate(steps, start, step, lambda a: F.struct(first(a).alias("first"), last(a).alias("last")))


def scan(docs: DataFrame, window: int = WINDOW, classes: tuple[CharClass, ...] = CLASSES + ONE_CASE, allow: tuple[str, ...] = ALLOW, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id), and base and more: arrays of (start, rank, end), ordered, rank a place in KINDS."""
    text = F.col("_text")
    hit = lambda pattern, group=0: _matches(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    spans = lambda kind, found: F.transform(found, lambda x: _span(kind, x["start"], x["end"]))
    out = docs.select(*[F.col(c) for c in (keep or ["doc_id"])], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    assign = F.filter(hit(ASSIGN, 2), lambda x: F.char_length(x["found"]) >= 6)
    base = F.array_sort(F.concat(spans("assign", assign), spans("access", hit(ACCESS)), spans("hex", hit(HEX))))

    def found(c: CharClass) -> Column:
        left = F.flatten(F.transform(hit(c.pattern), lambda x: F.transform(_rest(x["found"], allow), lambda y: F.struct((x["start"] + y["start"]).alias("start"), y["found"].alias("found")))))
        left = F.filter(left, lambda x: (F.char_length(x["found"]) >= window) & _all([x["found"].rlike(m) for m in c.must]))
        seen = F.transform(left, lambda x: F.struct(x["start"].alias("start"), _windows(x["found"], c, window).alias("w")))
        return F.transform(F.filter(seen, lambda x: x["w"]["first"] >= 0), lambda x: _span(c.kind, x["start"] + x["w"]["first"], x["start"] + x["w"]["last"]))

    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    out = out.select("*", base.alias("base"), F.concat(none, *[found(c) for c in classes if c not in ONE_CASE]).alias("_seen"))
    held = lambda x: F.exists(F.concat("base", "_seen"), lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))
    alone = [F.filter(found(c), lambda x: ~held(x)) for c in classes if c in ONE_CASE]
    return out.select("*", F.array_sort(F.concat("_seen", *alone)).alias("more")).drop("_seen")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans."""
    found = scan(docs)
    n = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mask; overlapping spans are masked once. Other columns stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).alias("out"))
    if {"base", "more", "_text", "_seen"} & {c.lower() for c in docs.columns}:
        raise ValueError("base, more, _text and _seen are taken; pass such columns within a struct")
    found = scan(docs, keep=docs.columns)
    masked = F.aggregate(F.array_sort(F.concat("base", "more")), start, step, lambda a: F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1, F.char_length("_text"))))
    text = F.when(F.size("base") + F.size("more") > 0, masked).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def _sql_matches(name: str, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
{name}_m AS (SELECT doc_id, n, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', 0) AS f, regexp_extract_all(t, '{p}', {group}) AS g FROM d),
{name} AS (SELECT n, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(f[i]) AS size, g[i] AS found
  FROM (SELECT n, b, f, g, unnest(range(1, len(f) + 1)) AS i FROM {name}_m))"""


def _sql() -> str:
    more = [_sql_matches("assign", ASSIGN, 2), _sql_matches("access", ACCESS), _sql_matches("hex", HEX)]
    union = ["SELECT n, s, 0 AS k, s + size AS e FROM assign WHERE length(found) >= 6", "SELECT n, s, 1, s + size FROM access", "SELECT n, s, 2, s + size FROM hex"]
    for c in CLASSES:
        more.append(_sql_matches(c.kind, c.pattern))
        where = " AND ".join([f"regexp_matches(found, '{m}')" for m in c.must] + [f"NOT regexp_matches(found, '{a}')" for a in ALLOW])
        text = "lower(found)" if c.fold else "found"
        more.append(f"""
{c.kind}_w AS (SELECT n, s, list_filter(list_transform(range(1, size - {WINDOW} + 2), lambda i: CASE WHEN list_aggregate(string_split(substr({text}, i, {WINDOW}), ''), 'entropy') >= {c.limit} THEN i END), lambda i: i IS NOT NULL) AS w FROM {c.kind} WHERE {where})""")
        union.append(f"SELECT n, s + w[1] - 1, {KINDS.index(c.kind)}, s + w[len(w)] - 1 + {WINDOW} FROM {c.kind}_w WHERE len(w) > 0")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS[: 3 + len(CLASSES)]) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents), {','.join(more)},
a AS ({' UNION ALL '.join(union)}),
j AS (SELECT n, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
        string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE k < 3) AS base, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM a GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (n)"""


SQL = _sql()
