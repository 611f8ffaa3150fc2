"""Scalar functions as Column expressions: ids, numbers, dates, periods, labels, answers, tokens, rendering."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INSUFFICIENT = "insufficient_evidence"
ANSWER_TYPES = ("NUMERIC", "PERCENT", "INTEGER", "STRING", "DATE", "CATEGORICAL", "INSUFFICIENT_EVIDENCE")
TOKEN = r"(?U)\w+|[^\w\s]"


def text_of(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def slug(c: Column) -> Column:
    """Runs of other than letters and digits become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text_of(c), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def record_id(prefix: str, *parts: Column) -> Column:
    """Prefix, slugs of the parts, and eight hex digits of the SHA-1 of the raw parts; nulls count as empty."""
    raw = F.array_join(F.array(F.lit(prefix), *[text_of(p) for p in parts]), "|")
    return F.concat_ws("_", F.lit(prefix), F.array_join(F.filter(F.array(*[slug(p) for p in parts]), lambda x: x != ""), "_"), F.substring(F.sha1(raw), 1, 8))


def order_key(seed: Column | str, *parts: Column) -> Column:
    """A seeded, engine-independent order: the MD5 of seed and parts joined by bars."""
    first = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.array_join(F.array(text_of(first), *[text_of(p) for p in parts]), "|"))


def rank_key(seed: str, c: Column) -> Column:
    """A seeded, engine-independent number below 2**60. The exclusive or of two of them orders one's partners anew for each
    of the other, without a digest a pair."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), text_of(c))), 1, 15), 16, 10).cast("long")


def display_id(seed: str, c: Column, digits: int = 10) -> Column:
    return F.concat(F.lit("R"), F.upper(F.substring(F.sha2(F.concat(F.lit(seed + "|"), text_of(c)), 256), 1, digits)))


def canonical_number(c: Column) -> Column:
    """A finite double or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def canonical_date(c: Column) -> Column:
    """YYYYMMDD becomes ISO; anything else stays."""
    compact = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(c.rlike(r"^\d{8}$"), compact).otherwise(c)


def is_missing(c: Column, tokens: tuple[str, ...] = ("", ".", "na", "n/a", "null")) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*tokens)


def period_label(frame: Column, start: Column, end: Column) -> Column:
    span = F.when(start.isNotNull() & (start != ""), F.concat(start, F.lit(".."), end)).otherwise(F.concat(F.lit("AS_OF_"), end))
    return F.when(frame.isNotNull() & (frame != ""), frame).otherwise(span)


def period_kind(frame: Column, start: Column) -> Column:
    """annual, quarterly or instant by the frame; instant without a start, else duration."""
    framed = F.coalesce(frame, F.lit("")).rlike(r"^CY(\d{4})(Q\d)?(I)?$")
    by_frame = F.when(frame.endswith("I"), "instant").when(frame.contains("Q"), "quarterly").otherwise("annual")
    return F.when(framed, by_frame).when(start.isNull() | (start == ""), "instant").otherwise("duration")


def period_span(period: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """(first, last) day of CYyyyy, CYyyyyQq and a..b periods, else of start and end, else the period itself twice;
    instants have no span."""
    year = F.regexp_extract(period, r"^CY(\d{4})", 1)
    quarter = F.regexp_extract(period, r"^CY\d{4}Q([1-4])$", 1).try_cast("int")
    first_month = (quarter - 1) * 3 + 1
    quarter_start = F.try_to_date(F.concat(year, F.lit("-"), F.lpad(first_month.cast("string"), 2, "0"), F.lit("-01")))
    pair = lambda a, b: F.struct(a.cast("string").alias("first"), b.cast("string").alias("last"))
    given = pair(start, end) if start is not None and end is not None else pair(period, period)
    has_given = (start.isNotNull() & end.isNotNull()) if start is not None and end is not None else F.lit(False)
    out = F.when(period.rlike(r"^CY\d{4}(Q[1-4])?I$"), F.lit(None))
    out = out.when(period.rlike(r"^CY\d{4}Q[1-4]$"), pair(quarter_start, F.last_day(F.add_months(quarter_start, 2))))
    out = out.when(period.rlike(r"^CY\d{4}$"), pair(F.concat(year, F.lit("-01-01")), F.concat(year, F.lit("-12-31"))))
    out = out.when(period.contains(".."), pair(F.split_part(period, F.lit(".."), F.lit(1)), F.split_part(period, F.lit(".."), F.lit(2))))
    return out.when(has_given, given).when(period.isNotNull() & (period != ""), pair(period, period))


def base_label(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)\s*$", "")))


def unit_of_name(c: Column) -> Column:
    """The text of a trailing parenthesis, or null."""
    return F.nullif(F.trim(F.regexp_extract(c, r"\(([^)]+)\)\s*$", 1)), F.lit(""))


def strength_magnitude(c: Column) -> Column:
    return canonical_number(F.nullif(F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*(MG|MCG|G|ML|IU|UNITS?|%)", 1), F.lit("")))


def strength_unit(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*(MG|MCG|G|ML|IU|UNITS?|%)", 2)), F.lit(""))


def format_value(v: Column) -> Column:
    """Thousands separators, no exponent; up to six decimals without trailing zeros."""
    return F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.regexp_replace(F.format_number(v, 6), r"\.?0+$", ""))


def tolerance(v: Column, decimals: Column) -> Column:
    """Half of the last place that is shown."""
    return F.when(decimals.isNotNull(), 0.5 * F.pow(F.lit(10.0), -decimals)).when(v == F.floor(v), 0.5).otherwise(5e-7)


def length_label(n: Column) -> Column:
    return F.when(n % 1024 == 0, F.concat((n / 1024).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def close(a: Column, b: Column, rel: float = 0.05) -> Column:
    """Within rel of b; only zero is near zero; null is near nothing."""
    return F.coalesce(F.when(b == 0, a == 0).otherwise(F.abs(a - b) / F.abs(b) <= rel), F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-12 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def epoch_days(c: Column) -> Column:
    """Days since 1970 of YYYY-MM-DD or YYYY-MM (its first day); else null."""
    return F.datediff(F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)), F.lit("1970-01-01").cast("date"))


def token_count(c: Column) -> Column:
    """Pieces are runs of word characters or single marks; each costs a quarter of its length, one at least."""
    return F.aggregate(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(1), F.floor(F.char_length(x) / 4)))


def log2_tokens(n: Column) -> Column:
    """The logarithm to base 2 of a number of tokens; null where there are none."""
    return F.when(n > 0, F.log2(n.cast("double")))


def family_number(family_id: Column) -> Column:
    """The number at the end of an id such as SEC_0012, or null."""
    return F.substring_index(family_id, "_", -1).try_cast("int")


def count_tokens(text: str | None) -> int:
    """token_count of one text, for code that runs within a group."""
    import regex

    return sum(max(1, len(x) // 4) for x in regex.findall(TOKEN.removeprefix("(?U)"), text or ""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def to_number(c: Column) -> Column:
    """Commas, a leading dollar and a trailing percent sign do not count."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(F.trim(c), F.lit(","), F.lit("")), r"^\$", ""), r"%$", "")
    return once(plain, lambda p: F.when(p.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), p.try_cast("double")))


def to_date(c: Column) -> Column:
    t = F.trim(c)
    tries = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date")) for p, f in (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"))]
    return F.coalesce(*tries, F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date")), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(t).cast("date")))


def parse_answer_line(c: Column) -> Column:
    """What follows ANSWER: at the start of an output; null if there is none or it is empty."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^\s*ANSWER:\s*(.*?)\s*$", 1)), F.lit(""))


def normalize_answer(value: Column, kind: Column) -> Column:
    """(kind, num, txt): numbers for numeric kinds, ISO days for dates, else the normalised text. Percents keep their scale."""
    numeric = kind.isin("NUMERIC", "PERCENT", "INTEGER")

    def named(norm: Column) -> Column:
        insufficient = norm == INSUFFICIENT
        num = F.when(numeric & ~insufficient, to_number(value))
        txt = F.when(insufficient, F.lit(INSUFFICIENT)).when(numeric, F.lit(None)).when(kind == "DATE", F.coalesce(to_date(value).cast("string"), norm)).otherwise(norm)
        return F.struct(F.when(insufficient, F.lit("INSUFFICIENT_EVIDENCE")).otherwise(kind).alias("kind"), num.alias("num"), txt.alias("txt"))

    return once(norm_text(value), named)


def answers_equal(model: Column, gold: Column, kind: Column, tol: Column) -> Column:
    """Insufficient evidence matches itself alone; numbers match within the absolute tolerance; else texts are equal."""
    either = (F.coalesce(model["txt"], F.lit("")) == INSUFFICIENT) | (F.coalesce(gold["txt"], F.lit("")) == INSUFFICIENT)
    by_number = F.abs(model["num"] - gold["num"]) <= F.coalesce(tol, F.lit(0.0))
    return F.coalesce(F.when(either, model["txt"] == gold["txt"]).when(kind.isin("NUMERIC", "PERCENT", "INTEGER"), by_number).otherwise(model["txt"] == gold["txt"]), F.lit(False))


def render_record(display: Column, fields: list[tuple[str, Column]], extra: list[tuple[str, Column]]) -> Column:
    """A RECORD block: the fields that are there, then at most four of the extra ones, in order."""
    line = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(name + ": "), c.cast("string")))
    more = F.slice(F.filter(F.array(*[line(n, c) for n, c in extra]), lambda x: x.isNotNull()), 1, 4) if extra else F.array().cast("array<string>")
    body = F.array_join(F.concat(F.filter(F.array(*[line(n, c) for n, c in fields]), lambda x: x.isNotNull()), more), "\n")
    return F.concat(F.lit('<RECORD id="'), display, F.lit('">\n'), body, F.lit("\n</RECORD>"))


def parse_records(context: Column) -> Column:
    """Array of (display_id, fields map) of the RECORD blocks of a context, in order."""
    block = r'(?s)<RECORD id="([^"]+)"[^>]*>(.*?)</RECORD>'
    ids, bodies = F.regexp_extract_all(context, F.lit(block), F.lit(1)), F.regexp_extract_all(context, F.lit(block), F.lit(2))

    def fields(body: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x).rlike(r"^[^:]+:"))
        pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(F.trim(x), F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_replace(F.trim(x), r"^[^:]+:\s*", "")).alias("value")))
        first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
        return F.map_from_entries(first)

    return F.transform(F.arrays_zip(ids.alias("a"), bodies.alias("b")), lambda x: F.struct(x["a"].alias("display_id"), fields(x["b"]).alias("fields")))


# Wordings that give away whether a question has an answer.
LEAK_PATTERNS = (
    r"(?i)\bif\b.{0,80}\b(?:do|does|did|contain|list|include|provide|available|missing)",
    r"(?i)\binsufficient[_ -]evidence\b",
    r"(?i)\bif\s+(?:unavailable|missing)\b",
    r"(?i)\bdo not infer\b",
    r"(?i)\bdo not fabricate\b",
    r"(?i)\brather than\b",
    r"(?i)\bcannot be determined\b",
    r"(?i)\bfrom another (?:date|trial|product|series|record|concept)\b",
)


def leaks(question: Column) -> Column:
    """The numbers (from 0) of the leak patterns that a question matches."""
    found = F.array(*[F.when(question.rlike(p), F.lit(i)) for i, p in enumerate(LEAK_PATTERNS)])
    return F.filter(found, lambda x: x.isNotNull())


def failure_class(message: Column, is_value_error: Column) -> Column:
    """The class of a run's failure by its message."""
    m = F.lower(message)
    memory = m.contains("out of memory")
    return F.when(m.contains("cuda") & memory, "CUDA_OOM").when(memory | m.contains("cannot allocate memory"), "CPU_OOM").when(is_value_error & m.contains("token"), "TOKEN_BUDGET_FAILURE").otherwise("GENERATION_ERROR")


def python_round(c: Column, decimals: int) -> Column:
    """Rounding of the binary value, halves to even, as Python does; a pandas UDF, for results that must agree with it."""
    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else round(v, decimals))

    return rounded(c)


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def interval_text(low: Column, high: Column) -> Column:
    return F.format_string("[%.2f, %.2f]", low, high)
