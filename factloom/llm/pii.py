"""Personal data in whole texts: candidates of high recall, boosted trees over their form and context, calibrated thresholds.

Base spans follow four fixed rules (email, ip, card, phone) and always count. Beside them, generators propose overlapping spans of
five more kinds: e-mail addresses written out, phone numbers without a country code, IBANs, US social security numbers,
IPv6 addresses. Boosted trees, trained here, score each candidate by what it looks like and what stands around it; a
logistic curve turns scores into probabilities, and a candidate is reported where its own kind's threshold is met, the
likeliest first where candidates overlap, and never across a base span. Spans are in code points, end exclusive.

The trees are fitted on the driver from EXAMPLES labelled candidates: numbers and addresses made by rule, and look-alikes
(dates, times, prices, versions, order numbers, tables), set into excerpts of a sample of at most SAMPLE rows of the corpus, EXCERPTS
of each. A quarter of them is kept for calibration: thresholds are the least ones of precision PRECISION on it.

Null texts count as empty and have no spans; very long texts are searched whole, in time linear in their length; repeated
rows give repeated results; an empty table fits the trees on excerpts of words made up and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices
from factloom.llm.secret_scan import _sql_matches

BASE = ("email", "ip", "card", "phone")
MORE = ("email_written", "phone_local", "iban", "ssn", "ip6")
KINDS = BASE + MORE
SAMPLE, EXCERPTS, EXCERPT, EXAMPLES, PRECISION = 400, 8, 160, 6000, 0.97

# Base rules. Possessive runs never give back, and addresses are tried at starts of runs only, so long runs take linear time.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]+")

# Generators of further candidates.
WRITTEN = re.compile(r" ?(?:[\[({<] ?(?i:at) ?[\])}>]|(?<= )(?i:at)(?= )) ?([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?i:dot) ?[\])}>] ?| (?i:dot) )[A-Za-z0-9-]{1,63}){1,6})")
GROUPS = re.compile(r"[(0-9][0-9]{0,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?")
IP6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{0,4}")

# What stands near personal data, and near look-alikes.
HINTS = {
    "email_written": ("mail", "contact", "write", "kontakt", "correo", "courriel", "schreib", "contacto"),
    "phone_local": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "llame", "appelez", "anruf", "handy", "móvil"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "transfer"),
    "ssn": ("ssn", "social security", "security number", "tax id"),
    "ip6": ("ip", "host", "server", "address", "adresse", "client", "ipv6"),
}
AGAINST = ("version", "page", "isbn", "order", "invoice", "date", "chapter", "price", "total", "score", "serial", "table", "build", "ratio", "seite", "página", "mac", "time")

_word = lambda words: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")s?\b")
HINTED, AGAINST_IT = [_word(w) for w in HINTS.values()], _word(AGAINST)
UNIT = re.compile(r" ?(?:[€$£%]|k[mg]\b|eur\b|usd\b)")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base rule that meet its condition, by start and kind."""
    out = []
    if "@" in text:
        free = 0  # a local part reaches no further back than this
        for m in HOST.finditer(text):
            at = m.start()
            gap = text.rfind("@", free, at) + 1 or free
            start = gap + len(text[gap:at].rstrip(LOCAL))
            if start < at:
                out.append(Span("email", start, m.end()))
                free = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append(Span("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(Span("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(Span("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def proposals(text: str) -> Iterator[Span]:
    """Candidates of the further kinds; they may overlap."""
    apart = lambda s, e: not (s and text[s - 1].isalnum()) and not text[e : e + 1].isalnum()
    if "dot" in (low := text.lower()) or "at]" in low or "at)" in low or "at}" in low or "at>" in low or " at " in low:
        free = 0
        for m in WRITTEN.finditer(text):
            start = m.start() - len(part) + len(part.rstrip(LOCAL)) if (part := text[max(free, m.start() - 64) : m.start()]) else m.start()
            if start < m.start():
                yield Span("email_written", start, m.end())
                free = m.end()
    if not DIGIT.search(text):
        return
    for m in GROUPS.finditer(text):
        s, e = m.span()
        n = len(NOT_DIGIT.sub("", m[0]))
        if 7 <= n <= 15 and apart(s, e):
            yield Span("phone_local", s, e)
            if text[s] == "(" and ")" not in text[s:e]:
                yield Span("phone_local", s + 1, e)
            if n == 9:
                yield Span("ssn", s, e)
    for m in IBAN.finditer(text):
        if apart(*m.span()):
            yield Span("iban", *m.span())
    if ":" in text:
        for m in IP6.finditer(text):
            s, e = m.span()
            e -= text[e - 1] == ":" and text[e - 2] != ":"
            if apart(s, e):
                yield Span("ip6", s, e)


def _letters(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return moved.isascii() and moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """What a candidate looks like, and what stands around it."""
    s, e = span.start, span.end
    own, before, after = text[s:e], text[max(0, s - 40) : s].lower(), text[e : e + 25].lower()
    digits = NOT_DIGIT.sub("", own)
    groups = [len(g) for g in NOT_DIGIT.split(own) if g] or [0]
    marks = [c for c in own if not c.isalnum()]
    near = text[max(0, s - 30) : s] + text[e : e + 30]
    numbers = [int(g) for g in NOT_DIGIT.split(own) if g and len(g) <= 5]
    year = any(1000 <= v <= 2100 for v in numbers)
    calendar = len(numbers) == 3 and len(groups) == 3 and year and sum(v <= 31 for v in numbers) >= 2
    hint = [bool(words.search(before) or words.search(after)) for words in HINTED]
    parts = own.split(":")
    return [
        *[float(span.kind == k) for k in MORE], len(own), len(digits), sum(c.isalpha() for c in own), len(marks), len(set(marks)), len(groups), groups[0], groups[-1], min(groups), max(groups),
        "(" in own, "." in marks, "-" in marks, "/" in marks, " " in marks, ":" in marks, luhn(digits) if digits else 0, span.kind == "iban" and mod97(own.replace(" ", "")), len(set(digits)),
        _letters(text[s - 1 : s]), _letters(text[e : e + 1]), text[s - 1 : s] in tuple("$€£#§.-/:,=_+"), text[e : e + 1] in tuple("%€$°:-/_="), hint[MORE.index(span.kind)], any(hint), bool(AGAINST_IT.search(before)), bool(UNIT.match(after)), calendar, year,
        sum(c.isdigit() for c in near) / max(1, len(near)), len(parts), max(map(len, parts)), min(map(len, parts)), "::" in own, own[:1] == "0", digits[:1] in ("9", "0"), digits[:3] in ("000", "666"), own.lower().count("dot"),
        any(c in "[({<" for c in own), own.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "eu"), digits[3:5] == "00", digits[-4:] == "0000", float(sum(groups[:-1]) == 5 and groups[0] == 3),
    ]


class Boosted(NamedTuple):
    """Trees of one depth (feature and limit of each inner node, value of each leaf), the curve, and thresholds by kind."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float
    slope: float
    shift: float
    threshold: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):  # all leaves lie at one depth
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> Boosted:
    """Trees on the logistic loss by second-order gains over binned features; not calibrated yet."""
    limits = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(limits)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = y - p, np.maximum(p * (1 - p), 1e-6), np.zeros(len(y), np.int64)
        for d in range(depth):
            first = 2**d - 1
            for n in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == n)
                gs, hs, best = g[rows].sum(), h[rows].sum(), 1e-6
                for k, c in enumerate(limits):
                    if not len(c) or len(rows) < 2:
                        continue
                    gl, hl = (np.bincount(binned[rows, k], w, len(c) + 1).cumsum()[:-1] for w in (g[rows], h[rows]))
                    gain = np.where((hl >= least) & (hs - hl >= least), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                    if gain.max() > best:
                        best, features[t, n], cuts[t, n] = gain.max(), k, c[gain.argmax()]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[t][node]] > cuts[t][node])
        for n in range(leaves):
            own = node == inner + n
            values[t, n] = rate * g[own].sum() / (h[own].sum() + 1)
        margin += values[t][node - inner]
    return Boosted(features, cuts, values, start, 1.0, 0.0, {})


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, kinds: list[str], precision: float) -> Boosted:
    """A logistic curve over the margins by Newton's method, then each kind's least threshold of that precision."""
    m, a, b = model.margin(x), 1.0, 0.0
    design = np.stack([m, np.ones(len(m))], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * np.array([a - 1, b]))
        a, b = a + step[0], b + step[1]
    model, thresholds, of = model._replace(slope=float(a), shift=float(b)), {}, np.array(kinds)
    p = model.probability(x)
    for kind in MORE:
        own = of == kind
        order = np.argsort(-p[own], kind="stable")
        good = np.flatnonzero((np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)) >= precision) if own.any() else np.zeros(0, int)
        thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 0.99
    return model._replace(threshold=thresholds)


def _made(rng: random.Random) -> tuple[str | None, str]:
    """(kind, or None for a look-alike; text) of an example."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    hexes = lambda n: [f"{rng.randrange(65536):x}" for _ in range(n)]
    sep = rng.choice(" .-")

    def iban(good: bool) -> str:
        bban = "".join(rng.choice("0123456789" if rng.random() < 0.8 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(11, 26)))
        land = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT", "CH", "AT"])
        check = (98 - int("".join(str(int(c, 36)) for c in bban + land + "00")) % 97 + (0 if good else rng.randint(1, 40))) % 100
        text = f"{land}{check:02d}{bban}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.5 else text

    at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", " dot "), ("{at}", "{dot}"), (" (at) ", ".")])
    ssn = f"{rng.choice([v for v in range(1, 900) if v != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    return rng.choice([
        lambda: ("phone_local", f"({rng.randint(200, 999)}) {d(3)}-{d(4)}"), lambda: ("phone_local", f"{rng.randint(200, 999)}{sep}{d(3)}{sep}{d(4)}"), lambda: ("phone_local", "0" + sep.join([rng.choice("1234567"), d(2), d(2), d(2), d(2)])),
        lambda: ("phone_local", f"0{rng.randint(30, 999)}{rng.choice(' /-')}{d(3)} {d(rng.randint(3, 5))}"), lambda: ("phone_local", f"{rng.choice('6789')}{d(2)} {d(3)} {d(3)}"),
        lambda: ("ssn", ssn), lambda: ("ssn", ssn), lambda: ("iban", iban(True)), lambda: ("iban", iban(True)), lambda: ("email_written", f"{word()}{rng.choice(['', '.' + word(), d(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co'])}"),
        lambda: ("email_written", f"{word()}{at}{word()}{dot}{word()}{dot}{rng.choice(['com', 'org', 'de'])}"), lambda: ("ip6", ":".join(hexes(8))), lambda: ("ip6", "2001:" + ":".join(hexes(rng.randint(1, 3))) + "::" + ":".join(hexes(rng.randint(1, 2)))), lambda: ("ip6", "fe80::" + ":".join(hexes(4))),
        lambda: (None, f"{rng.randint(1900, 2030)}{sep}{rng.randint(1, 12):02d}{sep}{rng.randint(1, 28):02d}"), lambda: (None, f"{rng.randint(1, 28)}{rng.choice('./-')}{rng.randint(1, 12)}{rng.choice('./-')}{rng.randint(1900, 2030)}"),
        lambda: (None, f"{rng.randint(1900, 2000)}-{rng.randint(2001, 2030)}"), lambda: (None, f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}"), lambda: (None, f"{rng.choice('$€')}{rng.randint(1, 999)}.{d(3)}.{d(3)}"),
        lambda: (None, " ".join([str(rng.randint(1, 999)), d(3), d(3)]) + rng.choice([" €", " $", "%", " km"])), lambda: (None, f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"), lambda: (None, f"{d(4)}-{d(4)}-{d(2)}"), lambda: (None, ":".join(f"{rng.randrange(256):02X}" for _ in range(6))),
        lambda: (None, iban(False)), lambda: (None, " ".join(d(rng.randint(2, 5)) for _ in range(rng.randint(4, 9)))), lambda: (None, f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}"), lambda: (None, f"{d(3)}-00-{d(4)}"),
        lambda: (None, f"{rng.choice(['look', 'meet', 'arrive', 'stay'])} at {word()} dot {word()} {word()}"), lambda: (None, f"{word()} at {word()}.{word()}"), lambda: (None, f"{rng.randint(1, 9)}.{d(2)}.{d(3)}.{d(2)}-{d(2)}"), lambda: (None, f"{word()} {d(2)}:{d(1)}:{d(2)}:{d(2)}"),
    ])()


def examples(excerpts: list[str], n: int = EXAMPLES, seed: int = 11) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(features, labels, kinds) of at least n candidates that the generators propose in excerpts with one example set in."""
    rng, xs, ys, kinds = random.Random(seed), [], [], []
    hints = [w for words in HINTS.values() for w in words]
    while len(ys) < n:
        kind, made = _made(rng)
        own = HINTS[kind] if kind else rng.choice(list(HINTS.values()))
        lead = rng.choice(own) + rng.choice([": ", " ", " - "]) if rng.random() < (0.45 if kind else 0.06) else rng.choice(AGAINST) + rng.choice([": ", " ", " "]) if rng.random() < (0.04 if kind else 0.35) else rng.choice(hints) + " " if rng.random() < 0.03 else ""
        left, right = rng.choice(excerpts) if excerpts else "", rng.choice(excerpts) if excerpts else ""
        before = (left + " " if left else "") + lead
        text = before + made + rng.choice([" ", ", ", ". ", "\n", "; "]) + right
        good = Span(kind, len(before), len(before) + len(made)) if kind else None
        for span in dict.fromkeys(proposals(text)):
            xs.append(features(text, span))
            ys.append(float(span == good))
            kinds.append(span.kind)
    return np.array(xs, np.float64), np.array(ys), kinds


def excerpts(docs: DataFrame, sample: int = SAMPLE, each: int = EXCERPTS, length: int = EXCERPT) -> list[str]:
    """each excerpts of at most length characters of at most sample rows, chosen by hash. Only rows below a line, about four
    times as many as the sample takes, reach the choice, so tasks of a large table send a few rows each."""
    size, h = F.char_length("text"), F.xxhash64("doc_id", "text")
    line = 4 * sample / max(1, docs.count())
    docs = docs if line >= 1 else docs.filter(h <= F.lit(int((2 * line - 1) * 2.0**63)))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(size - length, F.lit(1)).cast("long")).cast("int")
    cut = docs.filter(size > 0).select(h.alias("h"), F.array(*[F.substring("text", at(k) + 1, F.lit(length)) for k in range(each)]).alias("some"))
    return [x for r in cut.orderBy("h", "some").limit(sample).select("some").collect() for x in r.some]


def fit(docs: DataFrame, precision: float = PRECISION, n: int = EXAMPLES, seed: int = 11) -> Boosted:
    """The boosted trees, fitted on n candidates in excerpts of docs (doc_id, text); see the module's docstring for the bounds."""
    found = excerpts(docs)
    x, y, kinds = examples(found, n, seed)
    held = np.array([int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 4 == 0 for i in range(len(y))])
    return calibrate(boost(x[~held], y[~held]), x[held], y[held], [k for k, own in zip(kinds, held) if own], precision)


def further_spans(text: str, base: list[Span], model: Boosted) -> list[tuple[Span, float]]:
    """Candidates at or above their kind's threshold, the likeliest first where they overlap, none across a base span."""
    found = list(dict.fromkeys(proposals(text)))
    if not found:
        return []
    out, taken = [], bytearray(len(text))
    for s in base:
        taken[s.start : s.end] = b"\x01" * (s.end - s.start)
    found = [s for s in found if not any(taken[s.start : s.end])]
    if not found:
        return []
    p = model.probability(np.array([features(text, s) for s in found], np.float64))
    for k in np.lexsort(([s.start for s in found], -p)):
        s = found[k]
        if p[k] >= model.threshold[s.kind] and not any(taken[s.start : s.end]):
            taken[s.start : s.end] = b"\x01" * (s.end - s.start)
            out.append((s, float(p[k])))
    return sorted(out)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame, model: Boosted, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id, text left out), base and more: spans in order of start and kind. score is 1 for base spans."""
    names = [c for c in (keep or ["doc_id"]) if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        model = shared.value
        row = lambda s, p: {"kind": s.kind, "start": s.start, "end": s.end, "score": p}
        for batch in slices(batches):
            first, second = [], []
            for text in batch.column(len(names)).to_pylist():
                base = base_spans(text)
                first.append([row(s, 1.0) for s in base])
                second.append([row(s, p) for s, p in further_spans(text, base, model)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(first, kind), pa.array(second, kind)], [*names, "base", "more"])

    kept = docs.select(*[F.col(c) for c in names], F.coalesce("text", F.lit("")).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}base {SPANS}, more {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans by start and kind."""
    found = detect(docs, model or fit(docs))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    rank = F.array(*map(F.lit, KINDS))
    key = lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    ordered = F.array_sort(F.transform(F.concat("base", "more"), key))
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(ordered).alias("spans"))


@lru_cache(maxsize=1)
def _masks() -> dict[str, str]:
    return {k: f"[{k.upper()}]" for k in KINDS}


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets; of overlapping spans the first one's. Other columns stay."""
    model = model or fit(docs)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        base, at, out = base_spans(text), 0, []
        for s in sorted([*base, *[s for s, _ in further_spans(text, base, shared.value)]], key=lambda s: s.start):
            if s.start >= at:
                out += [text[at : s.start], _masks()[s.kind]]
            at = max(at, s.end)
        return "".join(out) + text[at:] if out else text

    def run(batches):
        for batch in slices(batches):
            columns = list(batch.columns)
            columns[place] = pa.array([masked(t) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def base_report(docs: DataFrame) -> DataFrame:
    """What SQL can express of report: the counts and the digest of base spans."""
    return report(docs).drop("spans")


def _sql() -> str:
    local = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"
    more = [_sql_matches("email", local), _sql_matches("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), _sql_matches("card", r"[0-9]([\x20-]?[0-9])+"), _sql_matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    digits = "regexp_replace(found, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE 2 * reverse({digits})[i]::INT - CASE WHEN reverse({digits})[i]::INT > 4 THEN 9 ELSE 0 END END))"
    union = f"""SELECT n, s, 0 AS k, s + size AS e FROM email
UNION ALL SELECT n, s, 1, s + size FROM ip WHERE len(list_filter(string_split(found, '.'), lambda x: try_cast(x AS HUGEINT) IS NULL OR x::HUGEINT > 255)) = 0
UNION ALL SELECT n, s, 2, s + size FROM card WHERE length({digits}) BETWEEN 12 AND 19 AND {luhn_sum} % 10 = 0
UNION ALL SELECT n, s, 3, s + size FROM phone WHERE length({digits}) BETWEEN 9 AND 15"""
    counts = ", ".join(f"count_if(k = {i}) AS n_{k}" for i, k in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents), {','.join(more)},
a AS ({union}),
j AS (SELECT n, {counts}, string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS base FROM a GROUP BY n)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN j USING (n)"""


BASE_SQL = _sql()
