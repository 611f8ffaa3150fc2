"""Language identification by interpolated Kneser-Ney character models, one for each language.

Fitting takes at most SAMPLE + CALIBRATION rows of each language (a documented bound: whole texts, chosen by a hash of their
ids) and counts all their character n-grams in Spark. The counts come to the driver and the model goes to every worker:
both grow with the distinct n-grams of those rows, and the model by 4 bytes for each of them and each language, not with
the corpus. Discounts, estimated from the n-grams seen once and twice, and continuation counts give every language a probability for every
n-gram that any language has; the tables of each order are arrays sorted by the n-gram's hash, with a column for each
language, and unseen n-grams fall back to the next order through the weight of their history. A text's language is that
of the lowest cross-entropy per character; a part of the labelled rows that is left out of the counts calibrates the
softmax of the scores and the cross-entropy above which a text is rejected as no known language: MARGIN times what all but
1 - QUANTILE of the held-out texts have in their own language.

Texts are lower-cased, runs of all but letters are one blank. Null texts and texts without a letter are `und` with score
0 and rejected; very long texts are scored whole. Empty tables, or no labelled rows, give `und` throughout. Ties go to the smaller language name. Repeated
rows are learned and predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import blocks, slices

ORDER, SAMPLE, CALIBRATION = 4, 1500, 400
QUANTILE, MARGIN = 0.99, 1.25
#: Tables of at most this many languages are broadcast.
FEW_LANGUAGES = 10_000
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def codes_of(text: str) -> np.ndarray:
    """Code points of the letters in lower case, single blanks between words and at both ends."""
    return np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32)


def packed(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash for each run of order code points; exact (no collisions) up to three, mixed beyond."""
    n = max(0, len(codes) - order + 1)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = (out * np.uint64(1 << 21)) + codes[k : k + n] if order <= 3 else (out ^ (out >> np.uint64(31))) * MULTIPLY + codes[k : k + n]
    return out


@dataclass
class Model:
    languages: list[str]
    #: For orders 1 to ORDER: sorted hashes, log probabilities (rows by n-gram, columns by language).
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    #: For orders 2 to ORDER: sorted hashes of histories, log weights of the next lower order.
    histories: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: float = 0.0
    scale: float = 20.0
    reject_above: float = np.inf

    def log_probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability, for each language, of each code from the order-th on, given the order - 1 before it."""
        hashes = packed(codes, order)
        known, table = self.grams[order - 1], self.logp[order - 1]
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        out = table[at] if len(known) else np.zeros((len(hashes), len(self.languages)), np.float32)
        if (miss := np.flatnonzero(~hit)).size:
            out[miss] = self._rows(codes[miss[:, None] + np.arange(order)], order)
        return out

    def _rows(self, windows: np.ndarray, order: int) -> np.ndarray:
        """As log_probabilities, for rows of order codes."""
        hashes = packed_rows(windows, order)
        known, table = self.grams[order - 1], self.logp[order - 1]
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        out = table[at].copy() if len(known) else np.zeros((len(hashes), len(self.languages)), np.float32)
        if (miss := np.flatnonzero(~hit)).size:
            if order == 1:
                out[miss] = self.unseen
            else:
                before = packed_rows(windows[miss, : order - 1], order - 1)
                h, b = self.histories[order - 2], self.backoff[order - 2]
                place = np.minimum(np.searchsorted(h, before), max(0, len(h) - 1))
                weight = np.where((h[place] == before)[:, None], b[place], np.float32(0)) if len(h) else np.float32(0)
                out[miss] = self._rows(windows[miss, 1:], order - 1) + weight
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character for each text and language, number of characters scored; 0: no letter)."""
        ce, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, j in blocks(texts, 1 << 18):
            rows = [k for k in range(i, j) if texts[k] is not None]
            codes = [codes_of(texts[k]) for k in rows]
            some = [(k, c) for k, c in zip(rows, codes) if _LETTER.search(texts[k])]
            if not some:
                continue
            ends = np.cumsum([len(c) + ORDER - 1 for _, c in some])
            joined = np.concatenate([x for _, c in some for x in (np.full(ORDER - 1, 32, np.uint32), c)])
            n = np.array([len(c) for _, c in some])
            logs = np.concatenate([[np.zeros(len(self.languages))], np.cumsum(self.log_probabilities(joined), axis=0, dtype=np.float64)])
            first = ends - n - (ORDER - 1)  # of each text's windows
            ks = [k for k, _ in some]
            ce[ks], size[ks] = -(logs[first + n] - logs[first]) / n[:, None], n
        return ce, size

    def scores(self, ce: np.ndarray) -> np.ndarray:
        low = ce.min(axis=1, keepdims=True)
        e = np.exp(-(ce - low) * self.scale)
        return e.max(axis=1) / e.sum(axis=1)


def packed_rows(rows: np.ndarray, order: int) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(order):
        out = (out * np.uint64(1 << 21)) + rows[:, k] if order <= 3 else (out ^ (out >> np.uint64(31))) * MULTIPLY + rows[:, k]
    return out


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram (ORDER code points as one string), n: summed in the worker for each batch, then by Spark."""

    def run(batches):
        for batch in slices(batches):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.concatenate([np.full(ORDER - 1, 32, np.uint32), codes_of(text or "")])
                by.setdefault(lang, []).append(np.lib.stride_tricks.sliding_window_view(codes, ORDER))
            for lang, parts in by.items():
                rows = np.ascontiguousarray(np.concatenate(parts)).view([("", np.uint32)] * ORDER).ravel()
                grams, n = np.unique(rows, return_counts=True)
                flat = grams.view(np.uint32).tobytes().decode("utf-32-le")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]), pa.array(n)], ["lang", "gram", "n"])

    return labelled.select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(c: np.ndarray) -> np.ndarray:
    """The absolute discount of each language (a column of counts), from how many n-grams it has once and twice."""
    once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
    return np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)


def fit(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """docs: doc_id, text, lang (non-null). At most sample rows of each language are counted and calibration others
    set the scale and the rejection limit; ids choose them by hash, so the same rows are taken at every run."""
    order = F.xxhash64(F.lit("language-id"), F.col("doc_id"))
    top = Window.partitionBy("lang").orderBy("h", "doc_id")
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", order.alias("h"))
    # Hashes below a line that leaves twice the rows wanted; only those are ranked, so no task gets a language's texts.
    lines = labelled.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(float(1 << 20)) * 2 * (sample + calibration) / F.col("n")).alias("line"))
    few = labelled.join(F.broadcast(lines) if lines.count() <= FEW_LANGUAGES else lines, "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("line"))
    ids = few.select("lang", "text", F.row_number().over(top).alias("k")).filter(F.col("k") <= sample + calibration)
    chosen = ids.repartition("lang", F.col("k") % 16).persist()
    try:
        share = F.col("k") % 5 == 0  # a fifth at most is left out of the counts
        counts = count_grams(chosen.filter(~share)).toPandas()  # the n-grams of at most sample rows a language
        model = kneser_ney(counts)
        if model.languages:
            calibrate(model, chosen.filter(share).select("text", "lang"), calibration)
        return model
    finally:
        chosen.unpersist()


def kneser_ney(counts) -> Model:
    """The model of a table lang, gram, n of ORDER-gram counts."""
    languages = sorted(counts["lang"].unique().tolist())
    model = Model(languages)
    if not languages:
        return model
    grams = [str(g) for g in counts["gram"]]
    rows = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    lang = np.searchsorted(languages, counts["lang"].to_numpy().astype(str)) if len(rows) else np.zeros(0, np.int64)
    weight = counts["n"].to_numpy(np.float64)
    levels = []
    for order in range(ORDER, 0, -1):
        part = rows[:, ORDER - order :]
        hashes = packed_rows(part, order)
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if order == ORDER:
            c = np.zeros((len(own), len(languages)))
            np.add.at(c, (back, lang), weight)
        else:  # in how many contexts a language has it: distinct n-grams one longer that end in it
            longer, c = levels[-1], np.zeros((len(own), len(languages)))
            np.add.at(c, back[longer["first"]], (longer["c"] > 0).astype(np.float64))
        levels.append({"order": order, "own": own, "first": first, "rows": part[first], "c": c})
    levels.reverse()
    n_letters = max(1, len(levels[0]["own"]))
    model.unseen = float(np.log(1.0 / (n_letters + 1)))
    for level in levels:
        order, c = level["order"], level["c"]
        less = discount(c)
        if order == 1:
            total, kinds = c.sum(axis=0), (c > 0).sum(axis=0)
            p = (np.maximum(c - less, 0) + less * np.maximum(kinds, 1) / (n_letters + 1)) / np.maximum(total, 1)
            model.unseen = float(np.log(np.min((less * kinds / np.maximum(total, 1))) / (n_letters + 1) + 1e-12))
        else:
            before = packed_rows(level["rows"][:, : order - 1], order - 1)
            h, back = np.unique(before, return_inverse=True)
            total, kinds = np.zeros((len(h), len(languages))), np.zeros((len(h), len(languages)))
            np.add.at(total, back, c)
            np.add.at(kinds, back, (c > 0).astype(np.float64))
            lam = np.where(total > 0, less * kinds / np.maximum(total, 1), 1.0)
            lower = np.exp(model._rows(level["rows"][:, 1:], order - 1).astype(np.float64))
            p = np.where(total[back] > 0, np.maximum(c - less, 0) / np.maximum(total[back], 1), 0.0) + lam[back] * lower
            model.histories.append(h)
            model.backoff.append(np.log(lam).astype(np.float32))
        model.grams.append(level["own"])
        model.logp.append(np.log(p).astype(np.float32))
    return model


def calibrate(model: Model, held: DataFrame, most: int) -> None:
    """Scale of the softmax (least log loss over a fixed grid) and the rejection limit. Only numbers for each held-out text
    come to the driver."""
    shared, languages = model, model.languages

    def run(batches):
        for batch in batches:
            ce, size = shared.cross_entropies(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(ce), pa.list_(pa.float64())), pa.array(size)], ["lang", "ce", "size"])

    got = held.mapInArrow(run, "lang string, ce array<double>, size long").filter("size > 0").toPandas()
    if not len(got):
        return
    ce, own = np.stack(got["ce"].to_numpy()), np.array([languages.index(x) if x in languages else -1 for x in got["lang"]])
    ce, own = ce[own >= 0], own[own >= 0]
    if not len(own):
        return

    def loss(scale: float) -> float:
        z = -ce * scale
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), own]))

    model.scale = min((1, 2, 5, 10, 20, 50, 100), key=loss)
    model.reject_above = float(np.quantile(ce[np.arange(len(own)), own], QUANTILE) * MARGIN)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id, and whatever else), lang_pred, score, cross_entropy (bits per character), rejected."""
    keep = keep or ["doc_id"]
    source = docs.select(*keep, F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # see above: bounded by the rows fitted on

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if m.languages:
                ce, size = m.cross_entropies(texts)
                best, score = ce.argmin(axis=1), np.where(size > 0, m.scores(ce), 0.0)
                name = [m.languages[b] if n else "und" for b, n in zip(best, size)]
                low = ce[np.arange(len(best)), best]
                rejected = (size == 0) | (low > m.reject_above)
            else:
                name, score, low, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(low / np.log(2), pa.float64()), pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{types}, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(doc_id) -> "F.Column":
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
