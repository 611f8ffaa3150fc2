"""Scoring texts by context-tree weighting, learned from a part of the corpus and frozen.

A text is its UTF-8 bytes, A-Z in lower case, and an end symbol (255). Every byte is eight binary decisions; each
decision (a node of the byte's binary tree) has a tree of contexts: nothing, the last byte, the last two, and so on
to the last DEPTH. A context's Krichevsky-Trofimov probability Pe of the training decisions and its children's weighted
probabilities Pw mix by halves, Pw = (Pe + product of the children's Pw) / 2, and a new decision has the probability
(b * KT + child's) / (b + 1) with b = Pe / product: all depths take part, as the training data support them. A context
never seen gives 1/2. The sum over a text of log10 of its decisions is its score.

Counting: strings of DEPTH + 1 bytes and words, summed by Spark. Levels of three context bytes and more stay spread, by
their last three, and are read group by group, so a task holds CHUNK strings or one group. The upper levels come to the
driver and go to every worker: in UTF-8 with A-Z lowered they have at most 5.6 million nodes of 28 bytes, whatever the
corpus. Scoring: the most frequent words (of at most HOT_BYTES) and strings (at most HOT_WORDS and HOT_GRAMS) go to every worker; all others are
looked up by a join.

Null and empty texts score their end symbol alone; a very long text is a block of its own. A null id counts as not held out. Repeated rows are learned and scored
each on its own; extra columns are ignored; with nothing to learn from every decision has 1/2 and every word count is 0.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import NONE, PairTable
from factloom.llm.common import blocks, cut, hand_back, slices

HOT_WORDS, HOT_GRAMS, CHUNK = 1 << 17, 1 << 19, 1 << 16
#: Bytes of a word that goes to every worker; longer ones are found through the join, however frequent.
HOT_BYTES = 48
END, DEPTH, SPREAD = 255, 5, 3
GROUP = ((1 << (8 * SPREAD)) - 1) << 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def grams_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(strings of DEPTH + 1 bytes of all texts in order: each byte, or the end, and those before it; their number by text)."""
    stop = bytes([END]) * DEPTH
    joined = bytes([END]) * 7 + b"".join(d + stop for d in data)
    codes = np.ndarray((len(joined) - 7,), ">u8", joined, strides=(1,)).astype(np.uint64) & np.uint64((1 << (8 * DEPTH + 8)) - 1)
    n = np.array([len(d) + 1 for d in data])
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(n + DEPTH - 1)
    for k in range(1, DEPTH):
        keep[ends - k] = False  # separators of a text after its end
    return codes[keep], n


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def count(docs: DataFrame, strings: bool = True) -> DataFrame:
    """docs: text, train; strings: whether those are counted, or words only. Returns word (binary) or gram (long), n (in training texts): one row for each that occurs in
    some training text (words) or in any text (grams), and for each worker's task."""

    def run(batches):
        words: Counter = Counter()
        keys, counts = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(words.items())
            for i in range(0, len(items), 100_000):
                some = items[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.array([n for _, n in some], pa.int64())], ["word", "gram", "n"])
            words.clear()
            if keys:
                k, n = merged(keys, counts)
                for i in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(k[i : i + 100_000]), pa.binary()), pa.array(k[i : i + 100_000].astype(np.int64)), pa.array(n[i : i + 100_000])], ["word", "gram", "n"])
            keys.clear()
            counts.clear()

        for batch in slices(batches):
            texts, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in blocks(texts, 1 << 19):
                for learn in (True, False):
                    data = [(x or "").encode().translate(_LOWER) for x, t in zip(texts[i:j], train[i:j]) if t is learn]
                    if not data:
                        continue
                    if learn:
                        words.update(b" ".join(data).split())
                    if strings:
                        k, n = np.unique(grams_of(data)[0], return_counts=True)
                        keys.append(k)
                        counts.append(n if learn else np.zeros(len(n), np.int64))
                if sum(map(len, keys)) > 2_000_000:
                    k, n = merged(keys, counts)
                    keys[:], counts[:] = [k], [n]
                if len(words) > 200_000 or (keys and len(keys[0]) > 1_000_000):
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "word binary, gram long, n long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: shifted by eight, then Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, bits) of the eight decisions of each string's last byte: node 1 is the first, children of m are 2m, 2m + 1."""
    byte = (grams & 255).astype(np.int64)
    nodes = np.stack([(1 << k) | (byte >> (8 - k)) for k in range(8)], axis=1)
    bits = np.stack([(byte >> (7 - k)) & 1 for k in range(8)], axis=1)
    return nodes, bits


def level(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None) -> pd.DataFrame:
    """Sums by key: n0, n1, log Pw, and b, the odds of stopping here against going on to the children."""
    k, back = np.unique(keys, return_inverse=True)
    a, b = np.bincount(back, weights=n0), np.bincount(back, weights=n1)
    pe = log_kt(a, b)
    if children is None:
        return pd.DataFrame({"key": k, "n0": a, "n1": b, "pw": pe, "b": np.inf})
    below = np.bincount(back, weights=children)
    return pd.DataFrame({"key": k, "n0": a, "n1": b, "pw": math.log(0.5) + np.logaddexp(pe, below), "b": np.exp(np.minimum(pe - below, 700))})


def lower_levels(grams: np.ndarray, n: np.ndarray) -> list[pd.DataFrame]:
    """Levels of DEPTH to SPREAD context bytes for strings that stand together by those; keys are context, node."""
    seen = n > 0
    g, n = grams[seen], n[seen]
    nodes, bits = decisions(g)
    keys = (((g.astype(np.int64) >> 8) << 8)[:, None] | nodes).ravel()
    ones = (n[:, None] * bits).ravel()
    out = [level(keys, np.repeat(n, 8) - ones, ones, None)]
    for depth in range(DEPTH - 1, SPREAD - 1, -1):
        last = out[-1]
        out.append(level(last["key"].to_numpy() & ((1 << (8 * depth + 8)) - 1), last["n0"], last["n1"], last["pw"]))
    return out


class Upper:
    """The levels of fewer than SPREAD context bytes: n0, n1, b by context and node."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(SPREAD - 1, -1, -1):
            t = level(key & ((1 << (8 * depth + 8)) - 1), n0, n1, below)
            key, n0, n1, below = (t[c].to_numpy() for c in ("key", "n0", "n1", "pw"))
            self.levels.append((key.astype(np.uint64), t[["n0", "n1", "b"]].to_numpy()))

    @cached_property
    def lookups(self) -> list[tuple[PairTable, np.ndarray]]:
        """Made once for each worker, from what was broadcast."""
        return [(PairTable(keys, np.arange(len(keys), dtype=np.int32)), rows) for keys, rows in self.levels]


def probability(grams: np.ndarray, n: np.ndarray, upper: list) -> np.ndarray:
    """log10 of the probability of each string's last byte after those before it; upper: lookups of the upper levels."""
    tables = lower_levels(grams, n)
    nodes, bits = decisions(grams)
    context = grams.astype(np.int64) >> 8
    unseen = (0.0, 0.0, 1.0)

    def below(table: pd.DataFrame, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        have = table["key"].to_numpy()
        at = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
        hit = have[at] == keys if len(have) else np.zeros(len(keys), bool)
        return tuple(np.where(hit, table[c].to_numpy()[at], d) if len(have) else np.full(len(keys), d) for c, d in zip(("n0", "n1", "b"), unseen))

    def above(table: PairTable, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        at = table.find(keys.astype(np.uint64))
        hit = at != NONE
        got = rows[np.where(hit, at, 0)] if len(rows) else np.zeros((len(keys), 3))
        return tuple(np.where(hit, got[:, c], unseen[c]) for c in range(3))

    out = np.zeros(len(grams))
    for k in range(8):
        node, bit = nodes[:, k], bits[:, k]
        key = lambda depth: ((context & ((1 << (8 * depth)) - 1)) << 8) | node
        p = None
        levels = [lambda i=i, t=t: below(t, key(DEPTH - i)) for i, t in enumerate(tables)]
        levels += [lambda i=i, t=t: above(*t, key(SPREAD - 1 - i)) for i, t in enumerate(upper)]
        for of in levels:
            n0, n1, b = of()
            kt = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
            p = kt if p is None else (b * kt + p) / (b + 1)
        out += np.log10(p)
    return out


def spread(grams: DataFrame, fn, schema: str) -> DataFrame:
    """fn(gram, n, seen) -> columns, over rows of grams that stand together by their last SPREAD context bytes: whole
    groups of those, CHUNK rows at least."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held, n = [], 0

        def result(cols):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in fn(*cols)], names)

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(3)])
            n += batch.num_rows
            if n >= CHUNK:
                cols = [np.concatenate([h[k] for h in held]) for k in range(3)]
                group = cols[0] & GROUP
                whole = len(group) - int((group[::-1] != group[-1]).argmax()) if group[0] != group[-1] else 0
                if whole:
                    yield result([c[:whole] for c in cols])
                held, n = [[c[whole:] for c in cols]], 0
        if held and len(held[0][0]):
            yield result([np.concatenate([h[k] for h in held]) for k in range(3)])
        held.clear()
        hand_back()

    return grams.select("gram", "n", "seen").mapInArrow(run, schema)


def fit_grams(grams: DataFrame) -> DataFrame:
    """gram, n, seen -> gram, seen, logp."""
    spark = grams.sparkSession

    def first(g, n, _):
        low = lower_levels(g, n)[-1]
        k, back = np.unique(low["key"].to_numpy() & ((1 << (8 * SPREAD)) - 1), return_inverse=True)
        return [k, *(np.bincount(back, weights=low[c], minlength=len(k)) for c in ("n0", "n1", "pw"))]

    sums = spread(grams, first, "key long, n0 double, n1 double, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    got = packed(sums, "key", "n0", "n1", "below")  # at most 5.6 million rows, see above
    key = np.frombuffer(b"".join(k for k, _ in got), "<i8")
    rows = np.concatenate([np.frombuffer(v, "<f8").reshape(3, -1) for _, v in got], axis=1) if got else np.zeros((3, 0))
    shared = spark.sparkContext.broadcast(Upper(key, *rows))

    def last(g, n, seen):
        return [g, seen, probability(g, n, shared.value.lookups)]

    return spread(grams, last, "gram long, seen long, logp double")


def most(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows of the highest values of column, limit of them at most: a threshold from a histogram, no sort."""
    step = F.floor(F.log2(F.col(column) + 1) * 8).cast("int").alias("step")
    total, line = 0, None
    for r in sorted(df.groupBy(step).count().collect(), key=lambda r: -r.step):  # a few hundred rows
        total += r["count"]
        if total > limit:
            break
        line = r.step
    return df.filter(F.floor(F.log2(F.col(column) + 1) * 8) >= line) if line is not None else df.limit(0)


def packed(df: DataFrame, key: str, *values: str) -> list[tuple[bytes, bytes]]:
    """(keys, values as doubles, column by column) of each partition: numbers as 64-bit integers, words joined by line feeds."""

    def run(batches):
        keys, rows = [], [[] for _ in values]
        for batch in batches:
            k = batch.column(0)
            keys.append(b"".join(w + b"\n" for w in k.to_pylist()) if pa.types.is_binary(k.type) else k.to_numpy().astype("<u8").tobytes())
            for i, out in enumerate(rows):
                out.append(batch.column(1 + i).to_numpy().astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(keys)], pa.binary()), pa.array([b"".join(x for out in rows for x in out)], pa.binary())], ["k", "v"])

    return [(bytes(r.k), bytes(r.v)) for r in df.select(key, *values).mapInArrow(run, "k binary, v binary").toLocalIterator()]


_UNPACKED: dict[str, tuple] = {}


def unpacked(name: str, words: list[tuple[bytes, bytes]], grams: list[tuple[bytes, bytes]]) -> tuple[dict, PairTable, np.ndarray]:
    """(word -> log10 of its count and a half, table of strings, their log10 probabilities and a 0), kept for the worker's next tasks."""
    if name not in _UNPACKED:
        _UNPACKED.clear()
        known = {w: x for k, v in words for w, x in zip(k.split(b"\n"), np.log10(np.frombuffer(v, "<f8") + 0.5).tolist())}
        keys, logs = np.frombuffer(b"".join(k for k, _ in grams), "<u8"), np.frombuffer(b"".join(v for _, v in grams), "<f8")
        _UNPACKED[name] = known, PairTable(keys, np.arange(len(keys), dtype=np.int32)), np.append(logs, 0.0)
    return _UNPACKED[name]


def _model(counted: DataFrame) -> DataFrame:
    """gram, seen, logp of every string counted."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = cut(counted.filter("gram is not null").select("gram", "n", (F.col("n") + F.col("seen")).alias("seen")).repartition(parts, F.col("gram").bitwiseAND(GROUP)).sortWithinPartitions(F.col("gram").bitwiseAND(GROUP)))
    return cut(fit_grams(grams))


def score(docs: DataFrame, hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS, words_only: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; the last two, and the context
    trees that they come from, not with words_only."""
    spark = docs.sparkSession
    held = held_out(F.col("doc_id"))
    counted = cut(count(docs.select("text", (~held).alias("train")), not words_only).groupBy("word", "gram").agg(F.sum("n").alias("n"), F.count("*").alias("seen")))
    vocabulary = counted.filter("word is not null").select("word", "n")
    model = None if words_only else _model(counted)
    n_train = docs.filter(~held).count()
    n_words, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, v = n_words + n_train, kinds + (1 if n_train else 0)
    # Both tables come packed, a few bytes a row; workers make dictionaries of them.
    hot = spark.sparkContext.broadcast((uuid.uuid4().hex, packed(most(vocabulary.filter(F.octet_length("word") <= HOT_BYTES), "n", hot_words), "word", "n"), [(b"", b"")] if model is None else packed(most(model, "seen", hot_grams), "gram", "logp")))

    def run(batches):
        known, keys, logs = unpacked(*hot.value)
        get, n_row = known.get, TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids, out, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in blocks(texts, 1 << 19):
                data = [(x or "").encode().translate(_LOWER) for x in texts[i:j]]
                tokens = [d.split() for d in data]
                found = [list(map(get, t)) for t in tokens]
                rare = [[w for w, x in zip(t, f) if x is None] if None in f else [] for t, f in zip(tokens, found)]
                base = [sum(f) if not r else sum(x for x in f if x is not None) for f, r in zip(found, rare)]
                scores, miss = np.zeros(len(data)), [[]] * len(data)
                if not words_only:
                    codes, n = grams_of(data)
                    ends = np.cumsum(n)
                    at = keys.find(codes)
                    hit = at != NONE
                    scores = np.add.reduceat(logs[np.minimum(at, len(logs) - 1)], ends - n)  # NONE takes the 0 at the end
                    miss = np.split(codes[~hit].astype(np.int64), np.cumsum(np.add.reduceat((~hit).astype(np.int64), ends - n))[:-1])
                rows = list(range(n_row, n_row + len(data)))
                n_row += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(ids[i:j], pa.int64()), pa.array(out[i:j], pa.bool_()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([len(t) - len(r) for t, r in zip(tokens, rare)], pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array([len(d) for d in data], pa.int64()), pa.array(rare, pa.list_(pa.binary())), pa.array(miss, pa.list_(pa.int64()))],
                    ["row", "doc_id", "held_out", "n_words", "n_hot", "base", "score", "n_bytes", "rare_words", "rare_grams"],
                )

    schema = "row long, doc_id long, held_out boolean, n_words long, n_hot long, base double, score double, n_bytes long, rare_words array<binary>, rare_grams array<long>"
    scored = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, schema))
    by_word = scored.select("row", F.explode("rare_words").alias("word")).groupBy("word", "row").count()
    rare = by_word.join(vocabulary, "word").groupBy("row").agg(F.sum("count").alias("n_rare"), F.sum(F.col("count") * (F.log10(F.col("n") + 0.5) - math.log10(0.5))).alias("more"))
    out = scored.drop("rare_words", "rare_grams").join(rare, "row", "left")
    if not words_only:
        more_grams = scored.select("row", F.explode("rare_grams").alias("gram")).join(model.select("gram", "logp"), "gram").groupBy("row").agg(F.sum("logp").alias("gram_score"))
        out = out.join(more_grams, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_tokens = F.col("n_words") + 1
    # The words looked up by join count as unknown first (log10 of 0.5); those found add the difference.
    base = F.col("base") + (F.col("n_words") - F.col("n_hot")) * math.log10(0.5) + F.coalesce("more", F.lit(0.0)) + math.log10(n_train + 0.5) - n_tokens * math.log10(total + 0.5 * (v + 1))
    columns = ["doc_id", "held_out", n_tokens.cast("long").alias("n_tokens"), (F.col("n_hot") + zero("n_rare") + (1 if n_train else 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score")]
    if words_only:
        return out.select(*columns)
    whole = F.col("score") + F.coalesce("gram_score", F.lit(0.0))
    return out.select(*columns, whole.alias("score"), (-whole * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


#: held_out, n_tokens, n_known, train_tokens and base_score in DuckDB; CRC-32 bit by bit.
BASE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: list_reduce(list_prepend(xor(a, x), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda c, one: xor(c >> 1, 3988292384 * (c & one))), 4294967295::BIGINT), 4294967295) % 5 = 1 AS held_out FROM documents),
t AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM d WHERE NOT held_out) GROUP BY 1),
e AS (SELECT count(*) AS n FROM d WHERE NOT held_out),
n AS (SELECT coalesce(sum(c), 0) + (SELECT n FROM e) AS total, count(*) + ((SELECT n FROM e) > 0)::INT AS v FROM t),
s AS (SELECT doc_id, count(c) AS known, sum(log10(coalesce(c, 0) + 0.5)) AS base FROM (SELECT doc_id, unnest(w) AS word FROM d) LEFT JOIN t USING (word) GROUP BY 1)
SELECT doc_id, held_out, len(w) + 1 AS n_tokens, (coalesce(known, 0) + (e.n > 0)::INT)::BIGINT AS n_known, total::BIGINT AS train_tokens,
  round(coalesce(base, 0) + log10(e.n + 0.5) - (len(w) + 1) * log10(total + 0.5 * (v + 1)), 3) AS base_score
FROM d LEFT JOIN s USING (doc_id), n, e
"""
