"""Packing of candidates around a gold block under growing token budgets.

Growth is sequential by nature (each pick depends on the tokens on either side), so a family is one group. Only ids and
token counts enter it, unless whole prompts are to be measured, whose tokens don't add up: then the texts of the family's
candidates do, which are limited by design. Hashes and positions are put together afterwards by joins."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import inf
from sys import maxsize

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 8
SIDES = ("before", "gold", "after")
SCHEMA = "family_id string, nominal long, status string, tokens long, record_id string, side string, position int, gold_start long, gold_tokens long"


class Pending:
    """Records not placed yet, in order. The next WINDOW of them stand in a list ordered by size, so the best fit among them
    is found by bisection; the others in a tree of least sizes, which gives the first one up to a size. A record that
    comes back goes before all others: spare leaves at the tree's beginning hold those that the window has no room for."""

    def __init__(self, sizes: list[int], spare: int = 0):
        self.sizes, self.n, self.spare = sizes, len(sizes), spare
        self.leaves = 1 << max(0, self.n + spare - 1).bit_length()
        self.least = [inf] * (self.leaves + spare) + sizes + [inf] * (self.leaves - self.n - spare)
        for k in range(self.leaves - 1, 0, -1):
            self.least[k] = min(self.least[2 * k : 2 * k + 2])
        self.record = dict(enumerate(range(self.n), spare))
        self.near: list[tuple[int, int, int]] = []  # size, record, leaf
        self._refill()

    def _first(self, most: int = maxsize) -> int | None:
        """The first leaf of the tree whose size is most or less."""
        if self.least[1] > most:
            return None
        k = 1
        while k < self.leaves:
            k = 2 * k if self.least[2 * k] <= most else 2 * k + 1
        return k - self.leaves

    def _set(self, leaf: int, size: float) -> None:
        k = leaf + self.leaves
        self.least[k] = size
        while k > 1:
            k //= 2
            self.least[k] = min(self.least[2 * k : 2 * k + 2])

    def _drop(self, leaf: int) -> tuple[int, int, int]:
        """Takes a record out of the tree."""
        self._set(leaf, inf)
        return self.sizes[self.record[leaf]], self.record[leaf], leaf

    def _refill(self) -> None:
        while len(self.near) < WINDOW and (leaf := self._first()) is not None:
            insort(self.near, self._drop(leaf))

    def back(self, record: int) -> None:
        """Puts a record before all others."""
        self.spare -= 1
        self.record[self.spare] = record
        insort(self.near, (self.sizes[record], record, self.spare))
        if len(self.near) > WINDOW:
            size, _, leaf = self.near.pop(max(range(len(self.near)), key=lambda k: self.near[k][2]))
            self._set(leaf, size)

    def take(self, most: int, wanted: int) -> tuple[int, int] | None:
        """(size, record) of at most the size most: of the near ones the one nearest to the wanted size, the earlier
        one of two; if none of them fits, the first one beyond."""
        fit = bisect_right(self.near, (most, self.n, 0))
        if not fit:
            leaf = self._first(most)
            return None if leaf is None else self._drop(leaf)[:2]
        above = bisect_left(self.near, (wanted, -1, 0), 0, fit)
        places = [above] if above < fit else []
        if above:
            places.append(bisect_left(self.near, (self.near[above - 1][0], -1, 0)))
        best = min(places, key=lambda k: (abs(self.near[k][0] - wanted), self.near[k][1]))
        taken = self.near.pop(best)
        self._refill()
        return taken[:2]


#: (tokens of the context, tokens of the whole prompt) with these records before and after the gold block.
Measure = Callable[[list[int], list[int]], tuple[int, int]]


class Context:
    """A gold block and what has been placed on either side; lean is how much more stands before it than after."""

    def __init__(self, sizes: list[int], gold: int, spare: int = 0):
        self.sizes, self.pending, self.gold = sizes, Pending(sizes, spare), gold
        self.records: deque[int] = deque()
        self.n_before, self.lean, self.total = 0, 0, gold

    def fill(self, nominal: int) -> None:
        while (taken := self.pending.take(nominal - self.total, abs(self.lean))) is not None:
            size, record = taken
            self.total += size
            if self.lean > 0:
                self.records.append(record)
                self.lean -= size
            else:
                self.records.appendleft(record)
                self.n_before += 1
                self.lean += size

    def _outer(self) -> list[bool]:
        """Whether each record that would go, one by one, stands before the gold block: the outermost one of the heavier side."""
        placed, low, high, lean, out = list(self.records), 0, len(self.records), self.lean, []
        while low < high:
            front = low < self.n_before and (lean >= 0 or high == self.n_before)
            lean -= self.sizes[placed[low]] if front else -self.sizes[placed[high - 1]]
            low, high = low + front, high - (not front)
            out.append(front)
        return out

    def shrink(self, holds: Callable[[list[int], list[int]], bool]) -> None:
        """Takes out as few records as make holds(before, after) true, or all. Fewer records never make it false, so their
        number is found by bisection; each probe sees a whole context, as tokens of a rendered text don't add up."""
        placed, turns = list(self.records), self._outer()
        fronts = [0, *accumulate(turns)]
        sides = lambda k: (placed[fronts[k] : self.n_before], placed[self.n_before : len(placed) - (k - fronts[k])])
        if holds(*sides(0)):
            return
        low, high = 0, len(turns)  # low is too few
        while high - low > 1:
            k = (low + high) // 2
            low, high = (low, k) if holds(*sides(k)) else (k, high)
        for front in turns[:high]:
            record = self.records.popleft() if front else self.records.pop()
            self.n_before -= front
            self.total -= self.sizes[record]
            self.lean -= self.sizes[record] if front else -self.sizes[record]
            self.pending.back(record)

    def sides(self) -> tuple[list[int], list[int]]:
        placed = list(self.records)
        return placed[: self.n_before], placed[self.n_before :]

    def status(self, nominal: int, tokens: int, target: float, tolerance: float, fill: float) -> str:
        if tokens > nominal:
            return "PROMPT_BUDGET_EXCEEDED"
        if tokens < fill * nominal:
            return "POOL_EXHAUSTED"
        # Before the gold block's middle stand (total + lean) / 2 tokens.
        middle = (self.total + self.lean) / (2 * tokens) if tokens else 0.0
        return "OK" if abs(middle - target) <= tolerance + 1e-9 else "POSITION_TOLERANCE_UNSATISFIABLE"


def grow(sizes: list[int], gold: int, lengths: list[int], target: float, tolerance: float, fill: float, measure: Measure | None = None, budget: int | None = None) -> Iterator[tuple[int, str, int, list[int], int]]:
    """(nominal, status, tokens, placed records in order, how many of them before the gold block) of each length, shortest
    first. A longer context keeps what a shorter one has; once one can't be filled, no longer one can.

    With measure a context that is longer than it should be as a whole, or whose prompt exceeds the budget, loses the
    outermost record of its heavier side, again and again; these are the first to come back at the next length."""
    context, ended = Context(sizes, gold, (len(sizes) + WINDOW) * len(lengths) if measure else 0), False
    within = lambda before, after, nominal: (tokens := measure(before, after))[0] <= nominal and (budget is None or tokens[1] <= budget)
    for nominal in lengths:
        if ended:
            yield nominal, "POOL_EXHAUSTED", 0, [], 0
            continue
        context.fill(nominal)
        tokens, prompt = context.total, 0
        if measure:
            context.shrink(lambda before, after: within(before, after, nominal))
            tokens, prompt = measure(*context.sides())
        status = "PROMPT_BUDGET_EXCEEDED" if budget is not None and prompt > budget else context.status(nominal, tokens, target, tolerance, fill)
        ended = status in ("PROMPT_BUDGET_EXCEEDED", "POOL_EXHAUSTED")
        placed = list(context.records) if status == "OK" else []
        yield nominal, status, tokens, placed, context.n_before if placed else 0


def pack(candidates: DataFrame, gold: DataFrame, lengths: tuple[int, ...], target: float = 0.5, tolerance: float = 0.05, fill: float = 0.9, budget: int | None = None, count: Callable[[str], int] | None = None, prompt: Callable[[str, str], str] | None = None) -> DataFrame:
    """candidates: family_id, record_id, position, tokens; gold: family_id, record_id, ord, tokens. Returns a row for
    each placed record of each (family, length), and one without a record where a length is unavailable.

    With count (tokens of a text) contexts are measured as they are rendered: candidates and gold then have text, and gold a
    question; prompt(context, question) is what budget limits."""
    more = [] if count is None else ["text", "question"]
    none = F.lit(None).cast("string").alias("question")
    rows = lambda df, place, is_gold: df.select("family_id", "record_id", F.col(place).cast("int").alias("place"), F.col("tokens").cast("long").alias("tokens"), F.lit(is_gold).alias("is_gold"), *([F.col("text"), F.col("question") if is_gold else none] if more else []))
    both, sizes = rows(candidates, "position", False).unionByName(rows(gold, "ord", True)), sorted(lengths)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        g, c = pdf[pdf["is_gold"]], pdf[~pdf["is_gold"]]
        ids, gold_ids, n_gold = c["record_id"].tolist(), g["record_id"].tolist(), int(g["tokens"].sum())
        tokens, out, family, measure = c["tokens"].tolist(), [], pdf["family_id"].iloc[0], None
        if count is not None and gold_ids:
            texts, block, question = c["text"].tolist(), g["text"].tolist(), g["question"].iloc[0]

            def measure(before: list[int], after: list[int]) -> tuple[int, int]:
                context = "\n".join([texts[i] for i in before] + block + [texts[i] for i in after])
                return count(context), count(prompt(context, question)) if prompt else 0

        for nominal, status, total, records, n in grow(tokens, n_gold, sizes, target, tolerance, fill, measure, budget) if gold_ids else []:
            start = sum(tokens[i] for i in records[:n])
            sides = [(ids[i], "before") for i in records[:n]] + [(x, "gold") for x in gold_ids] + [(ids[i], "after") for i in records[n:]]
            placed = sides if status == "OK" else [(None, None)]
            out += [(family, nominal, status, total, r, side, k, start, n_gold) for k, (r, side) in enumerate(placed)]
        return pd.DataFrame(out, columns=["family_id", "nominal", "status", "tokens", "record_id", "side", "position", "gold_start", "gold_tokens"])

    return both.groupBy("family_id").applyInPandas(run, SCHEMA)


def instances(packed: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each (family, length): ids, context, gold span, relative position, hash, records by side, a map from
    record to place, what was added to the length before, and placed records that have no text."""
    rows = packed.filter("status = 'OK'").join(texts.select("record_id", "text"), "record_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("position", "record_id", "side", "text")))
    out = rows.groupBy("family_id", "nominal").agg(parts.alias("p"), F.first("tokens").alias("tokens"), F.first("gold_start").alias("gold_start"), F.first("gold_tokens").alias("gold_tokens"))
    at = Window.partitionBy("family_id").orderBy("nominal")
    ids = F.col("p.record_id")
    on = lambda side: F.filter("p", lambda x: x["side"] == side)
    counts = F.map_from_arrays(F.array(*map(F.lit, SIDES)), F.array(*[F.size(on(s)) for s in SIDES]))
    out = out.select(
        "family_id", "nominal", "tokens", "gold_start", "gold_tokens", ids.alias("record_ids"), F.array_join(F.col("p.text"), "\n").alias("context"), on("gold")["record_id"].alias("gold_ids"), counts.alias("counts"),
        F.map_from_entries(F.transform("p", lambda x: F.struct(x["record_id"], x["position"]))).alias("places"), F.filter("p", lambda x: x["text"].isNull())["record_id"].alias("missing_ids"),
    )
    before = F.lag("record_ids").over(at)
    return out.select("*", F.sha2("context", 256).alias("context_sha256"), ((F.col("gold_start") + F.col("gold_tokens") / 2) / F.col("tokens")).alias("relative_position"), F.array_except("record_ids", F.coalesce(before, F.array().cast("array<string>"))).alias("added_ids"), before.alias("previous_ids"))


def trimmed(placed: DataFrame, limit: int) -> DataFrame:
    """Rows of placed (family_id, nominal, record_id, side, position, size) that stay when records go, in turn from the
    front and from the back, until a context has limit tokens; the gold block always stays.

    The i-th record from the front goes after min(i, records behind) ones from the back, the j-th from the back after
    min(j + 1, records in front), so the turn of each record is known and a running sum tells who has to go."""
    context = Window.partitionBy("family_id", "nominal")
    front, back = F.col("side") == "before", F.col("side") == "after"
    inward = F.when(back, -F.col("position")).otherwise(F.col("position"))
    own = F.row_number().over(Window.partitionBy("family_id", "nominal", "side").orderBy(inward)) - 1
    rows = placed.withColumns({"_own": own, "_front": F.count_if(front).over(context), "_back": F.count_if(back).over(context), "_total": F.sum("size").over(context)})
    turn = F.when(front, F.col("_own") + F.least("_own", "_back")).when(back, F.col("_own") + F.least(F.col("_own") + 1, F.col("_front")))
    gone = F.coalesce(F.sum(F.when(front | back, F.col("size"))).over(context.orderBy(F.col("_turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_turn", turn).withColumn("_gone", gone)
    return out.filter(F.col("_turn").isNull() | (F.col("_total") - F.col("_gone") <= limit)).drop("_own", "_front", "_back", "_total", "_turn", "_gone")
