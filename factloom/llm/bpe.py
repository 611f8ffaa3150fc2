"""Byte-level BPE encoding and decoding.

Texts are matched by the tokenizer's pattern; every distinct match becomes a row of a padded matrix of byte ids, rows of
similar length share a matrix, and in each round every row merges its leftmost pair of minimum rank. Ranks of pairs come
from an open-addressing hash table over (left id, right id); after a merge the row is compacted by one.

Null and empty texts have no ids. Rows are independent: repeated rows give repeated results, other columns pass through
(a column named like one of the results is replaced). Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import PieceCache, slices

NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the merged token, in a hash table of numpy arrays with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, np.iinfo(np.uint64).max, np.uint64), np.full(size, NONE, np.int32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.iinfo(np.uint64).max
            own = left[free]
            at, first = np.unique(slot[own], return_index=True)
            self.keys[at], self.values[at] = keys[own[first]], values[own[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE for pairs that don't merge or hold padding (-1)."""
        return self.find((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; NONE for those that aren't there."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.iinfo(np.uint64).max))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (found != np.iinfo(np.uint64).max)]
        return out


class ByteBpe:
    """Encoder and decoder for a rank file (base64 token, rank) and a split pattern."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(r, self.ranks[t[:i]], self.ranks[t[i:]]) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        r, a, b = np.array(splits, np.int64).T
        self.pairs = PairTable((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), r.astype(np.int32))
        self.pattern = regex.compile(pattern)
        starts = np.zeros(max(self.tokens) + 1, bool)
        starts[list(self.tokens)] = [t[:1] in (b" ", b"\n") for t in self.tokens.values()]
        self.cache = PieceCache(self.encode_text, starts, limit=300_000)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, by rounds of merges over padded matrices of words of similar length."""
        out: list = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        start = 0
        while start < len(order):
            width = 1 << max(2, int(size[order[start]] - 1).bit_length())  # the bucket: over half of its width is used
            end = min(int(np.searchsorted(size[order], width, side="right")), start + max(1, (1 << 20) // width))
            some = order[start:end].tolist()
            self._merge_matrix([words[i] for i in some], some, out)
            start = end
        return out

    def _merge_matrix(self, words: list[bytes], place: list[int], out: list) -> None:
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        row = np.array(place)
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.full((n, 0), NONE)
        while len(row):
            pos = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), pos] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                flat = ids[done][np.arange(ids.shape[1]) < sizes[done, None]].astype("<u4").tobytes()
                end = np.cumsum(sizes[done]) * 4
                for i, s, e in zip(row[done].tolist(), [0, *end.tolist()], end.tolist()):
                    out[i] = flat[s:e]
                keep = ~done
                row, sizes, ids, rank, pos, best = row[keep], sizes[keep], ids[keep], rank[keep], pos[keep], best[keep]
                if not len(row):
                    break
            at, most = np.arange(len(row)), int(sizes.max())
            if len(row) == 1:  # a long word: move its tail in place
                p = int(pos[0])
                ids, rank = self._merge_one(ids, rank, p, int(best[0]), most)
                sizes -= 1
                continue
            after = np.arange(most - 1)
            ids = np.take_along_axis(ids, after + (after > pos[:, None]), axis=1)
            ids[at, pos] = best
            gaps = np.arange(most - 2)
            rank = np.take_along_axis(rank, gaps + (gaps >= pos[:, None]), axis=1)
            sizes -= 1
            for offset in (-1, 0):
                left = pos + offset
                ok = np.flatnonzero((left >= 0) & (left < rank.shape[1]))
                a, b = ids[ok, left[ok]], ids[ok, left[ok] + 1]
                rank[ok, left[ok]] = np.where(b < 0, NONE, self.pairs.get(a, b))

    def _merge_one(self, ids: np.ndarray, rank: np.ndarray, p: int, best: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        ids[0, p] = best
        ids[0, p + 1 : size - 1] = ids[0, p + 2 : size]
        rank[0, p : size - 2] = rank[0, p + 1 : size - 1]
        ids, rank = ids[:, : size - 1], rank[:, : size - 2]
        for left in (p - 1, p):
            if 0 <= left < rank.shape[1]:
                rank[0, left] = self.pairs.get(ids[0, left : left + 1], ids[0, left + 1 : left + 2])[0]
        return ids, rank

    def encode_text(self, text: str) -> np.ndarray:
        words = [m.encode() for m in self.pattern.findall(text)]
        ids: dict[bytes, bytes] = {}
        todo = []
        for w in set(words):
            if (r := self.ranks.get(w)) is not None:
                ids[w] = r.to_bytes(4, "little")
            else:
                todo.append(w)
        ids.update(zip(todo, self.merge(todo)))
        return np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u4")

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.encode_each(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(rank_path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process; the path names a file that is installed on every machine."""
    if (rank_path, pattern) not in _LOADED:
        _LOADED[rank_path, pattern] = ByteBpe(rank_path, pattern)
    return _LOADED[rank_path, pattern]


def with_columns(schema: T.StructType, more: list[tuple[str, str]]) -> str:
    """DDL of schema without columns named like those in more, then more."""
    names = {n.lower() for n, _ in more}
    return ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema if f.name.lower() not in names] + [f"{n} {t}" for n, t in more])


def without(batch: pa.RecordBatch, names: Iterable[str]) -> dict[str, pa.Array]:
    names = {n.lower() for n in names}
    return {n: c for n, c in zip(batch.schema.names, batch.columns) if n.lower() not in names}


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col: array<int>, the ids of text_col."""

    def run(batches):
        bpe = load(rank_path, pattern)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_all(texts)]
            yield pa.RecordBatch.from_pydict(without(batch, [ids_col]) | {ids_col: pa.array(ids, pa.list_(pa.int32()))})

    return docs.mapInArrow(run, with_columns(docs.schema, [(ids_col, "array<int>")]))


def decode(docs: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with text_col: binary, the bytes of ids_col; null ids have no bytes."""

    def run(batches):
        bpe = load(rank_path, pattern)
        for batch in slices(batches):
            ids = batch.column(ids_col).to_pylist()
            yield pa.RecordBatch.from_pydict(without(batch, [text_col]) | {text_col: pa.array([bpe.decode(np.array(x or [], "<u4").tobytes()) for x in ids], pa.binary())})

    return docs.mapInArrow(run, with_columns(docs.schema, [(text_col, "binary")]))


def encode_checked(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, exact (the ids decode to the text) of docs (doc_id, source, text)."""

    def run(batches):
        bpe = load(rank_path, pattern)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(2).to_pylist()]
            ids = list(bpe.encode_all(texts))
            exact = [bpe.decode(i) == t.encode() for i, t in zip(ids, texts)]
            n = np.array([len(i) // 4 for i in ids], np.int64)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), lists, pa.array(exact, pa.bool_())], ["doc_id", "source", "n_tokens", "ids", "exact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, exact boolean")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode each text in one pass; returns id_col, n_tokens, ids_sha256, decoded_sha256, n_bytes, exact.

    Only digests leave the worker, so no ids are shuffled or held beyond a text."""

    def run(batches):
        bpe = load(rank_path, pattern)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            for text, ids in zip(texts, bpe.encode_all(texts)):
                back = bpe.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), back == text.encode()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "exact"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col]).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, exact boolean").withColumnRenamed("id", id_col)
