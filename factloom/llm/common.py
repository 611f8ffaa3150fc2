"""Shared folders, lineage cuts and text pieces used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and there is but one
    machine (tests). An error on a cluster that names none: a driver's own folder is no shared one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        named = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table written under the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space by either Python's or Unicode's definition.
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f" + SPACES[SPACES.index("\x85") :] + "]")
_INSIDE_A_RUN = re.compile(f"[{SPACES}]{{2}}")
_BEFORE_A_RUN = re.compile(f"(?<=[^{SPACES}])(?= )")
_ONE_WORD = re.compile(f"[ \n][^{SPACES}]+")
_LETTERS = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def careful_cuts(text: str) -> list[int] | None:
    """Lengths in bytes of the parts of a text with runs of white space, cut before blanks that follow a non-space; None
    where each blank and line feed stands alone between non-spaces, so that a cut before any of them is safe.

    A byte-level pre-tokenizer keeps at most the last blank of a run with the word that follows and always cuts between
    the rest, so parts encode independently."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1:] in " \n" or (_ODD.search(text) and _INSIDE_A_RUN.search(text)):
        return [len(x.encode()) for x in _BEFORE_A_RUN.split(text)]
    return None


def blocks(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most characters each, at least one text."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Record batches in parts of some rows, so that only those become Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    hand_back()


def hand_back() -> None:
    """Gives memory that a task has freed back to the system: workers live on, and the next task may be another's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


class PieceCache:
    """Ids of texts, by the pieces they are cut into: words with the blank or line feed before them, and marks after them.

    encode_text: text -> array of ids; encode_words, if given: the same for a list of words of a blank and Latin letters;
    starts: whether an id's bytes begin with a blank or a line feed; whole: strings
    that an encoder takes as one token wherever they stand, so a text with one isn't cut. Pieces of at most 31 bytes are
    keys of an open-addressing table (their bytes and their length, compared exactly), longer ones of a dictionary. The
    first limit distinct pieces stay, among them the frequent ones; others live for one block of texts, so a worker's
    memory doesn't grow with the distinct words it has seen. New pieces of a block are encoded together, as one text,
    and parted where a token begins with a blank."""

    LONG, TOGETHER = 31, 1 << 15
    MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
    MARK = np.isin(np.arange(256), np.frombuffer(b",.;:!?", np.uint8))
    LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123))
    BLANK = np.isin(np.arange(256), [10, 32])

    def __init__(self, encode_text, starts: np.ndarray, limit: int = 1_000_000, whole: tuple[str, ...] = (), encode_words=None):
        self.encode_words = encode_words
        self.encode_text, self.starts, self.limit, self.whole = encode_text, starts, limit, whole
        self.slots = np.full(1 << (2 * limit - 1).bit_length(), -1, np.int32)
        self.n = self.n_pool = 0
        self.keys, self.first, self.size, self.pool = np.zeros((1024, 4), np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)
        self.long: dict[bytes, int] = {}

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, 4):
            h = (h ^ (h >> np.uint64(29)) ^ keys[:, k]) * np.uint64(0xD1342543DE82EF95)
        return h ^ (h >> np.uint64(32))

    def _find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Entries of keys, -1 for those that aren't there."""
        mask = np.uint64(len(self.slots) - 1)
        out, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (hashes & mask).astype(np.int64)
        while len(todo):
            entry = self.slots[slot]
            full = entry >= 0
            have = self.keys[entry]
            want = keys[todo]
            same = full & (have[:, 0] == want[:, 0]) & (have[:, 1] == want[:, 1]) & (have[:, 2] == want[:, 2]) & (have[:, 3] == want[:, 3])
            out[todo[same]] = entry[same]
            on = full & ~same
            todo, slot = todo[on], (slot[on] + 1) & int(mask)
        return out

    def _add(self, pieces: list[bytes], keys: np.ndarray | None = None) -> np.ndarray:
        """New entries of pieces, none of which is there: their numbers."""
        texts = [p.decode() for p in pieces]
        found: list[np.ndarray] = []
        sizes, order = np.zeros(len(pieces), np.int64), []
        letters = [i for i, t in enumerate(texts) if _LETTERS.fullmatch(t)] if self.encode_words else []
        rest = sorted(set(range(len(texts))).difference(letters))
        for words, encode in ((letters, self.encode_words), ([i for i in rest if _ONE_WORD.fullmatch(texts[i])], lambda some: self.encode_text("".join(some)))):
            for i in range(0, len(words), self.TOGETHER):
                some = words[i : i + self.TOGETHER]
                ids = encode([texts[k] for k in some])
                cuts = np.flatnonzero(self.starts[ids])
                if len(cuts) != len(some):
                    raise ValueError("words that aren't parted by blanks")
                found.append(ids)
                sizes[some] = np.diff(np.append(cuts, len(ids)))
            order += words
        for k in set(rest).difference(order):
            ids = self.encode_text(texts[k]) if texts[k] else np.zeros(0, np.uint32)
            found.append(ids)
            order.append(k)
            sizes[k] = len(ids)
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        n, m = self.n + len(pieces), self.n_pool + len(ids)
        for name, need in (("keys", n), ("first", n), ("size", n), ("pool", m)):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate([have, np.zeros((max(need, 2 * len(have)) - len(have), *have.shape[1:]), have.dtype)]))
        entries = np.arange(self.n, n)
        self.pool[self.n_pool : m] = ids
        at = np.array(order, np.int64)
        self.size[entries] = sizes
        self.first[self.n + at] = self.n_pool + np.cumsum(sizes[at]) - sizes[at]
        if keys is not None:
            self.keys[entries] = keys
        self.n, self.n_pool = n, m
        return entries

    def _keep(self, entries: np.ndarray, hashes: np.ndarray) -> None:
        mask, slot = len(self.slots) - 1, (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & mask

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of texts in order: the ids of all of them in a row, and their number for each text."""
        for i, j in blocks(texts, 1 << 20):
            yield self._block(texts[i:j])

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [t.encode() for t in texts]
        ends = np.cumsum([len(d) for d in data])
        joined = b"".join(data)
        total = len(joined)
        padded = joined + bytes(40)
        chars = np.frombuffer(joined, np.uint8)
        cut = self.BLANK[chars]
        if total > 2:
            apart = self.MARK[chars[1:-1]] & self.LETTER[chars[:-2]] & self.BLANK[chars[2:]]
            cut[1:-1] |= apart
        for k, t in enumerate(texts):
            parts = [len(data[k])] if any(w in t for w in self.whole) else careful_cuts(t)
            if parts is not None:
                a = int(ends[k]) - len(data[k])
                cut[a : int(ends[k])] = False
                cut[a + np.cumsum(parts)[:-1]] = True
        cut[(ends - [len(d) for d in data])[[len(d) > 0 for d in data]]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, total))
        eights = np.ndarray((total + 32,), "<u8", padded, strides=(1,))
        keys = np.empty((len(start), 4), np.uint64)
        for k in range(4):
            keys[:, k] = eights[np.minimum(start + 8 * k, total)] & self.MASKS[np.clip(size - 8 * k, 0, 8)]
        short = size <= self.LONG
        keys[:, 3] |= np.where(short, size, 0).astype(np.uint64) << np.uint64(56)
        hashes = self._hash(keys)
        before, before_pool = self.n, self.n_pool
        entry = np.full(len(start), -1, np.int64)
        some = np.flatnonzero(short)
        entry[some] = self._find(keys[some], hashes[some])
        new = some[entry[some] < 0]
        fresh = None
        if len(new):
            h, at, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            if not (keys[new] == keys[new[at]][back]).all():  # two pieces of one hash
                _, at, back = np.unique(keys[new], axis=0, return_index=True, return_inverse=True)
            at = new[at]
            fresh = self._add([joined[s : s + n] for s, n in zip(start[at].tolist(), size[at].tolist())], keys[at]), hashes[at]
            entry[new] = fresh[0][back]
        longer = {}
        if (rest := np.flatnonzero(~short)).size:
            parts = [joined[s : s + n] for s, n in zip(start[rest].tolist(), size[rest].tolist())]
            todo = list(dict.fromkeys(p for p in parts if p not in self.long))
            longer = dict(zip(todo, self._add(todo).tolist()))
            entry[rest] = [self.long[p] if p in self.long else longer[p] for p in parts]
        n_ids = self.size[entry]
        sums = np.concatenate([[0], np.cumsum(n_ids)])
        ids = self.pool[np.repeat(self.first[entry] - sums[:-1], n_ids) + np.arange(sums[-1])]
        if self.n <= self.limit:
            if fresh is not None:
                self._keep(*fresh)
            self.long.update(longer)
        else:
            self.n, self.n_pool = before, before_pool
        places = np.searchsorted(start, np.concatenate([[0], ends]))
        return ids, np.diff(sums[places])

    def encode_each(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for ids, n in self.encode(texts):
            data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            for s, e in zip([0, *ends], ends):
                yield data[s:e]
