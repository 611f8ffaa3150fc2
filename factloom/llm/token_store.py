"""Content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts each document's id stream into chunks, so equal passages give equal chunks
wherever they stand. A chunk's key is the BLAKE2b digest of its bytes; each key is stored once. A recipe row lists the
keys of a document in order; recipes stand in ascending document order with the running start of the stream. A Merkle
root over the recipes of each part is kept in a manifest, and one over the manifest's rows beside it. Reading back
checks every chunk against its key, every recipe against its leaf digest, and every part's recipes against the manifest.

Layout under path: parts/is_chunk=true (key, payload, copies), recipes/ (part, doc_id, start, n_tokens, keys, leaf), manifest/ (part,
first_start, n_docs, n_tokens, root), root/ (n_parts, root). Payloads are little-endian unsigned 16-bit ids where the
vocabulary allows it, else 32-bit.

Texts are encoded as the library does by default: a string that its file names as a special token is that token. Null
and empty texts give one document of the end id alone; very long texts are a block of their own, and their chunks are rows
like others. Repeated rows, also of one doc_id, each get a recipe; rows of equal doc_id follow each other in the order of their leaf digests. Null ids sort first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import PieceCache, cut, slices

WINDOW, MEAN, LEAST, MOST = 8, 256, 64, 2048
_LOADED: dict[str, PieceCache] = {}


def tokenizer(path: str) -> PieceCache:
    """The tokenizers library's encoder for the file at path, one for each worker process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        inner = Tokenizer.from_file(path)
        starts = np.zeros(inner.get_vocab_size(), bool)
        for token, i in inner.get_vocab().items():
            starts[i] = token[0] in "\u0120\u010a"  # how byte-level vocabularies write a blank and a line feed
        added = tuple(t.content for t in inner.get_added_tokens_decoder().values())

        def encode(text: str) -> np.ndarray:
            return np.array(inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

        _LOADED[path] = PieceCache(encode, starts, limit=2_000_000, whole=added, encode_words=word_encoder(inner))
    return _LOADED[path]


def word_encoder(inner) -> Callable[[list[str]], np.ndarray] | None:
    """Encodes words of a blank and letters, which a byte-level pre-tokenizer leaves whole: they go to the same model
    written as its vocabulary writes bytes, parted by a separator, without the search for words. None for other tokenizers."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import Split

    stated = json.loads(inner.to_str())
    pre = stated["pre_tokenizer"] or {}
    if stated["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or stated["model"]["type"] != "BPE":
        return None
    stated |= {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}
    bare = Tokenizer.from_str(json.dumps(stated))
    bare.pre_tokenizer = Split("\n", "removed")
    # Bytes that such vocabularies write as other characters, 256 and on, in order of the bytes.
    odd = {bytes([b]).decode("latin-1"): chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
    odd.pop("\n")

    def encode(words: list[str]) -> np.ndarray:
        text = "\n".join(words).encode().decode("latin-1")
        for a, b in odd.items():
            if a in text:
                text = text.replace(a, b)
        return np.array(bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    return encode


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids asks for a cut. Over several texts in a row as well:
    a text's first LEAST ids, which include all windows that reach into the text before, are never cut."""
    n = len(ids)
    rolled, power = np.zeros(n, np.uint64), 1
    for k in range(min(WINDOW, n)):
        rolled[k:] += ids[: n - k].astype(np.uint64) * np.uint64(power)
        power = power * 0xD1342543DE82EF95 % (1 << 64)
    mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return np.flatnonzero((mixed >> np.uint64(64 - MEAN.bit_length() + 1)) == 0) + 1


def between(wanted: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the text at start to stop: at the wanted places, LEAST to MOST ids apart, and at its end."""
    out, last = [], start
    for end in [*wanted, stop]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last and (end - last >= LEAST or end == stop):
            out.append(end)
            last = end
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    return between(marks(ids).tolist(), 0, len(ids))


def key_of(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def write(docs: DataFrame, path: str, encoder: Callable[[], PieceCache], end_id: int, vocabulary: int, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encode each text of docs, append end_id, and write the store at path, which holds nothing yet."""
    spark, width = docs.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"

    def rows(batches):
        cache = encoder()
        size = np.dtype(width).itemsize
        for batch in slices(batches):
            doc_ids, texts, at = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()], 0
            for ids, counts in cache.encode(texts):
                out: list[tuple] = []
                ids = np.insert(ids, np.cumsum(counts), end_id)
                packed, wanted, ends = ids.astype(width).tobytes(), marks(ids), np.cumsum(counts + 1)
                places = np.searchsorted(wanted, ends).tolist()
                wanted, start, first = wanted.tolist(), 0, 0
                for doc_id, stop, place in zip(doc_ids[at : at + len(ends)], ends.tolist(), places):
                    keys, last = [], start
                    for end in between(wanted[first:place], start, stop):
                        payload = packed[last * size : end * size]
                        keys.append(key_of(payload))
                        out.append((True, keys[-1], None, None, payload))
                        last = end
                    recipe = b"".join(keys)
                    out.append((False, key_of(repr(doc_id).encode() + recipe), doc_id, stop - start, recipe))
                    start, first = stop, place
                at += len(ends)
                yield arrow(out)

    def arrow(out):
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["is_chunk", "key", "doc_id", "n_tokens", "payload"])

    # One shuffle for both, by keys that follow from the content alone, so a task that is run again sends its rows to the
    # same places: equal chunks meet (already once per map task), and so do equal recipes of one doc_id, which are counted.
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(rows, "is_chunk boolean, key binary, doc_id long, n_tokens long, payload binary")
    once = raw.groupBy("is_chunk", "key").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_tokens", "payload")], F.count("*").alias("copies"))
    once.write.option("compression", "zstd").partitionBy("is_chunk").parquet(f"{path}/parts")
    recipes = _parts(spark, path, False)
    ordered = recipes.select("doc_id", "n_tokens", F.col("payload").alias("keys"), F.sha2("payload", 256).alias("leaf"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(ordered.repartitionByRange(parts, "doc_id", "leaf").sortWithinPartitions("doc_id", "leaf").withColumn("part", F.spark_partition_id()))
    # Parts follow each other in doc_id order: one row for each part gives the starts.
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"), F.count("*").alias("n_docs"))
    before = sums.withColumn("first_start", F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    firsts = {r.part: (r.first_start, r.n_docs, r.part_tokens) for r in before.toLocalIterator()}  # as many rows as partitions

    def with_starts(batches):
        start = None
        for batch in batches:
            n = batch.column("n_tokens").to_numpy().astype(np.int64)
            if not len(n):
                continue
            if start is None:
                start = firsts[batch.column("part")[0].as_py()][0]
            begin = start + np.cumsum(n) - n
            start = int(begin[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pa.array(begin), batch.column("n_tokens"), batch.column("keys"), batch.column("leaf")], ["part", "doc_id", "start", "n_tokens", "keys", "leaf"])

    placed = ordered.mapInArrow(with_starts, "part int, doc_id long, start long, n_tokens long, keys binary, leaf string")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    merkle(spark.read.parquet(f"{path}/recipes"), parts).write.parquet(f"{path}/manifest")
    stated = spark.read.parquet(f"{path}/manifest").collect()  # as many rows as partitions
    spark.createDataFrame([(len(stated), root_over(stated))], "n_parts long, root binary").coalesce(1).write.parquet(f"{path}/root")


def _parts(spark: SparkSession, path: str, chunks: bool) -> DataFrame:
    rows = spark.read.schema("key binary, doc_id long, n_tokens long, payload binary, copies long, is_chunk boolean").parquet(f"{path}/parts")
    return rows.filter(F.col("is_chunk") == chunks)


class Tree:
    """Merkle root of digests given one by one: levels of pairs, hashed together, the last one alone if odd moves up.

    Only the roots of full subtrees are held, one for each bit of the number of leaves."""

    def __init__(self):
        self.full: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, digest = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.full and self.full[-1][0] == height:
            digest = hashlib.sha256(b"\1" + self.full.pop()[1] + digest).digest()
            height += 1
        self.full.append((height, digest))

    def root(self) -> bytes:
        digests = [d for _, d in self.full]
        out = digests.pop() if digests else hashlib.sha256().digest()
        while digests:
            out = hashlib.sha256(b"\1" + digests.pop() + out).digest()
        return out


def merkle(recipes: DataFrame, partitions: int) -> DataFrame:
    """part, first_start, n_docs, n_tokens, root: for each part the root over its recipes in order of their starts.

    A recipe's digest covers all its columns; its keys come in through their own digest, which is taken anew."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "start", "n_tokens", "leaf")]
    digest = F.unhex(F.sha2(F.concat_ws("|", *columns, F.coalesce(F.sha2("keys", 256), F.lit("null"))), 256))
    rows = recipes.select("part", "start", "n_tokens", digest.alias("digest"))

    def roots(batches):
        part, out = None, []
        first, n_docs, n_tokens, tree = None, 0, 0, Tree()
        for batch in slices(batches):
            for p, start, n, d in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part or not n_docs:
                    if n_docs:
                        out.append((part, first, n_docs, n_tokens, tree.root()))
                    part, first, n_docs, n_tokens, tree = p, start, 0, 0, Tree()
                n_docs, n_tokens = n_docs + 1, n_tokens + (n or 0)
                tree.add(d)
        if n_docs:
            out.append((part, first, n_docs, n_tokens, tree.root()))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "first_start", "n_docs", "n_tokens", "root"])

    placed = rows.repartition(partitions, "part").sortWithinPartitions("part", "start", "digest")
    return placed.mapInArrow(roots, "part int, first_start long, n_docs long, n_tokens long, root binary")


def root_over(manifest: list) -> bytes:
    """The root over a manifest's rows in order of their parts."""
    tree = Tree()
    for r in sorted(manifest, key=lambda r: r.part):
        tree.add(f"{r.part}|{r.first_start}|{r.n_docs}|{r.n_tokens}|{r.root.hex()}".encode())
    return tree.root()


def sound_parts(spark: SparkSession, path: str) -> list[int]:
    """The parts whose recipes, read back, give their row of the manifest. None is sound if the manifest doesn't give
    the root over it, or names a part without recipes: such a loss shows in no part's own rows."""
    stated = spark.read.parquet(f"{path}/manifest").collect()  # as many rows as partitions
    now = {r.part: r for r in merkle(spark.read.parquet(f"{path}/recipes"), max(1, len(stated))).toLocalIterator()}
    over = spark.read.parquet(f"{path}/root").collect()
    if [(r.n_parts, bytes(r.root)) for r in over] != [(len(stated), root_over(stated))] or any(r.part not in now for r in stated):
        return []
    return [r.part for r in stated if r == now[r.part]]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reversed as in CRC-32."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


_SHIFTS: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    if n_bytes not in _SHIFTS:
        out, square, n = 0x80000000, 0x00800000, n_bytes  # 1 and x**8
        while n:
            if n & 1:
                out = _times(out, square)
            square, n = _times(square, square), n >> 1
        _SHIFTS[n_bytes] = out
    return _SHIFTS[n_bytes]


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings joined, from the (crc, length) of each."""
    crc = 0
    for c, n in parts:
        crc = _times(_shift(n), crc) ^ c
    return crc


def read(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over 32-bit ids), verified, from the store's files alone.

    Every stored chunk is read once, held against its key and widened to 32 bits; only its checksum travels to the
    recipes that name it, where checksums join by the algebra of CRC-32. verified: all chunks are there, match their
    keys and lengths, the recipe matches its leaf digest, and its part is sound: no recipe of it was lost, added or
    changed. Parts are checked when this is called."""
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def check(batches):
        for batch in batches:
            crcs, sizes, good = [], [], []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(payload, width).astype("<u4").tobytes()
                crcs.append(zlib.crc32(data))
                sizes.append(len(data))
                good.append(key == key_of(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(good, pa.bool_())], ["key", "crc", "size", "good"])

    chunks = _parts(spark, path, True).select("key", "payload").mapInArrow(check, "key binary, crc long, size long, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    # start and leaf tell recipes apart: starts differ since every document has at least its end id
    parts = recipes.select("start", F.posexplode(F.expr("transform(sequence(0, length(keys) div 16 - 1), i -> substring(keys, 16 * i + 1, 16))")).alias("i", "key"))
    found = parts.join(chunks, "key", "left").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("i", "crc", "size", "good"))).alias("x"))

    @F.pandas_udf("long")
    def joined(crc: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else crc32_joined(list(zip(map(int, c), map(int, n)))) for c, n in zip(crc, size)], dtype="Int64")

    whole = F.expr("forall(x, p -> coalesce(p.good, false))")
    checked = found.select("start", whole.alias("whole"), joined(F.when(whole, F.col("x.crc")), F.when(whole, F.col("x.size"))).alias("ids_crc32"), F.expr("aggregate(x, 0L, (a, p) -> a + coalesce(p.size, 0))").alias("bytes"))
    out = recipes.join(checked, "start", "left")  # a recipe without keys names no chunk
    sound = F.array_contains(F.lit(np.array(sound_parts(spark, path), np.int32)), F.col("part"))
    good = sound & F.col("whole") & (F.col("bytes") == 4 * F.col("n_tokens")) & (F.sha2("keys", 256) == F.col("leaf"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", F.coalesce(good, F.lit(False)).alias("verified"))


def reconstruct(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, start, ids array<int>: the id streams themselves. Raises an error if a part isn't sound."""
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    @F.pandas_udf("array<int>")
    def unpacked(payload: pd.Series) -> pd.Series:
        return payload.map(lambda x: np.frombuffer(b"".join(x), width).astype(np.int32))

    chunks = _parts(spark, path, True).select("key", "payload")
    recipes = spark.read.parquet(f"{path}/recipes")
    sound = sound_parts(spark, path)
    if not recipes.filter(~F.coalesce(F.array_contains(F.lit(np.array(sound, np.int32)), F.col("part")), F.lit(False))).isEmpty():
        raise ValueError(f"recipes at {path} don't match the manifest")
    parts = recipes.select("doc_id", "start", F.posexplode(F.expr("transform(sequence(0, length(keys) div 16 - 1), i -> substring(keys, 16 * i + 1, 16))")).alias("i", "key"))
    found = parts.join(chunks, "key").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("i", "payload"))).alias("x"))
    return found.select("doc_id", "start", unpacked(F.col("x.payload")).alias("ids"))
