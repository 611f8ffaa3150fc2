"""Raw payloads as a PySpark data source, and the registry of adapters that turn them into facts.

    spark.dataSource.register(PayloadSource)
    spark.read.format("payloads").option("lines", True).load("hdfs://.../sec")      # path, envelope
    load(spark, root, "SEC", contact="team@example.org")                            # facts

A partition reads files of about BUNDLE bytes in all, at least one, through the file system of their URI. A file is one
envelope (request_url, retrieved_at, payload), or one on each line with the option lines; files of lines of more than BUNDLE
bytes are split, so that no task has a whole large one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.sources import adapters

BUNDLE = 32 << 20
SUFFIXES = (".json", ".jsonl", ".txt")
ENVELOPE = "request_url string, retrieved_at string, payload string, _corrupt_record string"


class Bundle(InputPartition):
    """Whole files, or the lines that begin in a range of the bytes of one file."""

    def __init__(self, files: list[str], start: int = 0, end: int | None = None):
        self.files, self.start, self.end = files, start, end


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    # Hadoop writes local paths with one slash or three.
    return pyarrow.fs.FileSystem.from_uri("file://" + uri.removeprefix("file:").removeprefix("//") if uri.startswith("file:") or "://" not in uri else uri)


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.lines = options["path"], options.get("lines", "false").lower() == "true"

    def partitions(self) -> list[Bundle]:
        system, root = _file_system(self.path)
        if system.get_file_info(root).type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(f"no payloads at {self.path}")
        found = [root] if system.get_file_info(root).is_file else pyarrow.fs.FileSelector(root, recursive=True)
        infos = system.get_file_info(found)
        out, size, split = [], BUNDLE, []
        for info in sorted(infos, key=lambda i: i.path):
            if info.is_file and info.base_name.endswith(SUFFIXES) and not info.base_name.startswith(("_", ".")):
                if self.lines and (info.size or 0) > BUNDLE:
                    split += [Bundle([info.path], at, min(at + BUNDLE, info.size)) for at in range(0, info.size, BUNDLE)]
                    continue
                if size >= BUNDLE:
                    out, size = [*out, []], 0
                out[-1].append(info.path)
                size += info.size or 0
        return [Bundle(files) for files in out] + split or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        for file in partition.files:
            if not self.lines:
                with system.open_input_stream(file) as stream:
                    yield self._batch([file], [stream.read().decode()])
                continue
            with system.open_input_file(file) as stream:
                yield from self._lines(file, stream, partition.start, partition.end)

    def _lines(self, file: str, stream: pa.NativeFile, start: int, end: int | None) -> Iterator[pa.RecordBatch]:
        """Lines that begin at start or later and before end, each named by the byte at which it begins."""
        at, left = max(0, start - 1), b""
        stream.seek(at)
        skip = start > 0  # up to the end of the line that began before
        while block := stream.read(1 << 20):
            *whole, left = (left + block).split(b"\n")
            paths, texts = [], []
            for line in whole:
                if not skip:
                    if end is not None and at >= end:
                        break
                    paths.append(f"{file}#{at:015d}")
                    texts.append(line.decode())
                skip, at = False, at + len(line) + 1
            if paths:
                yield self._batch(paths, texts)
            if end is not None and at >= end:
                return
        if left and not skip and (end is None or at < end):
            yield self._batch([f"{file}#{at:015d}"], [left.decode()])

    @staticmethod
    def _batch(paths: list[str], texts: list[str]) -> pa.RecordBatch:
        kept = [k for k, t in enumerate(texts) if t.strip()]
        return pa.RecordBatch.from_arrays([pa.array([paths[k] for k in kept], pa.string()), pa.array([texts[k] for k in kept], pa.string())], ["path", "envelope"])


class PayloadSource(DataSource):
    """Format payloads: path and text of each envelope below a folder, or of one file."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "path string, envelope string"

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options)


def raw(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Envelopes, as the adapters take them; a corrupt one is an error that names its file."""
    spark.dataSource.register(PayloadSource)
    d = spark.read.format("payloads").option("lines", str(lines).lower()).load(path)
    d = d.select("path", F.from_json("envelope", ENVELOPE, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    broken = F.col("e._corrupt_record").isNotNull() | (F.col("e.payload").isNull() & F.col("e.request_url").isNull())
    payload = F.when(broken, F.raise_error(F.concat(F.lit("corrupt raw payload "), "path"))).otherwise(F.col("e.payload"))
    return d.select("path", "e.request_url", "e.retrieved_at", payload.alias("payload"))


class Adapter(NamedTuple):
    normalize: Callable[..., DataFrame]
    #: Why the adapter must not run with some parameters, or None.
    blocked: Callable[[dict], str | None]


REGISTRY: dict[str, Adapter] = {}


def register(domain: str, normalize: Callable[..., DataFrame], blocked: Callable[[dict], str | None] = lambda params: None) -> None:
    REGISTRY[domain] = Adapter(normalize, blocked)


def adapter(domain: str) -> Adapter:
    if domain not in REGISTRY:
        raise KeyError(f"no adapter of domain {domain}; there are {', '.join(available())}")
    return REGISTRY[domain]


def available() -> list[str]:
    return sorted(REGISTRY)


def load(spark: SparkSession, root: str, domain: str, lines: bool = False, contact: str | None = None, **params) -> DataFrame:
    """Facts of a domain's payloads, which lie in the folder of its name in lower case below root. What the adapter's gate
    says against its parameters is an error."""
    own = adapter(domain)
    if reason := own.blocked({"contact": contact, **params}):
        raise PermissionError(reason)
    return own.normalize(raw(spark, f"{root.rstrip('/')}/{domain.lower()}", lines), **params)


def _no_contact(params: dict) -> str | None:
    return None if "@" in (params.get("contact") or "") else "this source asks for a contact address; pass contact='you@your.org'"


register("SEC", adapters.sec, _no_contact)
register("FDA", adapters.fda)
register("CLINICAL_TRIALS", adapters.clinical_trials)
register("FRED", adapters.fred, lambda params: None if params.get("catalog") is not None else "a catalog of series is needed")
register("WORLD_BANK", adapters.world_bank)
