"""Scans and sinks: JSON lines, typed tables, CSV, Parquet mirrors, append logs, hashes and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import selection

#: Fields that differ between runs over the same data.
VOLATILE = ("generated_at", "retrieved_at")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed one is an error, a missing file has no rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line: the lines that a schema cannot read, instead of an error."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter("trim(line) <> ''")
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.filter(parsed["_bad"].isNotNull())


def to_json_lines(df: DataFrame) -> DataFrame:
    """One column, value: each row as JSON with sorted keys, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> int:
    to_json_lines(df).write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path).count()


def append_log(df: DataFrame, path: str) -> None:
    to_json_lines(df).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The given fields in order, missing ones empty, others left out."""
    df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, booleans: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with header; the named columns are true where their text is "true" in any case."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({b: F.coalesce(F.lower(b) == "true", F.lit(False)) for b in booleans})


def write_mirror(df: DataFrame, path: str, drop: tuple[str, ...] = (), union: str | None = None) -> None:
    """Parquet with its nested columns; of a column of text or numbers also a numeric twin."""
    df = df.drop(*drop)
    if union:
        df = df.withColumn(f"{union}_numeric", F.col(union).try_cast("double"))
    df.write.mode("overwrite").parquet(path)


def row_hash(df: DataFrame, drop: tuple[str, ...] = VOLATILE) -> Column:
    keep = sorted(c for c in df.columns if c not in drop)
    return F.sha2(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}), 256)


def digest_sums(row_digest: Column) -> list[Column]:
    """Sums of the parts of SHA-256 digests: they depend on the rows, repeats counted, and on no order of them."""
    return [F.coalesce(F.sum(F.conv(F.substring(row_digest, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"part{i}") for i in range(5)]


def content_hash(df: DataFrame, drop: tuple[str, ...] = VOLATILE) -> str:
    """A hash of a table's rows without volatile fields, whatever their order and files: one aggregation of row digests."""
    row = df.agg(F.count("*").alias("n"), *digest_sums(row_hash(df, drop))).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str, crlf: bool = False) -> DataFrame:
    """name, bytes, sha256 of the files below path; with crlf, line ends count as line feeds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    body = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n") if crlf else F.col("content")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2(body.cast("binary"), 256).alias("sha256"))


def write_domains(facts: DataFrame, path: str) -> None:
    """A stage's facts by domain, each file in order of record ids."""
    facts.repartitionByRange("domain", "record_id").sortWithinPartitions("domain", "record_id").write.mode("overwrite").partitionBy("domain").parquet(path)


def sorted_files(spark: SparkSession, path: str, key: str, by: str) -> DataFrame:
    """by, n, first, last, sorted of a table of files: whether each file's rows stand in order of a text key, by its bytes. A
    task tells of the rows of a file in each batch their place, their least, greatest, first and last key and whether they
    are in order; only these are shuffled. Files go by 64-bit hashes of their paths, as a path is longer than a row."""
    file = F.xxhash64("_metadata.file_path")
    back = spark.read.parquet(path).select(F.col(by), file.alias("file"), F.col("_metadata.row_index").alias("place"), F.col(key).alias("key"))
    schema = "file long, place long, n long, least string, greatest string, head string, tail string, ordered boolean"
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, place, out = batch["file"].to_numpy(), batch["place"].to_numpy(), []
            cuts = ((np.diff(place) != 1) | (np.diff(file) != 0)).nonzero()[0] + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if b > a:
                    keys = batch["key"][a:b]
                    ordered, ends = pc.all(pc.greater_equal(keys[1:], keys[:-1])).as_py(), pc.min_max(keys)
                    values = (int(file[a]), int(place[a]), int(b - a), ends["min"].as_py(), ends["max"].as_py(), keys[0].as_py(), keys[-1].as_py(), ordered)
                    out.append(dict(zip(arrow.names, values)))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = back.select("file", "place", "key").mapInArrow(runs, schema)
    before = F.lag("tail").over(Window.partitionBy("file").orderBy("place"))
    found = found.withColumn("ordered", F.coalesce("ordered", F.lit(True)) & F.coalesce(F.col("head") >= before, F.lit(True)))
    files = found.groupBy("file").agg(F.sum("n").alias("n"), F.min("least").alias("first"), F.max("greatest").alias("last"), F.bool_and("ordered").alias("sorted"))
    return files.join(back.select("file", by).distinct(), "file").groupBy(by).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.bool_and("sorted").alias("sorted"))


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """A table whose files hold ranges of keys, so that a lookup reads one row group."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, key: dict) -> DataFrame:
    """The rows of a key; its parts are pushed down to the scan."""
    df = spark.read.parquet(path)
    for k, v in key.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small JSON document, keys sorted and indented, in any store that Spark writes to."""
    text = json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).filter("trim(value) <> ''").first()[0])


def tree_hash(files: DataFrame) -> str:
    """One hash over names and digests of files (name, sha256), in order of the names; a line for each file."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "sha256"))), "\n")
    return files.agg(F.sha2(lines, 256)).first()[0]


def manifest(spark: SparkSession, root: str, names: list[str]) -> list:
    """name, n_rows, n_bytes, tree_hash of each table below root. Each file is read as a whole: for the files of artifacts,
    which are small; large tables have content_hash."""
    out = []
    for name in names:
        files = file_hashes(spark, f"{root}/{name}").filter("name not like '\\_%' and name not like '.%'")
        out.append(Row(name=name, n_rows=spark.read.parquet(f"{root}/{name}").count(), n_bytes=files.agg(F.sum("bytes")).first()[0], tree_hash=tree_hash(files)))
    return out


def frozen_changes(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """name, status (missing, added, changed) of what differs between two tables of name and sha256."""
    both = frozen.select("name", F.col("sha256").alias("old")).join(now.select("name", F.col("sha256").alias("new")), "name", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").otherwise("changed")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("name", status.alias("status"))


def upsert_retrievals(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of each domain's retrieval: new rows replace old ones."""
    return selection.upsert(old, new, ["domain"]).orderBy("domain")


def run_config(text: str, env: dict[str, str] | None = None) -> dict:
    """A YAML (or JSON) configuration with ${NAME:-default} filled in from the environment, wherever texts stand in it; a
    value that is nothing but one such name is read as YAML again, so numbers stay numbers."""
    import yaml

    env = os.environ if env is None else env
    name = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")

    def filled(v):
        if isinstance(v, dict):
            return {k: filled(x) for k, x in v.items()}
        if isinstance(v, list):
            return [filled(x) for x in v]
        if not isinstance(v, str):
            return v
        out = name.sub(lambda m: env.get(m[1]) or m[2] or "", v)
        return yaml.safe_load(out) if name.fullmatch(v.strip()) and out else out

    return filled(yaml.safe_load(text)) or {}


def config_hash(config: dict, drop: tuple[str, ...] = ()) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if k not in drop}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
