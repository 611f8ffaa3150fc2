"""Tables that are replaced as a whole: each version is a folder of its own, and one small pointer file, replaced by an atomic
rename, names the current one. A reader that has followed the pointer keeps its version whatever writers do; a writer that
dies before the rename leaves a folder that nothing points to.

    commit(df, root)                      # the first version, or an error where there is one
    commit(df, root, replaces=current)    # only if current is still what the pointer names
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, root: str):
    """(the file context of root's store, a function from names below root to paths)."""
    jvm = spark.sparkContext._jvm
    path = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *names]))
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path().toUri(), spark.sparkContext._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the current version, None where there is none."""
    files, path = _hadoop(spark, root)
    if not files.util().exists(path(POINTER)):
        return None
    return json.loads(spark.read.text(f"{root.rstrip('/')}/{POINTER}").first().value)["version"]


def stage(df: DataFrame, root: str) -> str:
    """Writes a version that nothing points to yet; returns its name."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root.rstrip('/')}/{name}")
    return name


def publish(spark: SparkSession, root: str, version: str, replaces: str | None = None) -> None:
    """Lets the pointer name version. An error where the pointer isn't what replaces says (None: no pointer), or where the
    version was not written to its end."""
    files, path = _hadoop(spark, root)
    if not files.util().exists(path(version, "_SUCCESS")):
        raise FileNotFoundError(f"{version} below {root} is not a whole version")
    if (now := current(spark, root)) != replaces:
        raise FileExistsError(f"{root} is at {now}, not at {replaces}")
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options
    fresh = path(f".{POINTER}-{uuid.uuid4().hex}")
    flags = spark.sparkContext._jvm.java.util.EnumSet.of(spark.sparkContext._jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(fresh, flags, spark.sparkContext._gateway.new_array(getattr(options, "CreateOpts"), 0))
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    rename[0] = getattr(options, "Rename").OVERWRITE
    files.rename(fresh, path(POINTER), rename)


def commit(df: DataFrame, root: str, replaces: str | None = None) -> str:
    """Writes df and makes it the current version; returns its name. The guard is looked at before anything is written, too."""
    spark = df.sparkSession
    if (now := current(spark, root)) != replaces:
        raise FileExistsError(f"{root} is at {now}, not at {replaces}")
    version = stage(df, root)
    publish(spark, root, version, replaces)
    return version


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current version, or the named one."""
    version = version or current(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version at {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{version}")


def discard(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> int:
    """Removes the versions that are neither current nor kept; returns their number. Not for stores with writers at work."""
    files, path = _hadoop(spark, root)
    held, gone = {current(spark, root), *keep}, 0
    for status in files.util().listStatus(path()):
        name = status.getPath().getName()
        if (name.startswith("v-") and name not in held) or name.startswith(f".{POINTER}-"):
            files.delete(status.getPath(), True)
            gone += name.startswith("v-")
    return gone
