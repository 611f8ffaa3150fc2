"""Append-only result logs as streams: exactly-once appends, duplicates dropped, running rates, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files: int = 100) -> DataFrame:
    """A folder of files as a stream; times without zone become timestamps, which watermarks ask for."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)})


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """First rows of each key within the delay; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there now goes to the log, once, also after a restart."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _latest(agg: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The state of an aggregation after all that is there now: every batch replaces a table, and only tables are kept,
    so nothing of the state passes through the driver. A batch that runs again writes the same folder again."""
    written: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        written.append(f"{path}/{number}")

    query = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = agg.sparkSession
    return spark.read.schema(agg.schema).parquet(written[-1]) if written else spark.createDataFrame([], agg.schema)


def running_rates(stream: DataFrame, condition: str, outcome: str, path: str, checkpoint: str) -> DataFrame:
    """Count and rate by condition after all that is there now."""
    return _latest(stream.groupBy(condition).agg(F.count("*").alias("n"), F.avg(F.expr(outcome).cast("int")).alias("rate")), path, checkpoint)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, slide: str, path: str, checkpoint: str) -> DataFrame:
    """Rows by time window and key after all that is there now; all windows are kept."""
    return _latest(stream.groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n")), path, checkpoint)
