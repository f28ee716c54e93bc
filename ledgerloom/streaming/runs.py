"""Running a stream over what is there: a query's rows come back as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def read_files(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files at a path, so many of them a batch. The path may be a single file, which a stream takes
    as a pattern only."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(f"{path}*")


def appended(stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream has added once everything available is read."""
    folder = shared_folder(stream.sparkSession, name)
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def updated(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last row of every key of a stream in update mode, once everything available is read.

    Every batch has a folder of its own, so one that is run again replaces what it had written."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, name)
    fields = stream.columns

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("r.*")
