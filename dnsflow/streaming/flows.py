"""Continuous statistics, landing folders, rotated output and delivery with a fallback."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsflow.functions.codes import file_name_parts
from dnsflow.operators.filters import queries_only
from dnsflow.operators.stats import _counters, with_total

TRIES = 3


def stream_stats(messages: DataFrame, unit_s: int = 1, delay: str = "10 seconds") -> DataFrame:
    """The six counters per tick of a streaming `messages`; ticks close with the watermark."""
    rows = queries_only(messages.withWatermark("ts", delay))
    counted = rows.groupBy(F.window("ts", f"{unit_s} seconds").alias("window")).agg(*_counters())
    tick = F.floor(F.unix_seconds(F.col("window.start")) / unit_s).cast("bigint")
    return with_total(counted).select(tick.alias("tick"), *counted.columns[1:], "queries")


def stream_landing_dir(
    spark: SparkSession, path: str, file_format: str, schema, max_files: int | None = None
) -> DataFrame:
    """New complete files of a folder as a stream, with what their names say.

    Files still arriving carry the suffix `.part` and are not matched.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    reader = reader.option("pathGlobFilter", f"*.{{{file_format},{file_format}.gz}}")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    name = F.col("_metadata.file_name")
    parts = [c.alias(f"file_{n}") for n, c in file_name_parts(name).items()]
    return reader.load(path).select("*", name.alias("file_name"), *parts)


def late_messages(messages: DataFrame, watermark: Column) -> DataFrame:
    """Messages at or before the watermark: too late to find a partner."""
    return messages.filter(F.col("ts") <= watermark)


def rotated(df: DataFrame, path: str, checkpoint: str, every_s: int = 60, ts: str = "ts",
            trigger: dict | None = None):
    """Writes a stream so that output folders change every `every_s` seconds of event time."""
    start = F.window(ts, f"{every_s} seconds")["start"]
    return (
        df.withColumn("rotation", F.date_format(start, "yyyyMMdd.HHmmss"))
        .writeStream.format("parquet").partitionBy("rotation")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{every_s} seconds"}))
        .start()
    )


class Unsent:
    """Batches that no target took, kept in a shared folder until one does, also across restarts."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folder(self, spark: SparkSession, name: str = ""):
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, spark: SparkSession) -> list[int]:
        """The numbers of the batches that are kept, in order; one that was not written to its end does not count."""
        place, system = self._folder(spark)
        if not system.exists(place):
            return []
        names = [x.getPath().getName() for x in system.listStatus(place)]
        done = [n for n in names if system.exists(self._folder(spark, f"{n}/_SUCCESS")[0])]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("batch="))

    def keep(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/batch={number}")

    def drop(self, spark: SparkSession, number: int) -> None:
        place, system = self._folder(spark, f"batch={number}")
        system.delete(place, True)


def deliver(
    primary: Callable[[DataFrame, int], None],
    backup: Callable[[DataFrame, int], None] | None = None,
    tries: int = TRIES,
    wait_s: float = 0.0,
    unsent: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: the primary target a few times, then the backup.

    With `unsent`, a folder that all can reach, a batch that neither takes is kept there, and every later batch first offers what is
    kept to the primary, in order; while one of these fails, the primary counts as down. Targets
    get the batch number and must write idempotently: a batch may come again if the job ends between its delivery
    and its removal. Without `unsent` the batch fails, and Spark offers it again on restart.
    """
    kept = Unsent(unsent) if unsent is not None else None

    def tried(batch: DataFrame, batch_id: int) -> Exception | None:
        error = None
        for attempt in range(tries):
            try:
                primary(batch, batch_id)
                return None
            except Exception as failed:  # whatever the target raises
                error = failed
                if attempt + 1 < tries:
                    time.sleep(wait_s)
        return error

    def run(batch: DataFrame, batch_id: int) -> None:
        error = None
        if kept is not None:
            spark = batch.sparkSession
            for number in kept.numbers(spark):
                if number != batch_id:
                    error = error or tried(kept.read(spark, number), number)
                    if error is not None:
                        break
                kept.drop(spark, number)
        error = error or tried(batch, batch_id)
        if error is None:
            return
        if backup is not None:
            try:
                return backup(batch, batch_id)
            except Exception as failed:
                error = failed
        if kept is None:
            raise error
        kept.keep(batch, batch_id)

    return run


def split_sinks(targets: dict[str, Callable[[DataFrame, int], None]], tag: str = "kind") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that gives every target the rows whose tag names it; the batch is computed once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, target in targets.items():
                target(held.filter(F.col(tag) == name).drop(tag), batch_id)
        finally:
            held.unpersist()

    return run


def folder_target(path: str, file_format: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(file_format).save(f"{path}/batch={batch_id}")

    return write
