"""Incremental merge of new acquisitions, as a batch and as a stream of files."""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.aggregates import next_id
from pulsegrid.operators.joins import append_new, remap_ids, unseen

KEYS = ["file", "peak_pos"]


class Merged(NamedTuple):
    events: DataFrame
    added: DataFrame
    series: DataFrame | None
    counts: DataFrame


def merge_new_events(stored: DataFrame, new: DataFrame, series: DataFrame | None = None, keys: list[str] = KEYS) -> Merged:
    """Adds what is not stored yet, by ``keys``; of equals within the batch the first by id. New id = id + largest stored id + 1,
    so skipped rows leave gaps; long rows follow their events. A second merge of the same batch adds nothing."""
    fresh = unseen(new, stored, keys, ["event_id"])
    shift = next_id(stored)
    moved = fresh.crossJoin(F.broadcast(shift)).withColumn("new_id", F.col("event_id") + F.col("next_id"))
    added = moved.drop("event_id", "next_id").withColumnRenamed("new_id", "event_id").select(*new.columns)
    long = None
    if series is not None:
        long = remap_ids(series, moved.select(F.col("event_id").cast("string").alias("old"), F.col("new_id").cast("string").alias("new")))
    counts = new.agg(F.count("*").alias("n")).crossJoin(fresh.agg(F.count("*").alias("n_added"))).select("n_added", (F.col("n") - F.col("n_added")).alias("n_skipped"))
    return Merged(append_new(stored, added), added, long, counts)


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, watermark: tuple[str, str] | None = None, keys: list[str] = KEYS) -> StreamingQuery:
    """Reads the files that have arrived in ``source`` once each and merges them into the Parquet table ``target``.

    The checkpoint keeps which files are done, so an interrupted run goes on where it stopped. A batch writes its own
    folder (``batch=<id>``), which a repeated batch overwrites: nothing is there until all of it is. Keys seen before are
    dropped by the stream's state (bounded by the watermark, where one is given) and by the anti-join with the table.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    if watermark:
        rows = rows.withWatermark(*watermark)
        rows = rows.dropDuplicatesWithinWatermark(keys)
    else:
        rows = rows.dropDuplicates(keys)

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(path)
        if there:
            stored = session.read.parquet(target).where(F.col("batch") != batch_id).drop("batch")
        else:
            stored = session.createDataFrame([], batch.schema)
        merge_new_events(stored, batch, keys=keys).added.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def preset_hash(preset: str | dict) -> str:
    """Names a feature preset by its content."""
    return hashlib.sha256(json.dumps(preset, sort_keys=True).encode()).hexdigest()[:16]


class FeatureStore:
    """Features per (sample, fingerprint, preset), a partition each; only what is missing is computed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self, folder: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _folder(self, sample: str, fingerprint: str, preset: str | dict) -> str:
        return f"{self.path}/preset={preset_hash(preset)}/sample={sample}/fingerprint={fingerprint}"

    def get(self, sample: str, fingerprint: str, preset: str | dict, compute) -> DataFrame:
        """The stored features, or those of compute(), which are stored first."""
        folder = self._folder(sample, fingerprint, preset)
        if not self._there(folder + "/_SUCCESS"):
            compute().write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def missing(self, keys: DataFrame) -> DataFrame:
        """keys(sample, fingerprint, preset) that are not stored."""
        if not self._there(self.path):
            return keys
        have = self.spark.read.parquet(self.path).select("sample", "fingerprint", "preset").distinct()
        return keys.join(have.select(*[F.col(c).cast("string").alias(c) for c in have.columns]), ["sample", "fingerprint", "preset"], "left_anti")

    def clear(self, sample: str, fingerprint: str, preset: str | dict) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(sample, fingerprint, preset))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
