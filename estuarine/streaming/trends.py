"""Daily trends, profile upserts and vector appends over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estuarine.operators.store import upsert_profiles


def read_events(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream over a folder with a known schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def daily_trend(events: DataFrame, ts: str, value: str, item: str, delay: str = "1 hour") -> DataFrame:
    """Per day: events, mean, lowest and highest value, approximate distinct items.

    A day is written once the watermark has passed it; later rows for it are dropped.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("avg_value"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.approx_count_distinct(item, 0.01).alias("distinct_items"),
        )
        .select(F.to_date("w.start").alias("day"), "n", "avg_value", "min_value", "max_value", "distinct_items")
    )


def distinct_per_day(events: DataFrame, ts: str, item: str, delay: str = "25 hours") -> DataFrame:
    """First event of every item per day, for exact distinct counts downstream.

    The watermark runs over the starts of days, which are part of the key, so the state of a
    day is freed once the latest day lies more than `delay` after it; later rows are dropped.
    """
    dated = events.withColumn("__day", F.date_trunc("day", ts)).withWatermark("__day", delay)
    return dated.dropDuplicates(["__day", item]).select(F.to_date("__day").alias("day"), item, ts)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; output as parquet files."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Process what is there and stop; every micro-batch leaves its changed rows in a folder.

    Rows of the last, still open window are among them. A replayed batch writes its folder again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def read_updates(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The newest row of every key."""
    rows = spark.read.parquet(root)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("r")).select(key, "r.*")


class ProfileTable:
    """Profiles in hash buckets; a manifest beside the data names the folder of each bucket.

    A batch writes new folders for the buckets it touches and then its part of the manifest, so
    a failed batch leaves everything as it was, a replayed one changes nothing, and a new
    object on the same folder goes on where the last one stopped.
    """

    KEY = "organism_id"

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets

    def _manifest(self) -> DataFrame:
        kinds = "bucket int, path string, batch_id long"
        known = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not known.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(known):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{self.root}/manifest")

    def _paths(self, buckets: DataFrame | None = None) -> list[str]:
        """Folders of the buckets, at most one per bucket."""
        newest = self._manifest().groupBy("bucket").agg(F.max_by("path", "batch_id").alias("path"))
        if buckets is not None:
            newest = newest.join(buckets, "bucket", "left_semi")
        return [r["path"] for r in newest.collect()]

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._paths())

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        last = self._manifest().agg(F.max("batch_id")).first()[0]
        if last is not None and batch_id <= last:
            return
        bucket = F.pmod(F.xxhash64(self.KEY), F.lit(self.buckets)).cast("int")
        touched = batch.select(bucket.alias("bucket")).distinct()
        path = f"{self.root}/data/{batch_id}-{uuid.uuid4().hex}"
        merged = upsert_profiles(self._rows(self._paths(touched)), batch)
        merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
        found = touched.select("bucket", F.concat(F.lit(f"{path}/bucket="), F.col("bucket").cast("string")).alias("path"), F.lit(batch_id).cast("long").alias("batch_id"))
        found.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{batch_id}")


def upsert_stream(detections: DataFrame, table: ProfileTable, checkpoint: str) -> None:
    """Fold detections into profiles batch by batch, then stop."""
    key = "organism_id"

    def apply(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in (key, "created_at")]
        found = batch.groupBy(key).agg(
            F.count(F.lit(1)).alias("detection_count"),
            F.min("created_at").alias("first_detected"),
            F.max("created_at").alias("last_updated"),
            F.max_by(F.struct(*rest), F.col("created_at")).alias("r"),
        )
        table.merge(
            found.select(key, "detection_count", "first_detected", "last_updated", *[F.col(f"r.{c}").alias(c) for c in rest]),
            batch_id,
        )

    query = (
        detections.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_vectors(vectors: DataFrame, store: str, checkpoint: str) -> None:
    """Append what the store at `store` does not have, then stop.

    Each batch is held against everything stored before it, however old, and written to its own
    folder; a replayed batch leaves its own earlier rows out of account and writes them again.
    """
    keys = ["dataset", "run_id", "vec_id"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        folder = spark._jvm.org.apache.hadoop.fs.Path(store)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            old = spark.read.option("basePath", store).parquet(store).filter(F.col("batch") != batch_id)
            fresh = fresh.join(old.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    writer = vectors.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
