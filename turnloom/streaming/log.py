"""Extension (the reference has no streams): an append log kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnloom.operators.taxonomy import latest


def log_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """JSON-lines log folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of a bucket's folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getName()[2:]) for f in found or [])


def keep_latest(stream: DataFrame, target: str, keys: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Fold each micro-batch into ``target`` (parquet, by bucket of the keys and version): the greatest ``seq`` per key stays.

    A batch reads the newest earlier version of the buckets it touches and writes version ``v=<epoch>`` of these alone, so
    a replayed epoch gives the same folders. A bucket keeps its last two versions, for readers on the older one.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        before = {b: [v for v in _versions(spark, f"{target}/bucket={b}") if v < epoch] for b in touched}
        old = [f"{target}/bucket={b}/v={vs[-1]}" for b, vs in before.items() if vs]
        rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch) if old else batch
        kept = latest(rows, keys).withColumn("bucket", bucket).withColumn("v", F.lit(epoch)).repartition("bucket")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(target)
        for b, vs in before.items():
            for v in vs[:-1]:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={b}/v={v}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str, schema: str, buckets: int = 64) -> DataFrame:
    """The newest version of every bucket of a kept log."""
    newest = {b: _versions(spark, f"{target}/bucket={b}") for b in range(buckets)}
    paths = [f"{target}/bucket={b}/v={vs[-1]}" for b, vs in newest.items() if vs]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def status_windows(stream: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per status and event-time window, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "status").agg(F.count("*").alias("n"))
