"""Job events as streams: replay without repeats, running progress, a time-limited cache, upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rxloom.operators.relational import upsert
from rxloom.session import cut

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Events of a growing folder of Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def replayed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the lateness."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def progress(events: DataFrame, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Events and total of each job and day, as far as the watermark has passed it."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", span), "user_id")
    return days.agg(F.count("*").alias("done"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "user_id", "done", "total")


BUCKETS = 16


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that merge_into keeps: of each bucket the version that its manifest names."""
    named = _manifest(spark, path)
    folders = [f"{path}/bucket={b}/version={v}" for b, v in sorted(named.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, path: str) -> dict[int, int]:
    """Version of each bucket by the newest manifest; a batch that failed before its own left none."""
    fs, folder = _file_system(spark, path)
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    last = max((int(n) for n in names if n.isdigit()), default=None)
    if last is None:
        return {}
    text = spark.read.text(f"{path}/_manifests/{last}").first()[0]
    return {int(b): int(v) for b, v in (x.split("=") for x in text.split(",") if x)}


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def merge_into(events: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the last event of each key in a table, read by current(); a repeated batch writes the same again.

    Keys are hashed into buckets. A batch rewrites only the buckets that it touches, each into a folder of its own version,
    and then names the versions in a manifest: what is read is never overwritten, and a batch that fails changes nothing.
    The folder before last of a bucket is what a cleaner may delete.
    """

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c not in keys]
        at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        last = cut(batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("m")).select(*keys, "m.*").withColumn("bucket", at))
        touched = [r[0] for r in last.select("bucket").distinct().collect()]  # as many as buckets at most
        named = _manifest(spark, path)
        kept = [f"{path}/bucket={b}/version={named[b]}" for b in touched if b in named]
        if kept:
            stored = spark.read.schema(batch.schema).parquet(*kept).withColumn("bucket", at)
            newer = last.alias("n").join(stored.alias("o"), keys, "left").where("o.ts IS NULL OR n.ts >= o.ts").select(*keys, *[F.col(f"n.{c}") for c in [*cols, "bucket"]])
            last = upsert(stored, newer, keys)
        # one job writes all buckets; dynamic overwriting replaces only this version's folders, if the batch is repeated
        parts = last.withColumn("version", F.lit(version)).repartition("bucket")
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        named |= dict.fromkeys(touched, version)
        line = ",".join(f"{b}={v}" for b, v in sorted(named.items()))
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifests/{version}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls back with the rows of each batch and their running number."""

    def __init__(self, call) -> None:
        self.call, self.rows = call, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.call(event.progress.numInputRows, self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
