"""The position stream: parse, drop skewed clocks, dedupe by content, write event-time hours; snapshot readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "mmsi long, ts timestamp, received timestamp, lon double, lat double, sog_kn double, msg_type string, name string"
SKEW = "1 hour"
CONTENT = ["mmsi", "ts", "lon", "lat", "msg_type"]


def messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON-line messages from a folder; lines that do not parse become rows of nulls."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return raw.select(F.from_json("value", MESSAGE).alias("m")).select("m.*")


def positions(stream: DataFrame) -> DataFrame:
    """Valid positions whose clock is within an hour of the receiver's, once each by content."""
    skew = F.abs(F.unix_micros("ts") - F.unix_micros("received")) <= 3_600_000_000
    good = stream.where(F.col("mmsi").isNotNull() & F.col("ts").isNotNull() & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & skew)
    return good.withWatermark("ts", SKEW).dropDuplicatesWithinWatermark(CONTENT)


def hourly_counts(stream: DataFrame) -> DataFrame:
    """Reports and vessels per event-time hour, closed by the watermark."""
    return stream.groupBy(F.window("ts", "1 hour").alias("w"), "msg_type").agg(F.count("*").alias("n"), F.approx_count_distinct("mmsi").alias("vessels")).select(F.col("w.start").alias("hour"), "msg_type", "n", "vessels")


def record(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append positions to day and hour partitions; a batch that runs again replaces nothing twice, as the sink commits by batch."""
    out = stream.withColumn("day", F.date_format("ts", "yyyyMMdd")).withColumn("hh", F.date_format("ts", "HH"))
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day", "hh").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def load_positions(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Recorded positions in [start, end], reading only the partitions of the days and hours that can hold them."""
    df = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    day = F.col("day").cast("string")
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    hour = F.concat(day, F.lpad(F.col("hh").cast("string"), 2, "0"))
    days = day.between(F.date_format(a, "yyyyMMdd"), F.date_format(b, "yyyyMMdd"))
    return df.where(days & hour.between(F.date_format(a, "yyyyMMddHH"), F.date_format(b, "yyyyMMddHH")) & F.col("ts").between(a, b))


def scene_window(scenes: DataFrame, reports: DataFrame, seconds: int = 1800) -> DataFrame:
    """Stored reports within ``seconds`` of each scene (scene_id, at), joined through hour buckets."""
    slot = lambda c: F.floor(F.unix_seconds(c) / seconds)
    a = scenes.withColumn("_s", F.explode(F.sequence(slot(F.col("at")) - 1, slot(F.col("at")) + 1)))
    return a.join(reports.withColumn("_s", slot(F.col("ts"))), "_s").drop("_s").where(F.abs(F.unix_micros("ts") - F.unix_micros("at")) <= seconds * 1_000_000)


class Snapshot:
    """Reads of one version: a query keeps the frame it began with while ``refresh`` puts a newer one in place."""

    def __init__(self, catalog, key: str):
        self.catalog, self.key = catalog, key
        self.version, self.frame = None, None
        self.refresh()

    def refresh(self) -> bool:
        """Load anew if the table changed; True if it did."""
        now = self.catalog.signature(self.key)
        if now == self.version:
            return False
        self.frame, self.version = self.catalog.read(self.key), now
        return True
