"""Event streams: windows, sessions, deduplication, joins and late rows with Structured Streaming.

Every stateful operator runs in append mode under a watermark, so state is dropped once the
watermark has passed it, and a row later than that is left out. A finite backlog is drained and
then closed: one row of the far future moves the watermark past everything, its own windows stay open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.runtime import discard, keep_until_exit, shared_dir

LATE, FAR = "1 hour", "9000-01-01 00:00:00"


def _folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/paddock/{tag}-{uuid.uuid4().hex[:12]}"
    keep_until_exit(spark, path)
    return path


@dataclass
class Backlog:
    """The files of one table as a stream, and the place where the row that closes it is put."""

    events: DataFrame
    closing: str
    day: str

    def close(self) -> None:
        spark = self.events.sparkSession
        nulls = [F.expr(f"timestamp'{FAR}'").cast(f.dataType).alias(f.name) if f.name == self.day else F.lit(None).cast(f.dataType).alias(f.name) for f in self.events.schema.fields]
        spark.range(1).select(*nulls).write.mode("append").parquet(self.closing)


def source(spark: SparkSession, folder: str, name: str, files: int = 1, day: str = "ts") -> Backlog:
    """A stream of the files of one table in a folder, ``files`` of them a micro-batch, ``day`` as timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return _backlog(spark, schema, day, lambda reader: reader.option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}*.parquet").parquet(folder))


def feed(parts: list[DataFrame], day: str = "ts") -> Backlog:
    """A stream that gets the given tables one after the other, a micro-batch each."""
    spark, path = parts[0].sparkSession, _folder(parts[0].sparkSession, "feed")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return _backlog(spark, parts[0].schema, day, lambda reader: reader.option("maxFilesPerTrigger", 1).parquet(path))


def _backlog(spark: SparkSession, schema, day: str, read: Callable) -> Backlog:
    closing = _folder(spark, "closing")
    spark.createDataFrame([], schema).write.parquet(closing)
    plain = lambda df: df.withColumn(day, F.col(day).cast("timestamp"))
    both = plain(read(spark.readStream.schema(schema))).unionByName(plain(spark.readStream.schema(schema).parquet(closing)))
    return Backlog(both, closing, day)


def drained(stream: DataFrame, *backlogs: Backlog) -> DataFrame:
    """All that an append stream gives for the files present now, closed, written and read back."""
    spark = stream.sparkSession
    path, state = _folder(spark, "stream"), _folder(spark, "state")

    def run() -> None:
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    for b in backlogs:
        b.close()
    if backlogs:
        run()
    discard(spark, state)
    return spark.read.schema(stream.schema).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Rows and totals by type in windows that follow each other."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """Rows by type in windows that overlap."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events with no longer gap than ``gap``."""
    w = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event of each key; repeats are dropped for ``LATE`` after it, then the key is forgotten.

    A key that comes again later is passed on again, so state stays as small as the keys of that span.
    """
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def followed(first: DataFrame, second: DataFrame, key: str, within: str) -> DataFrame:
    """Pairs of an event and a later one of the same ``key`` within ``within``: both ids and times."""
    a = first.withWatermark("ts", LATE).select(F.col(key), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = second.withWatermark("ts", LATE).select(F.col(key).alias("_k"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    near = (F.col(key) == F.col("_k")) & (F.col("second_ts") > F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"interval {within}"))
    return a.join(b, near).drop("_k")


def upserts(stream: DataFrame, path: str, keys: list[str], order: str, state: str) -> Callable[[], None]:
    """Keeps under ``path`` each key's row with the greatest ``order``, batch by batch.

    A batch is reduced to its newest row a key and written beside the earlier ones; :func:`current`
    reads the newest of all. A replayed batch overwrites itself, so it changes nothing. Returns a
    function that drains what is there now.
    """

    def put(batch: DataFrame, number: int) -> None:
        _newest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lambda: stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("x")).select(*keys, "x.*").select(*rows.columns)


def current(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The table that :func:`upserts` keeps."""
    return _newest(spark.read.parquet(path).drop("batch"), keys, order)


def compacted(spark: SparkSession, path: str, keys: list[str], order: str) -> str:
    """The table of :func:`upserts` written anew as one batch beside ``path``; returns where."""
    to = f"{path.rstrip('/')}-compact-{uuid.uuid4().hex[:8]}"
    current(spark, path, keys, order).write.parquet(f"{to}/batch=0")
    return to
