"""Writing results: tables by year, review files, ring buffers, merge logs with rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fact_table(rows: DataFrame, path: str, day: str = "race_date", cluster: str = "horse_id") -> None:
    """The fact table partitioned by year and sorted by its main key, so scans prune files and pages."""
    by_year = rows.withColumn("year", F.year(day))
    by_year.repartition("year", F.pmod(F.xxhash64(cluster), F.lit(64))).sortWithinPartitions("year", cluster, day).write.mode("overwrite").partitionBy("year").parquet(path)


def review_file(rows: DataFrame, path: str) -> None:
    """CSV files with a header, for people; one a task, so that no task writes all rows."""
    rows.write.mode("overwrite").csv(path, header=True)


def pruned(buffer: DataFrame, received: str, now: str, days: int = 7) -> DataFrame:
    """What a ring buffer keeps: rows received within ``days`` before ``now``."""
    return buffer.where(F.col(received) >= F.expr(f"timestamp'{now}'") - F.expr(f"interval {int(days)} days"))


def merged(rows: DataFrame, log: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without the losers of a merge log ``(loser, keeper)``, and the losers' snapshots."""
    gone = log.where("loser <> keeper").select(F.col("loser").alias(key), "keeper").distinct()
    lost = rows.join(gone, key).select(F.col(key).alias("loser"), "keeper", F.to_json(F.struct(*(F.col(c) for c in rows.columns)), {"ignoreNullFields": "false"}).alias("snapshot"))
    return rows.join(gone.select(key), key, "left_anti"), lost


def rolled_back(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows with the snapshots' rows restored."""
    back = snapshots.select(F.from_json("snapshot", rows.schema).alias("x")).select("x.*")
    return rows.unionByName(back)
