"""Totals over trailing periods for every entity and day, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Days of the calendar that one task takes.
DAYS_A_TASK = 50_000


def tasks_for(daily: DataFrame, entity: str, day: str) -> int:
    """Tasks that the calendar of ``daily`` fills, from its entities and their spans."""
    last = daily.agg(F.max(day)).first()[0]
    spans = daily.groupBy(entity).agg(F.min(day).alias("a")).agg(F.sum(F.datediff(F.lit(last).cast("date"), "a") + 1)).first()[0]
    return max(1, -(-int(spans or 0) // DAYS_A_TASK))


def calendar(daily: DataFrame, entity: str, day: str, until: DataFrame | None = None) -> DataFrame:
    """Every day of each entity from its first day to the last day in the data."""
    last = (daily if until is None else until).agg(F.max(day)).first()[0]
    first = daily.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(day).alias("_first")).where("_first is not null")
    return first.select(entity, F.explode(F.sequence("_first", F.lit(last).cast("date"))).alias(day))


def trailing(days: DataFrame, daily: DataFrame, entity: str, day: str, sums: list[str], periods: list[int], bucket: int = 128, tasks: int | None = None) -> DataFrame:
    """Sums of daily totals over the ``p`` days before each day of ``days``, for each period.

    ``daily`` holds one row an entity and day (pre-aggregate first, so a busy entity has no more
    rows than days). A total of day d reaches days d+1 .. d+max(periods); it is sent to the coarse
    ``bucket``s of days it can reach and meets there only the days of its own entity and bucket.
    Returns one row for each row of ``days`` (distinct entity and day): ``{sum}_{p}``, null where
    the period holds no total. Null entities or days match nothing. Where ``days`` were made from
    few rows, ``tasks`` says over how many tasks they are spread, an entity's buckets apart.
    """
    longest = max(periods)
    number = lambda c: F.unix_date(F.col(c))
    asked = days.select(F.col(entity).alias("_e"), F.col(day).alias("_day"), number(day).alias("_d")).withColumn("_b", F.floor(F.col("_d") / bucket))
    reach = F.sequence(F.floor((number(day) + 1) / bucket), F.floor((number(day) + longest) / bucket))
    sent = daily.where(F.col(day).isNotNull()).select(F.col(entity).alias("_e"), number(day).alias("_t"), *sums, F.explode(reach).alias("_b"))
    asked = asked.repartition(tasks, "_e", "_b") if tasks else asked
    near = asked.join(sent, ["_e", "_b"], "left").withColumn("_age", F.col("_d") - F.col("_t"))
    within = {f"{s}_{p}": F.sum(F.when(F.col("_age").between(1, p), F.col(s))).alias(f"{s}_{p}") for s in sums for p in periods}
    return near.groupBy("_e", "_b", "_day").agg(*within.values()).select(F.col("_e").alias(entity), F.col("_day").alias(day), *within)
