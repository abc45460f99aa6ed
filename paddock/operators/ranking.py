"""Measures of a result within its race."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.predicates import is_qualifier
from paddock.runtime import cut, join_sized

LEAST_FIELD = 4


def market_outperformance(entries: DataFrame, least: int = LEAST_FIELD) -> DataFrame:
    """How much better than its odds each starter finished, from -1 to 1.

    Rank by odds less rank by finish over the field less one; ties by program number, then id.
    Only starters with odds above 1 and a finish in fields of at least ``least`` count.
    """
    field = entries.where((F.col("odds") > 1) & F.col("finish_order").isNotNull() & ~F.coalesce("withdrawn", F.lit(False)) & ~is_qualifier() & F.col("race_id").isNotNull())
    race = Window.partitionBy("race_id")
    order = lambda c: race.orderBy(c, F.col("program_number").asc_nulls_last(), "entry_id")
    ranked = field.withColumns({"n": F.count(F.lit(1)).over(race), "odds_rank": F.row_number().over(order("odds")), "fin_rank": F.row_number().over(order("finish_order")), "share": (1 / F.col("odds").cast("double")) / F.sum(1 / F.col("odds").cast("double")).over(race)})
    return ranked.where(F.col("n") >= least).withColumn("market_outperf", (F.col("odds_rank") - F.col("fin_rank")).cast("double") / (F.col("n") - 1))


def finish_percentile(entries: DataFrame, least: int = LEAST_FIELD) -> DataFrame:
    """Share of the field each placed starter beat, by placement; 1 for the winner."""
    field = entries.where((F.col("placement") > 0) & ~F.coalesce("withdrawn", F.lit(False)) & ~is_qualifier() & F.col("race_id").isNotNull())
    race = Window.partitionBy("race_id")
    ranked = field.withColumns({"n": F.count(F.lit(1)).over(race), "rank": F.row_number().over(race.orderBy("placement", F.col("program_number").asc_nulls_last(), "entry_id"))})
    return ranked.where(F.col("n") >= least).withColumn("perf", (F.col("n") - F.col("rank")).cast("double") / (F.col("n") - 1))


MARKET = ["race_id", "odds", "finish_order", "withdrawn", "placement_text", "program_number"]
FINISH = ["race_id", "placement", "withdrawn", "placement_text", "program_number"]


def both_measures(entries: DataFrame, least: int = LEAST_FIELD) -> DataFrame:
    """Adds ``market_outperf`` and ``perf`` to all entries, null where a measure does not count them.

    The same numbers as :func:`market_outperformance` and :func:`finish_percentile`, in one pass:
    both rank within the race, so one shuffle serves both.
    """
    ran = ~F.coalesce("withdrawn", F.lit(False)) & ~is_qualifier() & F.col("race_id").isNotNull()
    e = entries.withColumns({"_m": F.coalesce((F.col("odds") > 1) & F.col("finish_order").isNotNull() & ran, F.lit(False)), "_f": F.coalesce((F.col("placement") > 0) & ran, F.lit(False))})
    tie = [F.col("program_number").asc_nulls_last(), F.col("entry_id")]
    m, f = Window.partitionBy("race_id", "_m"), Window.partitionBy("race_id", "_f")
    e = e.withColumns({
        "_mn": F.count(F.lit(1)).over(m), "_o": F.row_number().over(m.orderBy("odds", *tie)), "_r": F.row_number().over(m.orderBy("finish_order", *tie)),
        "_fn": F.count(F.lit(1)).over(f), "_p": F.row_number().over(f.orderBy("placement", *tie)),
    })
    market = F.when(F.col("_m") & (F.col("_mn") >= least), (F.col("_o") - F.col("_r")).cast("double") / (F.col("_mn") - 1))
    perf = F.when(F.col("_f") & (F.col("_fn") >= least), (F.col("_fn") - F.col("_p")).cast("double") / (F.col("_fn") - 1))
    return e.withColumns({"market_outperf": market, "perf": perf}).drop("_m", "_f", "_mn", "_o", "_r", "_fn", "_p")


#: Ranges of values in which a median is looked for.
RANGES = 256


def exact_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median, n)``: the exact median of the known values of each key.

    Values are counted first; the counts of approximate quantile ranges then say which range holds
    the middle, and only that one is ordered. No task holds all values of a key.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    counts = cut(known.groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "values").df
    bounds = cut(known.groupBy(key).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_q"), F.count(F.lit(1)).alias("_all")), "bounds")
    placed = cut(join_sized(counts, bounds, [key], F.col("_v"), limit=10_000).withColumn("_part", F.size(F.filter("_q", lambda q: q < F.col("_v")))).drop("_q"), "placed").df
    by_part = placed.groupBy(key, "_part").agg(F.sum("_n").alias("_held"), F.max("_all").alias("_all"))
    below = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = by_part.withColumn("_below", F.coalesce(F.sum("_held").over(below), F.lit(0))).where((F.col("_below") < high) & (F.col("_below") + F.col("_held") >= low)).select(key, "_part", "_below")
    up_to = F.col("_below") + F.sum("_n").over(Window.partitionBy(key, "_part").orderBy("_v"))
    near = placed.join(middle, [key, "_part"]).withColumn("_to", up_to)
    at = lambda rank: F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col("_n") < rank), F.col("_v")))
    return near.groupBy(key).agg(((at(low) + at(high)) / 2).alias("median"), F.max("_all").alias("n"))
