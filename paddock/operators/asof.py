"""Running aggregates known before an event: per row, per day, per range of days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def before(keys: list[str], order: list[str], rows: int | None = None) -> WindowSpec:
    """Rows before the current one in order, all or the last ``rows``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return w.rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def days_before(keys: list[str], day: str, days: int) -> WindowSpec:
    """Rows dated ``days`` to 1 days before the current one; ``day`` is an integer day."""
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1)


def daily(rows: DataFrame, keys: list[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """Totals a key and day. Rows with a null key are left out.

    Rolling up first bounds the rows of a busy key by its days and turns the later as-of lookup
    into an equality join.
    """
    return rows.dropna(subset=[*keys, day]).groupBy(*keys, day).agg(*(c.alias(k) for k, c in sums.items()))


def cumulative(rows: DataFrame, keys: list[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """``(keys, day, sums)``: totals over all earlier days, null where there are none."""
    w = before(keys, [day])
    return daily(rows, keys, day, sums).select(*keys, day, *(F.sum(k).over(w).alias(k) for k in sums))


def trailing_days(rows: DataFrame, keys: list[str], day: str, sums: dict[str, Column], days: int) -> DataFrame:
    """``(keys, day, sums)``: totals over the days before each active day."""
    d = daily(rows, keys, day, sums).withColumn("_d", F.unix_date(day))
    w = days_before(keys, "_d", days)
    return d.select(*keys, day, *(F.sum(k).over(w).alias(k) for k in sums))


def rate(top: str, bottom: str) -> Column:
    """A ratio of two counts as double, null over nothing."""
    return F.col(top).cast("double") / F.when(F.col(bottom) != 0, F.col(bottom))


def asof_rate(rows: DataFrame, keys: list[str], day: str, hit: Column, counted: Column) -> DataFrame:
    """Share of hits among the counted rows of each key on earlier days: ``(keys, day, n, hits, rate)``."""
    c = cumulative(rows, keys, day, {"n": F.count(F.when(counted, 1)), "hits": F.count(F.when(counted & hit, 1))})
    return c.withColumn("rate", rate("hits", "n"))


def streaks(rows: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Adds lengths of the run of flagged (``on_streak``) and of other rows (``off_streak``) before each row."""
    w = before(keys, order)
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))))
    last_on = F.coalesce(F.max(F.when(flag, F.col("_rn"))).over(w), F.lit(0))
    last_off = F.coalesce(F.max(F.when(~flag, F.col("_rn"))).over(w), F.lit(0))
    return numbered.withColumns({"on_streak": F.greatest(F.col("_rn") - 1 - last_off, F.lit(0)), "off_streak": F.greatest(F.col("_rn") - 1 - last_on, F.lit(0))}).drop("_rn")


def forward_filled(series: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """A daily series from each key's first to its last day, gaps filled with the last value."""
    ends = series.dropna(subset=[key, day]).groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = ends.select(key, F.explode(F.sequence("a", "b")).alias(day))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return days.join(series.select(key, day, value), [key, day], "left").select(key, day, F.last(value, True).over(w).alias(value))


def decayed_mean(value: Column, day: Column, half_life: int, w: WindowSpec) -> Column:
    """Mean with weights that halve every ``half_life`` days; the reference day cancels out."""
    weight = F.pow(F.lit(2.0), day / F.lit(float(half_life)))
    held = F.sum(F.when(value.isNotNull(), weight)).over(w)
    return F.sum(weight * value).over(w) / F.when(held != 0, held)


#: Rows of a key that one task orders for windows over its last rows.
ROWS_A_BUCKET = 8192


def numbered(rows: DataFrame, keys: list[str], day: str, tie: str) -> DataFrame:
    """Adds ``_rn``, the 0-based place of a row among its key's rows by day, then ``tie``.

    Days are counted first and only the rows of one day are ordered together, so no task holds all
    rows of a busy key. Null keys and days are left out.
    """
    known = rows.dropna(subset=[*keys, day])
    first = daily(known, keys, day, {"_n": F.count(F.lit(1))}).withColumn("_before", F.coalesce(F.sum("_n").over(before(keys, [day])), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, day).orderBy(tie)) - 1
    return known.withColumn("_within", within).join(first, [*keys, day]).withColumn("_rn", F.col("_before") + F.col("_within")).drop("_before", "_within")


def over_last(rows: DataFrame, keys: list[str], reach: int, measures: dict[str, Callable[[Callable[[int], WindowSpec]], Column]]) -> DataFrame:
    """Adds measures over up to ``reach`` rows before each, of rows from :func:`numbered`.

    The rows of a key are cut into buckets and the last ``reach`` of each are carried into the next,
    so a busy key is spread over many tasks. A measure gets ``last``, which makes the window of the
    n rows before.
    """
    size = max(ROWS_A_BUCKET, reach)
    at = F.floor(F.col("_rn") / size)
    carried = F.when(F.pmod(F.col("_rn"), F.lit(size)) >= size - reach, F.array(at, at + 1)).otherwise(F.array(at))
    spread = rows.withColumn("_b", F.explode(carried)).withColumn("_own", F.col("_b") == at)
    last = lambda n: Window.partitionBy(*keys, "_b").orderBy("_rn").rowsBetween(-n, -1)
    return spread.withColumns({k: make(last) for k, make in measures.items()}).where("_own").drop("_b", "_own")


def before_row(rows: DataFrame, keys: list[str], day: str, tie: str, sums: dict[str, Column]) -> DataFrame:
    """Adds totals over all rows of the key before each row, by day, then ``tie``.

    Totals of earlier days come from daily totals, those of the same day from its own rows.
    """
    known = rows.dropna(subset=[*keys, day]).withColumns({f"_x_{k}": c for k, c in sums.items()})
    past = cumulative(known, keys, day, {f"_p_{k}": F.sum(f"_x_{k}") for k in sums})
    same = Window.partitionBy(*keys, day).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns({f"_s_{k}": F.sum(f"_x_{k}").over(same) for k in sums}).join(past, [*keys, day], "left")
    some = lambda k: F.coalesce(F.col(f"_p_{k}") + F.col(f"_s_{k}"), F.col(f"_p_{k}"), F.col(f"_s_{k}"))
    return known.withColumns({k: some(k) for k in sums}).drop(*(f"{p}{k}" for k in sums for p in ("_x_", "_p_", "_s_")))
