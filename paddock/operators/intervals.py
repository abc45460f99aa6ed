"""Stabbing joins by dyadic decomposition, and attributes as known at event time.

A half-open interval of integers is the union of at most two dyadic nodes per level, and a point
lies in exactly one node per level. Both sides written as ``(level, node)`` meet by plain
equality, so an inequality join becomes a hash join without candidates to throw away: every
match of keys is a true match and is found once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span(points: DataFrame, point: str) -> tuple[int, int] | None:
    """Smallest point and number of levels that cover all points; None without points."""
    low, high = points.agg(F.min(point), F.max(point)).first()
    if low is None:
        return None
    return int(low), max(1, int(high - low + 1).bit_length())


def interval_nodes(lower: Column, upper: Column, levels: int) -> Column:
    """Array of ``(level, at)`` nodes whose union is ``[lower, upper)``, within ``[0, 2^levels)``."""

    def at_level(k: int) -> list[Column]:
        left, right = F.shiftright(lower + ((1 << k) - 1), k), F.shiftright(upper, k)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        node = lambda c: F.struct(F.lit(k).alias("level"), c.alias("at"))
        return [F.when((left < right) & odd(left), node(left)), F.when((left < right) & odd(right), node(right - 1))]

    return F.filter(F.array(*(x for k in range(levels + 1) for x in at_level(k))), lambda n: n.isNotNull())


def point_nodes(point: Column, levels: int) -> Column:
    """Array of the ``(level, at)`` nodes that hold a point, one per level."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(point, k).alias("at")) for k in range(levels + 1)))


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lower: str, upper: str, spanned: tuple[int, int] | None = None) -> DataFrame:
    """All pairs of a point and an interval of equal ``keys`` with ``lower <= point < upper``.

    Integer columns; a null ``lower`` or ``upper`` means unbounded on that side, a null key or
    point matches nothing. Intervals are clipped to the span of the points, so open ends cost no
    more than others. Columns of both sides are returned, keys once; other names must differ.
    ``spanned`` is the :func:`span` of the points where the caller knows it.
    """
    low, levels = spanned or span(points, point) or (0, 1)
    top = 1 << levels
    clip = lambda c, missing: F.least(F.greatest(F.coalesce(F.col(c).cast("long") - low, F.lit(missing)), F.lit(0)), F.lit(top)).cast("long")
    held = intervals.withColumn("_from", clip(lower, 0)).withColumn("_to", clip(upper, top)).where("_from < _to")
    held = held.withColumn("_n", F.explode(interval_nodes(F.col("_from"), F.col("_to"), levels)))
    held = held.withColumns({"_level": F.col("_n.level"), "_at": F.col("_n.at")}).drop("_from", "_to", "_n")
    asked = points.where(F.col(point).isNotNull()).withColumn("_n", F.explode(point_nodes(F.col(point).cast("long") - low, levels)))
    asked = asked.withColumns({"_level": F.col("_n.level"), "_at": F.col("_n.at")}).drop("_n")
    return asked.join(held, [*keys, "_level", "_at"]).drop("_level", "_at")


def as_known(
    events: DataFrame, versions: DataFrame, keys: list[str], day: str, valid_from: str, valid_to: str, known_from: str, known_to: str, order: list[str], values: list[str]
) -> DataFrame:
    """For each distinct ``(keys, day)`` of ``events`` the version valid and known on that day.

    A version counts on days that lie both in ``[valid_from, valid_to)`` and in ``[known_from,
    known_to)`` (integer days, null = unbounded). Of several the one with the greatest ``order``
    columns wins, so the result has one row a key and day: ``keys, day, values``. Days without a
    version, null keys and null days give no row.
    """
    asked = events.select(*keys, day).dropna().distinct()
    both = versions.select(*keys, F.greatest(valid_from, known_from).alias("_lo"), F.least(valid_to, known_to).alias("_hi"), F.struct(*order).alias("_by"), F.struct(*values).alias("_is"))
    met = stab(asked, both, keys, day, "_lo", "_hi", span(events, day))
    best = met.groupBy(*keys, day).agg(F.max_by("_is", "_by").alias("_is"))
    return best.select(*keys, day, *(F.col(f"_is.{v}").alias(v) for v in values))
