"""Predicates and flags of results, as Column builders shared by every statistic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: placement texts that mark a qualifying or trial start.
QUALIFIER = r"^(gdk|ejg|ejp|gd|gk|egk|egdk|gkd|gdj|gdb|gdek|gdgk|gdl|ddk|frdk|erj|ejk|ejgk|ejgd|ej|EJ|EJG|EJP|GDK|Gdk|g)[0-9]?$|^[12]?[pP][0-9]?$"


def is_qualifier(text: str = "placement_text") -> Column:
    """Whether a placement text marks a qualifier; null is none."""
    return F.coalesce(F.col(text), F.lit("")).rlike(QUALIFIER)


def started() -> Column:
    """A start that counts: not withdrawn and no qualifier."""
    return ~F.col("withdrawn") & ~is_qualifier()


def not_disqualified() -> Column:
    return ~F.coalesce("disqualified", F.lit(False))


def is_win() -> Column:
    """A win by the placement text."""
    return (F.col("placement_text") == "1") & not_disqualified() & ~is_qualifier()


def is_placed() -> Column:
    """First to third by the placement text."""
    return F.col("placement_text").isin("1", "2", "3") & not_disqualified() & ~is_qualifier()


def won() -> Column:
    """A win by the placement number; unknown where the placement is."""
    return (F.col("placement") == 1) & not_disqualified()


def distance_band(distance: str = "distance") -> Column:
    """s up to 1700 m, m up to 2250 m, else l; null stays null."""
    d = F.col(distance)
    return F.when(d.isNull(), None).when(d <= 1700, "s").when(d <= 2250, "m").otherwise("l")


def expected_win(odds: str = "odds") -> Column:
    """Probability of a win by the odds, at most 0.7; 0 without odds above 1."""
    o = F.col(odds).cast("double")
    return F.when(o > 1, F.least(F.lit(0.7), 1 / o)).otherwise(0.0)


def between(column: str, low: object = None, high: object = None) -> list[Column]:
    """The bounds that are given, as conditions."""
    c = F.col(column)
    return [*([c >= low] if low is not None else []), *([c <= high] if high is not None else [])]


def or_null(column: str, low: object, high: object, exclude_null: bool = False) -> Column:
    """Within bounds, unknown values passing unless excluded."""
    inside = F.col(column).between(low, high)
    return inside if exclude_null else F.col(column).isNull() | inside


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))
