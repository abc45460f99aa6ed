"""Set-based identity resolution: duplicates, candidate matches, merges, redirects, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: which source's value stands, by concept.
PRIORITY = {"horse": ["usta", "st", "letrot", "hvt", "atg", "breedly", "kmtid"], "race": ["atg", "st", "usta", "letrot", "hvt", "kmtid"]}


def priority(source: Column, concept: str) -> Column:
    """Rank of a source, 1 the first; unknown sources come last."""
    order = PRIORITY[concept]
    at = F.coalesce(F.array_position(F.array(*map(F.lit, order)), source), F.lit(0))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def duplicate_groups(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows that share equal, known keys with others: ``(keys, n, keep, row_id)``, one row a member.

    ``n`` is the size of the group and ``keep`` its least id; no group is gathered into one row.
    """
    known = rows.dropna(subset=keys).select(*keys, row_id)
    g = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("keep")).where("n > 1")
    return known.join(g, keys).select(*keys, "n", "keep", row_id)


def keepers(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``keep`` to rows: whether the row comes first in its group by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("keep", F.row_number().over(w) == 1)


def unique_matches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left side has exactly one distinct partner; zero or several give none."""
    one = pairs.groupBy(left).agg(F.countDistinct(right).alias("_n"), F.min(right).alias(right)).where("_n = 1")
    return one.select(left, right)


def cascade(rows: DataFrame, row_id: str, levels: list[tuple[str, DataFrame]], found: str) -> DataFrame:
    """The match of the first level that has one for each row, and that level's name.

    Each level is a table ``(row_id, found)`` with at most one row an id.
    """
    out = rows
    for i, (_, table) in enumerate(levels):
        out = out.join(table.select(row_id, F.col(found).alias(f"_m{i}")), row_id, "left")
    ids = [F.col(f"_m{i}") for i in range(len(levels))]
    how = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for c, (name, _) in zip(ids, levels, strict=True)))
    return out.withColumns({found: F.coalesce(*ids), "how": how}).drop(*(f"_m{i}" for i in range(len(levels))))


def mutual_best(pairs: DataFrame, left: str, right: str, score: str, ratio: float = 0.5) -> DataFrame:
    """Pairs that are each other's best and whose runner-up on either side stays below ``ratio`` of it."""
    best = lambda k, other: Window.partitionBy(k).orderBy(F.desc(score), other)
    ranked = pairs.withColumns({
        "_l": F.row_number().over(best(left, right)), "_r": F.row_number().over(best(right, left)),
        "_l2": F.lead(score).over(best(left, right)), "_r2": F.lead(score).over(best(right, left)),
    })
    clear = lambda c: F.coalesce(F.col(c) < F.col(score) * ratio, F.lit(True))
    return ranked.where((F.col("_l") == 1) & (F.col("_r") == 1) & clear("_l2") & clear("_r2")).drop("_l", "_r", "_l2", "_r2")


def jaccard(a: str, b: str) -> Column:
    """Shared members over all members of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.when(union > 0, union), F.lit(0.0))


def fill_by_priority(rows: DataFrame, keys: list[str], columns: list[str], rank: Column, newest: Column) -> DataFrame:
    """One row a key: each column's first known value by source rank, then newest time."""
    by = F.struct(-rank, newest)
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns))


def remapped(rows: DataFrame, mapping: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """``key`` replaced by its keeper where the mapping has one."""
    m = mapping.select(F.col(old).alias(key), F.col(new).alias("_new"))
    return rows.join(m, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")
