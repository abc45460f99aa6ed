"""Upserts, deltas and watermarks over plain tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the delta's rows in place of those with the same key. Null keys never match."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def upsert_preserving(base: DataFrame, delta: DataFrame, keys: list[str], preserve: list[str]) -> DataFrame:
    """Upsert in which nulls of the ``preserve`` columns keep the old value."""
    others = [c for c in base.columns if c not in keys]
    a = base.select(*keys, F.struct(*others).alias("_old"))
    b = delta.select(*keys, F.struct(*others).alias("_new"))
    met = a.join(b, keys, "full")
    pick = lambda c: F.coalesce(f"_new.{c}", f"_old.{c}") if c in preserve else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return met.select(*keys, *(pick(c).alias(c) for c in others))


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The delta's rows whose key isn't in ``base``."""
    return delta.join(base.select(*keys), keys, "left_anti")


def changed(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The delta's rows that differ from the base in any column, null against value included."""
    old = base.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return delta.join(old, keys).where(differs).select(delta.columns)


def since(rows: DataFrame, column: str, watermark, overlap: timedelta = timedelta(hours=1)) -> DataFrame:
    """Rows at or after the stored watermark less an overlap; all rows without one."""
    return rows if watermark is None else rows.where(F.col(column) >= F.lit(watermark - overlap))


def advanced(store: DataFrame, tables: dict[str, DataFrame], column: str, overlap: timedelta = timedelta(hours=1)) -> DataFrame:
    """``(name, delta, watermark)``: rows of each table since its stored watermark, and the next one.

    ``store`` holds one row ``(name, watermark)`` a table; a null watermark asks for everything
    again. A watermark never goes back; a table without rows keeps its own.
    """
    known = {r["name"]: r["watermark"] for r in store.collect()}  # one row a table
    parts = []
    for name, mark in known.items():
        rows = tables[name]
        fresh = F.count(F.lit(1)) if mark is None else F.count(F.when(F.col(column) >= F.lit(mark - overlap).cast("timestamp_ntz"), 1))
        parts.append(rows.agg(F.lit(name).alias("name"), fresh.alias("delta"), F.greatest(F.max(column), F.lit(mark).cast("timestamp_ntz")).alias("watermark")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def of_changed(children: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows that hang on a parent that changed."""
    return children.join(changed.select(key).distinct(), key, "left_semi")
