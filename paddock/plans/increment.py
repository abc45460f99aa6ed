"""Keeping the feature table up to date: new rows only, and labels that came late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.incremental import changed, insert_absent, upsert

LABELS = ["y_win", "y_top3"]


def appended(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """The stored features and those of entries they lack; rows once stored keep their features."""
    return stored.unionByName(insert_absent(stored, computed, ["entry_id"]).select(stored.columns))


def late_labels(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Stored rows whose labels differ now, with the new labels and their features as stored."""
    new = stored.drop(*LABELS).join(computed.select("entry_id", *LABELS), "entry_id").select(stored.columns)
    return changed(stored, new, ["entry_id"], LABELS)


def refreshed(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Labels repaired and new entries appended; doing it again changes nothing."""
    return appended(upsert(stored, late_labels(stored, computed), ["entry_id"]), computed)


def recent(rows: DataFrame, day: str, until: str, days: int) -> DataFrame:
    """Rows of the trailing days that a bounded recomputation covers."""
    return rows.where(F.col(day).between(F.date_sub(F.lit(until).cast("date"), days), F.lit(until).cast("date")))
