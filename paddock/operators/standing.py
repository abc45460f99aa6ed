"""Standing rows: the one delivery of each entry that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standing(entry: DataFrame, *columns: str) -> DataFrame:
    """One row an ``entry_id``: the delivery with the latest ``last_updated_at``.

    A missing time counts as oldest, rows that tie are ordered by their values, so the choice is
    the same in every run. Rows without an id are left out. Only ``columns`` are read.
    """
    one = F.max(F.struct("last_updated_at", *columns)).alias("_r")
    return entry.where("entry_id is not null").groupBy("entry_id").agg(one).select("entry_id", *(F.col(f"_r.{c}").alias(c) for c in columns))
