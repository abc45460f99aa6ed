"""Registry of reference queries, the fact table they share, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import predicates as P
from paddock.operators.standing import standing
from paddock.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COLUMNS = [
    "race_id", "horse_id", "program_number", "post", "distance", "placement", "finish_order", "placement_text", "withdrawn", "galopp", "disqualified",
    "time_seconds", "auto", "odds", "prize_kr", "driver_id", "trainer_id", "age", "sex", "earnings_pre", "shoe_code", "race_date", "primary_source",
]


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query under its function's name, with SQL of the same meaning if there is one."""

    def put(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Standing entries with the flags every statistic uses."""
    return standing(table(spark, sf_dir, "entry"), *(columns or COLUMNS))


FLAGS = ["withdrawn", "placement_text", "disqualified"]


def flagged_fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Standing entries with their flags; only ``columns`` and what the flags need are read."""
    return flagged(fact(spark, sf_dir, *dict.fromkeys([*columns, *FLAGS])))


def flagged(e: DataFrame) -> DataFrame:
    return e.withColumns({"is_start": P.started(), "is_win": P.is_win(), "is_placed": P.is_placed(), "is_qual": P.is_qualifier()})


E = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY last_updated_at DESC NULLS LAST) rn FROM entry WHERE entry_id IS NOT NULL) WHERE rn = 1)"
Q = f"regexp_matches(coalesce(placement_text, ''), '{P.QUALIFIER}')"
ND = "NOT coalesce(disqualified, false)"
START = f"(NOT withdrawn AND NOT {Q})"
WIN = f"(placement_text = '1' AND {ND} AND NOT {Q})"
PLACED = f"(placement_text IN ('1', '2', '3') AND {ND} AND NOT {Q})"


def n_if(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def total(c: str) -> Column:
    """Sum of whole numbers as bigint, 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
