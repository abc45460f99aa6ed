"""Column-wise merging of two rows of one start: which value stands, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that fill from the loser, columns that are true if either is, equipment codes of a sulky.
FILLED = [
    "program_number", "post", "distance", "tillagg", "finish_order", "placement_text", "time_text", "auto", "odds_plats_text", "prize_currency", "prize_original", "prize_fx_rate", "prize_fx_date",
    "driver_id", "trainer_id", "earnings_pre", "shoe_front_changed", "shoe_back_changed", "sulky_changed", "kmtid_first_200ms", "kmtid_last_200ms", "kmtid_best_100ms", "kmtid_best_100_start_m",
    "kmtid_actual_distance_m", "kmtid_actual_km_time_ms", "kmtid_slipstream_distance_m", "kmtid_intervals",
]
EITHER = ["withdrawn", "galopp", "disqualified", "driver_changed", "trainer_changed"]
EQUIPMENT = ["VA", "AM", "HY", "BG"]
#: Seconds a km within which two times are the same.
CLOSE = 1.0


def _two(c: str) -> tuple[Column, Column]:
    return F.col(f"k.{c}"), F.col(f"l.{c}")


def _one_sided(k: Column, l: Column) -> Column:  # noqa: E741
    """What is decided where not both sides differ; null where they do."""
    return F.when(l.isNotNull() & k.isNull(), "loser").when(k.isNotNull() & l.isNull(), "keeper").when(k.isNull(), "keeper").when(k == l, "equal")


def merged(pairs: DataFrame, keeper: str = "k", loser: str = "l") -> DataFrame:
    """One row a pair of structs ``keeper`` and ``loser``: merged columns, ``decisions`` and ``disagreements``.

    Columns the structs lack are left out. Rules: most columns fill from the loser; flags are true if
    either is; a placement that differs goes to the side with a time; times within a second are the
    same and the keeper's stands; odds of the betting operator (atg) stand; the larger prize that is
    not 0 stands; age and sex of a French race come from letrot, of others from atg; equipment codes
    stand over colours. ``pairs`` may hold ``is_french``; without it no race is.
    """
    fields = pairs.schema[keeper].dataType.fieldNames()
    p = pairs.select("*").withColumnsRenamed({keeper: "k", loser: "l"})
    french = F.coalesce(F.col("is_french"), F.lit(False)) if "is_french" in pairs.columns else F.lit(False)
    source = lambda side: F.lower(F.coalesce(F.col(f"{side}.primary_source"), F.lit("")))
    ks, ls = (source("k"), source("l")) if "primary_source" in fields else (F.lit(""), F.lit(""))
    values, why, differ = {}, {}, []
    for c in FILLED:
        if c in fields:
            k, l = _two(c)  # noqa: E741
            values[c] = F.coalesce(k, l)
            why[c] = F.when(k.isNull() & l.isNotNull(), "loser_fill").when(k.isNotNull() & l.isNull(), "keeper_only").when(k.isNull(), "both_null").when(k == l, "equal").otherwise("keeper_conflict")
    for c in EITHER:
        if c in fields:
            k, l = (F.coalesce(x, F.lit(False)) for x in _two(c))  # noqa: E741
            values[c], why[c] = k | l, F.when(k | l, "or_true").otherwise("or_false")
    if "placement" in fields:
        (k, l), (kt, lt) = _two("placement"), _two("time_seconds")  # noqa: E741
        why["placement"] = F.coalesce(_one_sided(k, l), F.when(lt.isNotNull() & kt.isNull(), "loser_has_time").when(kt.isNotNull() & lt.isNull(), "keeper_has_time").otherwise("keeper_disagree"))
        values["placement"] = F.when(why["placement"].startswith("loser"), l).otherwise(k)
        differ.append(F.when(why["placement"] == "keeper_disagree", "placement"))
    if "time_seconds" in fields:
        k, l = _two("time_seconds")  # noqa: E741
        why["time_seconds"] = F.when(k.isNull() & l.isNull(), "both_null").otherwise(F.coalesce(_one_sided(k, l), F.when(F.abs(k - l) <= CLOSE, "keeper_close").otherwise("keeper_disagree")))
        values["time_seconds"] = F.coalesce(k, l)
        differ.append(F.when(why["time_seconds"] == "keeper_disagree", "time_seconds"))
    if "odds" in fields:
        k, l = _two("odds")  # noqa: E741
        why["odds"] = F.coalesce(_one_sided(k, l), F.when((ls == "atg") & (ks != "atg"), "loser_atg").otherwise("keeper"))
        values["odds"] = F.when(why["odds"].startswith("loser"), l).otherwise(k)
    if "prize_kr" in fields:
        k, l = (F.coalesce(x, F.lit(0)) for x in _two("prize_kr"))  # noqa: E741
        why["prize_kr"] = F.when((k == 0) & (l == 0), "both_zero").when(k == 0, "loser_nonzero").when(l == 0, "keeper_nonzero").when(k == l, "equal").when(l > k, "loser_larger").otherwise("keeper_larger")
        values["prize_kr"] = F.when(why["prize_kr"].startswith("loser"), l).otherwise(k)
    for c in ("age", "sex"):
        if c in fields:
            k, l = _two(c)  # noqa: E741
            better = F.when(french & (ls == "letrot") & (ks != "letrot"), "loser_french_pref").when(~french & (ls == "atg") & (ks != "atg"), "loser_atg_pref").otherwise("keeper")
            why[c] = F.coalesce(_one_sided(k, l), better)
            values[c] = F.when(why[c].startswith("loser"), l).otherwise(k)
    if "shoe_code" in fields:
        k, l = _two("shoe_code")  # noqa: E741
        values["shoe_code"] = F.coalesce(k, l)
        why["shoe_code"] = F.when(k.isNull() & l.isNotNull(), "loser_fill").when(k != l, "keeper_conflict_stash_loser").when(k.eqNullSafe(l), "equal").otherwise("both_null")
        values["shoe_stashed"] = F.when(k != l, l)
    if "sulky" in fields:
        k, l = (F.when(x != "", x) for x in _two("sulky"))  # noqa: E741
        real = lambda c: F.upper(c).isin(EQUIPMENT)
        why["sulky"] = F.coalesce(_one_sided(k, l), F.when(real(l) & ~real(k), "loser_real").otherwise("keeper"))
        values["sulky"] = F.when(why["sulky"].startswith("loser"), l).otherwise(k)
    told = F.create_map(*(x for c, w in why.items() for x in (F.lit(c), w)))
    gaps = F.filter(F.array(*differ), lambda x: x.isNotNull()) if differ else F.array().cast("array<string>")
    keys = [c for c in pairs.columns if c not in (keeper, loser)]
    return p.select(*keys, *(v.alias(c) for c, v in values.items()), told.alias("decisions"), gaps.alias("disagreements"))


def overwritten(current: DataFrame, incoming: DataFrame, key: str, columns: list[str], rank: Column, incoming_rank: Column) -> DataFrame:
    """``current`` after rows of other sources came in: ``key``, ``columns``, ``primary_source``.

    A row of the same source or of one ranked before the current's overwrites; others only fill what
    is null. A null that comes in never overwrites. ``rank`` and ``incoming_rank`` are of the columns
    ``k.primary_source`` and ``l.primary_source``.
    """
    pack = lambda df, n: df.select(key, F.struct("primary_source", *columns).alias(n))
    met = pack(current, "k").join(pack(incoming, "l"), key, "left")
    wins = F.col("k.primary_source").isNull() | (F.col("l.primary_source") == F.col("k.primary_source")) | (incoming_rank < rank)
    pick = lambda c: F.when(wins, F.coalesce(f"l.{c}", f"k.{c}")).otherwise(F.coalesce(f"k.{c}", f"l.{c}")).alias(c)
    return met.select(key, *(pick(c) for c in columns), F.when(F.col("l").isNotNull() & wins, F.col("l.primary_source")).otherwise(F.col("k.primary_source")).alias("primary_source"))
