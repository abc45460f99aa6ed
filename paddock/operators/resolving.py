"""Set-based resolution of incoming records to known entities, and matching of races and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.parse import normalize_name, synth_id
from paddock.operators.identity import cascade, mutual_best, unique_matches


def first_redirect(asked: DataFrame, redirects: DataFrame, row_id: str, source: str, key: str) -> DataFrame:
    """``(row_id, to_id)``: where a merged-away key leads now, its own source before the bucket ``synth``."""
    met = asked.select(row_id, source, key).join(redirects.select(F.col("source").alias("_s"), F.col("source_key").alias("_k"), "to_id"), F.col(key) == F.col("_k"))
    near = met.where((F.col("_s") == F.col(source)) | (F.col("_s") == "synth"))
    return near.groupBy(row_id).agg(F.min_by("to_id", F.struct(F.col("_s") == "synth", "to_id")).alias("to_id"))


def resolved(incoming: DataFrame, known: DataFrame, redirects: DataFrame, placed: DataFrame) -> DataFrame:
    """``(row_id, horse_id, how)`` for every incoming record.

    In this order: a redirect of its id, its strong ids (source id, then registration number), the
    horse entered under its race and program number, the one horse of its name, birth year, sire and
    dam, a redirect of its key by country and name, a horse that has that key, else a new id. Records
    that mean the same new horse get one id: numbers after the greatest known, in order of key.
    ``incoming``: row_id, source, source_id, registration_number, name, country, birth_year,
    sire_name, dam_name, race_id, program_number. ``known``: horse_id, source, source_id (one row an
    id), registration_number, name, birth_year, sire_name, dam_name. Records with neither an id nor a
    name get none.
    """
    real = F.col("source_id").isNotNull() & (F.col("source_id") != "") & ~F.col("source_id").startswith("x:")
    rows = incoming.withColumns({"_id": F.when(real, F.col("source_id")), "_synth": synth_id(F.col("country"), F.col("name"))})
    for c in ("name", "sire_name", "dam_name"):
        rows = rows.withColumn(f"_{c}", normalize_name(F.col(c)))
    strong = rows.where("_id is not null")
    weak = rows.where("_id is null")
    by_id = strong.join(known.select("source", F.col("source_id").alias("_id"), "horse_id"), ["source", "_id"]).groupBy("row_id").agg(F.min("horse_id").alias("horse_id"))
    by_registration = strong.join(known.select("registration_number", "horse_id").distinct(), "registration_number").groupBy("row_id").agg(F.min("horse_id").alias("horse_id"))
    by_race = weak.join(placed.select("race_id", "program_number", "horse_id"), ["race_id", "program_number"]).groupBy("row_id").agg(F.min("horse_id").alias("horse_id"))
    named = known.select("horse_id", "birth_year", *(normalize_name(F.col(c)).alias(f"_{c}") for c in ("name", "sire_name", "dam_name"))).where("_name <> '' and _sire_name <> '' and _dam_name <> ''")
    by_pedigree = unique_matches(weak.join(named, ["_name", "birth_year", "_sire_name", "_dam_name"]).select("row_id", "horse_id"), "row_id", "horse_id")
    by_synth = weak.join(known.select("source", F.col("source_id").alias("_synth"), "horse_id"), ["source", "_synth"]).groupBy("row_id").agg(F.min("horse_id").alias("horse_id"))
    led = lambda df, key: first_redirect(df, redirects, "row_id", "source", key).withColumnRenamed("to_id", "horse_id")
    levels = [("redirect", led(strong, "_id")), ("id", by_id), ("registration", by_registration), ("race", by_race), ("pedigree", by_pedigree), ("synth_redirect", led(weak, "_synth")), ("synth", by_synth)]
    found = cascade(rows.select("row_id", "source", F.coalesce("_id", "_synth").alias("_new")), "row_id", levels, "horse_id")
    fresh = found.where("horse_id is null and _new is not null").select("source", "_new").distinct()
    last = known.agg(F.max("horse_id")).first()[0] or 0
    return _with_new_ids(found, fresh, int(last)).select("row_id", "horse_id", "how")


#: Parts in which new keys are numbered, so that no task orders all of them.
NUMBERING_PARTS = 64


def _with_new_ids(found: DataFrame, fresh: DataFrame, last: int) -> DataFrame:
    """New ids for fresh keys, in order of a hash of the key within hashed parts."""
    part = F.pmod(F.xxhash64("source", "_new"), F.lit(NUMBERING_PARTS)).cast("int")
    keyed = fresh.withColumn("_p", part)
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # at most NUMBERING_PARTS rows
    place = F.row_number().over(Window.partitionBy("_p").orderBy("source", "_new"))
    ids = keyed.withColumn("_i", place).join(F.broadcast(before), "_p").select("source", "_new", (F.lit(last) + F.col("_b") + F.col("_i")).alias("_fresh"))
    out = found.join(ids, ["source", "_new"], "left")
    new = F.col("horse_id").isNull() & F.col("_fresh").isNotNull()
    return out.withColumns({"how": F.when(new, "insert").otherwise(F.col("how")), "horse_id": F.coalesce("horse_id", "_fresh")})


def shared_horses(entries: DataFrame, person: str, one: str, other: str, least: int = 30) -> DataFrame:
    """``(person_id, other_id, shared)``: people of two sources who had at least ``least`` horses in common."""
    of = lambda source, name: entries.where((F.col("primary_source") == source) & F.col(person).isNotNull() & F.col("horse_id").isNotNull()).select("horse_id", F.col(person).alias(name)).distinct()
    met = of(one, "person_id").join(of(other, "other_id"), "horse_id").where("person_id <> other_id")
    return met.groupBy("person_id", "other_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def same_people(entries: DataFrame, person: str, one: str, other: str, least: int = 30, ratio: float = 0.5) -> DataFrame:
    """The pairs of :func:`shared_horses` that are each other's best, every runner-up below ``ratio`` of them."""
    return mutual_best(shared_horses(entries, person, one, other, least), "person_id", "other_id", "shared", ratio)


def stub_links(races: DataFrame, entries: DataFrame, placeholders: Column, most: int) -> DataFrame:
    """``(stub_race_id, real_race_id, shared)``: races on placeholder tracks and the real ones of that day.

    A stub has at most ``most`` entries; a real race shares horses with it, runs on another track and
    has strictly more entries. ``races`` holds race_id, race_date and the columns of ``placeholders``.
    """
    e = entries.select("race_id", "horse_id").dropna(subset=["race_id"])
    n = e.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))
    r = races.join(n, "race_id").withColumn("_stub", F.coalesce(placeholders, F.lit(False)))
    side = lambda df, name, size: df.select(F.col("race_id").alias(name), "race_date", F.col("n").alias(size)).join(e.withColumnRenamed("race_id", name), name).where("horse_id is not null")
    stub, real = side(r.where(F.col("_stub") & (F.col("n") <= most)), "stub_race_id", "stub_n"), side(r.where("not _stub"), "real_race_id", "real_n")
    met = stub.join(real, ["race_date", "horse_id"]).where("real_n > stub_n")
    return met.groupBy("stub_race_id", "real_race_id").agg(F.countDistinct("horse_id").alias("shared"))


def misjoined(races: DataFrame, entries: DataFrame, one: str = "st", other: str = "atg") -> DataFrame:
    """``(race_id, one_n, other_n, why)``: races joined from two sources that do not fit each other.

    Both sources have entries, and more than one source names a winner or they share no horse.
    """
    both = races.where(F.col(f"{one}_race_id").isNotNull() & F.col(f"{other}_race_id").isNotNull()).select("race_id")
    e = entries.join(both, "race_id", "left_semi")
    of = lambda s: F.col("primary_source") == s
    g = e.groupBy("race_id").agg(
        F.countDistinct(F.when(of(one), F.col("entry_id"))).alias("one_n"), F.countDistinct(F.when(of(other), F.col("entry_id"))).alias("other_n"), F.countDistinct(F.when(F.col("placement_text") == "1", F.col("primary_source"))).alias("winners")
    )
    common = e.where(of(one)).select("race_id", "horse_id").join(e.where(of(other)).select("race_id", "horse_id"), ["race_id", "horse_id"]).select("race_id").distinct().withColumn("_common", F.lit(True))
    bad = g.where("one_n > 0 and other_n > 0").join(common, "race_id", "left")
    why = F.when(F.col("winners") > 1, "two winners").when(F.col("_common").isNull(), "no common horse")
    return bad.withColumn("why", why).where("why is not null").select("race_id", "one_n", "other_n", "why")


def matched_tracks(incoming: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(row_id, track_id)`` by name: the same country, else a track of unknown country; any where the record has none.

    Of several the least id; records without a country take a known country's track first.
    """
    t = tracks.where("name is not null").select(F.lower("name").alias("_n"), F.col("country").alias("_c"), "track_id")
    met = incoming.withColumn("_n", F.lower("name")).join(t, "_n").where(F.col("country").isNull() | F.col("_c").isNull() | (F.col("country") == F.col("_c")))
    return met.groupBy("row_id").agg(F.min_by("track_id", F.struct(F.col("_c").isNull(), F.when(F.col("country").isNull(), F.col("_c")), "track_id")).alias("track_id"))


def post_else_name(timed: DataFrame, entries: DataFrame) -> DataFrame:
    """``(row_id, entry_id, how)``: entries of a race by post, else by name in any case; unmatched rows have neither."""
    by = lambda df, key, name: df.dropna(subset=["race_id", key]).groupBy("race_id", key).agg(F.min("entry_id").alias(name))
    t, e = timed.withColumn("_n", F.lower("name")), entries.withColumn("_n", F.lower("name"))
    met = t.join(by(e, "post", "_p"), ["race_id", "post"], "left").join(by(e, "_n", "_m"), ["race_id", "_n"], "left")
    how = F.when(F.col("_p").isNotNull(), "post").when(F.col("_m").isNotNull(), "name")
    return met.select("row_id", F.coalesce("_p", "_m").alias("entry_id"), how.alias("how"))
