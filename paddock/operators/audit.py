"""Audits of identity: how many records break a rule and how many entries hang on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.parse import normalize_name

#: Days of the 18 years after which a horse no longer starts.
EIGHTEEN_YEARS = 6570


def _synthetic() -> Column:
    return F.col("atg_id").startswith("x:")


def _numeric() -> Column:
    return F.col("atg_id").rlike("^[0-9]+$") & (F.coalesce(F.col("atg_id").try_cast("int"), F.lit(0)) != 0)


def _per_horse(entry: DataFrame) -> DataFrame:
    return entry.where("horse_id is not null").groupBy("horse_id").agg(F.count(F.lit(1)).alias("n"))


def _totals(rows: DataFrame, entries: str | None = "n") -> DataFrame:
    n = F.coalesce(F.sum(entries), F.lit(0)).cast("bigint") if entries else F.lit(None).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("count"), n.alias("entries"))


def polluted(horse: DataFrame, entry: DataFrame) -> DataFrame:
    """Registered horses with a synthetic id whose first race is over 18 years after birth; entries that late."""
    h = horse.where(_synthetic() & F.col("date_of_birth").isNotNull() & F.col("st_id").isNotNull()).select("horse_id", "date_of_birth")
    late = F.datediff("race_date", "date_of_birth") > EIGHTEEN_YEARS
    g = entry.join(h, "horse_id").groupBy("horse_id").agg(F.min(F.datediff("race_date", "date_of_birth")).alias("first"), F.count(F.when(late, 1)).alias("n"))
    return _totals(g.where(F.col("first") > EIGHTEEN_YEARS))


def real_and_synthetic(horse: DataFrame, entry: DataFrame) -> DataFrame:
    """Pairs of a horse with a number and a synthetic one of its name, countries equal or unknown."""
    h = horse.withColumn("nn", normalize_name(F.col("name"))).where("nn <> ''").join(_per_horse(entry), "horse_id", "left").select("horse_id", "nn", "birth_country", "atg_id", F.coalesce("n", F.lit(0)).alias("n"))
    real = h.where(_numeric())
    synth = h.where(_synthetic()).select("nn", F.col("horse_id").alias("other"), F.col("birth_country").alias("c2"), F.col("n").alias("n2"))
    pairs = real.join(synth, "nn").where("horse_id <> other and (birth_country = c2 or birth_country is null or c2 is null)")
    return _totals(pairs.withColumn("n", F.col("n") + F.col("n2")))


def same_pedigree(horse: DataFrame) -> DataFrame:
    """Groups of several horses with one name, birth year, sire and dam."""
    known = horse.dropna(subset=["name", "date_of_birth", "sire_name", "dam_name"])
    g = known.groupBy(*(normalize_name(F.col(c)).alias(c) for c in ("name", "sire_name", "dam_name")), F.year("date_of_birth").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    return _totals(g.where("k > 1"), None)


def synthetic_namesakes(horse: DataFrame) -> DataFrame:
    """Names that several synthetic horses share."""
    g = horse.where(_synthetic()).groupBy(normalize_name(F.col("name")).alias("nn")).agg(F.count(F.lit(1)).alias("k"))
    return _totals(g.where("k > 1"), None)


def never_entered(horse: DataFrame, entry: DataFrame) -> DataFrame:
    """Registered horses of one source only that have no entry."""
    return _totals(horse.where("st_id is not null and atg_id is null").join(entry.select("horse_id"), "horse_id", "left_anti").withColumn("n", F.lit(0)))


def repeated_keys(horse: DataFrame, keys: list[str]) -> DataFrame:
    """``(key, rows)``: rows whose value of a key that should be unique is not."""
    each = horse.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select("x.*").where("value is not null")
    many = each.groupBy("key", "value").agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy("key").agg(F.sum("k").alias("rows"))
    names = each.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return names.join(many, "key", "left").select("key", F.coalesce("rows", F.lit(0)).alias("rows"))


def repeated_races(race: DataFrame, entry: DataFrame) -> DataFrame:
    """Groups of races with one track, day and number; the entries of their races."""
    n = entry.where("race_id is not null").groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))
    g = race.dropna(subset=["track_id", "race_number"]).join(n, "race_id", "left").groupBy("track_id", "race_date", "race_number").agg(F.count(F.lit(1)).alias("k"), F.when(F.col("race_date").isNotNull(), F.sum("n")).alias("n"))
    return _totals(g.where("k > 1"))


def synthetic_people(person: DataFrame) -> DataFrame:
    """People with a number and a synthetic namesake, as pairs; ``orphans``: synthetic people without registration."""
    p = person.withColumn("nn", F.upper("name"))
    pairs = p.where(_numeric()).select("person_id", "nn").join(p.where(_synthetic()).select("nn", F.col("person_id").alias("other")), "nn").where("person_id <> other").agg(F.count(F.lit(1)).alias("count"))
    alone = person.where(_synthetic() & F.col("st_id").isNull()).agg(F.count(F.lit(1)).alias("orphans"))
    one = lambda df: df.withColumn("_", F.lit(1))
    return one(pairs).join(one(alone), "_").drop("_")


def repeated_tracks(track: DataFrame) -> DataFrame:
    """Groups of tracks with one name in any case and one country, unknown ones included."""
    return _totals(track.groupBy(F.lower("name").alias("nn"), "country").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), None)


def foreign_only(horse: DataFrame, entry: DataFrame) -> DataFrame:
    """Synthetic horses without registration that have entries."""
    return _totals(horse.where(_synthetic() & F.col("st_id").isNull()).join(entry.select("horse_id"), "horse_id", "left_semi"), None)


def two_ids_in_a_row(horse: DataFrame, entry: DataFrame) -> DataFrame:
    """Registered horses that have a synthetic id as well; their entries."""
    return _totals(horse.where(_synthetic() & F.col("st_id").isNotNull()).join(_per_horse(entry), "horse_id", "left"))


def latest(log: DataFrame, limit: int = 20) -> DataFrame:
    """The merges logged last."""
    return log.orderBy(F.col("merged_at").desc_nulls_last(), F.desc("merge_id")).limit(limit)
