"""Repairs as derived updates: each gives only the rows it changes, with their new values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.operators import predicates as P
from paddock.plans.base import START, WIN, E, fact, flagged_fact, n_if, query, total
from paddock.plans.browse import paged
from paddock.plans.statistics import _ROLES, _roles
from paddock.runtime import table


def placements_repaired(results: DataFrame) -> DataFrame:
    """Placements set from their texts, and first places taken from rows whose text says unplaced."""
    e = results.where("race_id is not null")
    n = F.col("placement_text").try_cast("int")
    e = e.withColumn("p", F.when(F.col("placement_text").rlike("^[1-9][0-9]?$") & n.between(1, 15), n).otherwise(F.col("placement").cast("int")))
    e = e.withColumn("top", F.max("p").over(Window.partitionBy("race_id")))
    new = F.when((F.col("placement_text") == "0") & (F.col("p") == 1) & (F.col("top") > 1), None).otherwise(F.col("p"))
    return e.select("entry_id", F.col("placement").alias("old"), new.alias("placement")).where(~F.col("old").eqNullSafe(F.col("placement")))


@query(f"""WITH {E}, l AS (SELECT horse_id, arg_max(sex, (race_date, entry_id)) sex FROM e WHERE horse_id IS NOT NULL AND sex IN ('H', 'V', 'S') AND race_date IS NOT NULL GROUP BY horse_id)
SELECT horse_id, gender_code old, l.sex gender_code FROM horse JOIN l USING (horse_id) WHERE gender_code IS NULL OR gender_code NOT IN ('H', 'V', 'S') OR (gender_code = 'S') <> (l.sex = 'S')""")
def repair_sex(spark: SparkSession, d: str) -> DataFrame:
    """Sexes that are no code or contradict the latest start on whether the horse is a mare."""
    l = fact(spark, d, "horse_id", "sex", "race_date").where("horse_id is not null and sex in ('H', 'V', 'S') and race_date is not null").groupBy("horse_id").agg(F.max_by("sex", F.struct("race_date", "entry_id")).alias("sex"))  # noqa: E741
    h = table(spark, d, "horse").select("horse_id", F.col("gender_code").alias("old"))
    wrong = F.col("old").isNull() | ~F.col("old").isin("H", "V", "S") | ((F.col("old") == "S") != (F.col("sex") == "S"))
    return h.join(l, "horse_id").where(wrong).select("horse_id", "old", F.col("sex").alias("gender_code"))


@query("SELECT c.horse_id, 'sire' AS link FROM horse c JOIN horse p ON p.horse_id = c.sire_id WHERE p.date_of_birth > DATE '1910-11-12' AND c.date_of_birth > DATE '1910-11-12' AND p.date_of_birth >= c.date_of_birth UNION ALL SELECT c.horse_id, 'dam' FROM horse c JOIN horse p ON p.horse_id = c.dam_id WHERE p.date_of_birth > DATE '1910-11-12' AND c.date_of_birth > DATE '1910-11-12' AND p.date_of_birth >= c.date_of_birth")
def repair_parent_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to unlink: a parent with a reliable birth date that is not older than its foal."""
    h = table(spark, d, "horse").where("date_of_birth > '1910-11-12'").select("horse_id", "date_of_birth", "sire_id", "dam_id")
    kinds = F.explode(F.array(F.struct(F.lit("sire").alias("link"), F.col("sire_id").alias("parent")), F.struct(F.lit("dam").alias("link"), F.col("dam_id").alias("parent")))).alias("k")
    kids = h.select("horse_id", F.col("date_of_birth").alias("born"), kinds).select("horse_id", "born", "k.link", "k.parent")
    return kids.join(h.select(F.col("horse_id").alias("parent"), "date_of_birth"), "parent").where("date_of_birth >= born").select("horse_id", "link")


@query("SELECT horse_id, name || ' (' || birth_country || ')' \"name\" FROM horse WHERE regexp_matches(birth_country, '^[A-Z]{2}$') AND birth_country NOT IN ('SE', 'XX') AND name IS NOT NULL AND NOT regexp_matches(name, '\\([A-Z]{2}\\)\\s*$') AND length(trim(name)) > 2")
def repair_name_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Names of foreign horses with their country appended."""
    h = table(spark, d, "horse").where(F.col("birth_country").rlike("^[A-Z]{2}$") & ~F.col("birth_country").isin("SE", "XX") & ~F.col("name").rlike(r"\([A-Z]{2}\)\s*$") & (F.length(F.trim("name")) > 2))
    return h.select("horse_id", F.concat("name", F.lit(" ("), "birth_country", F.lit(")")).alias("name"))


@query(f"""WITH {E}, {_ROLES}, s AS (SELECT "role", person_id, {n_if(START)} starts, {n_if(WIN)} wins, coalesce(sum(prize_kr), 0)::BIGINT prize_kr FROM r GROUP BY ALL)
SELECT *, CASE WHEN starts >= 7 THEN round_even(wins * 1000.0::DOUBLE / starts, 0)::INT END form, count(*) OVER () total_rows FROM s WHERE starts BETWEEN 5 AND 100000 ORDER BY form DESC NULLS LAST, prize_kr DESC, "role", person_id LIMIT 40 OFFSET 5""")
def browse_persons(spark: SparkSession, d: str) -> DataFrame:
    """A page of people by form, with the number of all matches."""
    from paddock.functions.parse import permille

    s = _roles(flagged_fact(spark, d, "driver_id", "trainer_id", "prize_kr")).groupBy("role", "person_id").agg(P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"), total("prize_kr").alias("prize_kr"))
    s = s.where(P.all_of(P.between("starts", 5, 100_000)))
    out = s.select("*", permille(F.col("starts"), F.col("wins")).alias("form"))
    return paged(out, [F.col("form").desc_nulls_last(), F.desc("prize_kr"), F.col("role"), F.col("person_id")], 5, 40)
