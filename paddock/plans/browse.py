"""Read queries: faceted browsing, search, relatives, history, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions.parse import strip_accents
from paddock.operators import predicates as P
from paddock.plans.base import START, WIN, E, fact, flagged_fact, n_if, query, total
from paddock.runtime import cut, table

_AGE = "2024-12-31"


def paged(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in order, with the number of all rows as ``total_rows``.

    Found rows are written once; page and count read them.
    """
    found = cut(rows, "found")
    return found.df.orderBy(*order).offset(offset).limit(limit).withColumn("total_rows", F.lit(found.seen["rows"]).cast("bigint"))


@query(f"""WITH {E}, s AS (SELECT horse_id, {n_if(START)} starts, {n_if(WIN)} wins, coalesce(sum(prize_kr), 0)::BIGINT prize_kr, max(race_date) last_start FROM e WHERE horse_id IS NOT NULL GROUP BY horse_id)
SELECT h.horse_id, h.name, starts, wins, prize_kr, CASE WHEN is_dead THEN 'deceased' WHEN last_start >= DATE '{_AGE}' - INTERVAL 15 MONTHS THEN 'active' ELSE 'inactive' END activity, round(wins::DOUBLE / nullif(starts, 0), 6) win_rate, count(*) OVER () total_rows
FROM h0 h JOIN s USING (horse_id) WHERE starts >= 2 AND (h.gender_code IS NULL OR h.gender_code IN ('H', 'S')) AND prize_kr BETWEEN 1000 AND 5000000
ORDER BY win_rate DESC NULLS LAST, prize_kr DESC, horse_id LIMIT 50 OFFSET 10""".replace("h0 h", "horse h"))
def browse_facets(spark: SparkSession, d: str) -> DataFrame:
    e = flagged_fact(spark, d, "horse_id", "prize_kr", "race_date").where("horse_id is not null")
    s = e.groupBy("horse_id").agg(P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"), total("prize_kr").alias("prize_kr"), F.max("race_date").alias("last_start"))
    h = table(spark, d, "horse").select("horse_id", "name", "gender_code", "is_dead")
    wanted = P.all_of([*P.between("starts", 2), F.col("gender_code").isNull() | F.col("gender_code").isin("H", "S"), *P.between("prize_kr", 1000, 5_000_000)])
    found = h.join(s, "horse_id").where(wanted)
    activity = F.when(F.col("is_dead"), "deceased").when(F.col("last_start") >= F.add_months(F.lit(_AGE).cast("date"), -15), "active").otherwise("inactive")
    out = found.select("horse_id", "name", "starts", "wins", "prize_kr", activity.alias("activity"), F.round(F.col("wins").cast("double") / F.when(F.col("starts") != 0, F.col("starts")), 6).alias("win_rate"))
    return paged(out, [F.col("win_rate").desc_nulls_last(), F.desc("prize_kr"), F.col("horse_id")], 10, 50)


@query("SELECT horse_id, name FROM horse WHERE contains(lower(strip_accents(replace(replace(replace(replace(name, 'ø', 'o'), 'Ø', 'O'), 'æ', 'ae'), 'Æ', 'AE'))), 'etoile')")
def search_ci_ai(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse").select("horse_id", "name").where(F.contains(F.lower(strip_accents(F.col("name"))), F.lit("etoile")))


@query("""WITH f AS (SELECT a.horse_id, b.horse_id sibling_id FROM horse a JOIN horse b ON a.sire_id = b.sire_id AND a.horse_id <> b.horse_id WHERE a.horse_id % 100 = 0),
m AS (SELECT a.horse_id, b.horse_id sibling_id FROM horse a JOIN horse b ON a.dam_id = b.dam_id AND a.horse_id <> b.horse_id WHERE a.horse_id % 100 = 0)
SELECT coalesce(f.horse_id, m.horse_id) horse_id, coalesce(f.sibling_id, m.sibling_id) sibling_id, CASE WHEN f.horse_id IS NULL THEN 'maternal' WHEN m.horse_id IS NULL THEN 'paternal' ELSE 'full' END kind
FROM f FULL JOIN m ON f.horse_id = m.horse_id AND f.sibling_id = m.sibling_id""")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    """Siblings of every hundredth horse among all horses: two equality joins, no OR.

    A page asks for one horse; the query set stands for many such requests.
    """
    h = table(spark, d, "horse").select("horse_id", "sire_id", "dam_id")
    asked = h.where("horse_id % 100 = 0")

    def by(parent: str, kind: str) -> DataFrame:
        other = h.select(F.col("horse_id").alias("sibling_id"), parent).where(F.col(parent).isNotNull())
        return asked.select("horse_id", parent).join(other, parent).where("horse_id <> sibling_id").select("horse_id", "sibling_id", F.lit(kind).alias(kind))

    both = by("sire_id", "paternal").join(by("dam_id", "maternal"), ["horse_id", "sibling_id"], "full")
    kind = F.when(F.col("paternal").isNull(), "maternal").when(F.col("maternal").isNull(), "paternal").otherwise("full")
    return both.select("horse_id", "sibling_id", kind.alias("kind"))


@query("""WITH f AS (SELECT a.horse_id, b.horse_id sibling_id FROM horse a JOIN horse b ON a.sire_id = b.sire_id AND a.horse_id <> b.horse_id),
m AS (SELECT a.horse_id, b.horse_id sibling_id FROM horse a JOIN horse b ON a.dam_id = b.dam_id AND a.horse_id <> b.horse_id),
x AS (SELECT coalesce(f.horse_id, m.horse_id) horse_id, CASE WHEN f.horse_id IS NULL THEN 'maternal' WHEN m.horse_id IS NULL THEN 'paternal' ELSE 'full' END kind FROM f FULL JOIN m ON f.horse_id = m.horse_id AND f.sibling_id = m.sibling_id)
SELECT h.horse_id, count(CASE WHEN kind = 'full' THEN 1 END) n_full, count(CASE WHEN kind = 'paternal' THEN 1 END) n_paternal, count(CASE WHEN kind = 'maternal' THEN 1 END) n_maternal FROM horse h LEFT JOIN x USING (horse_id) GROUP BY h.horse_id""")
def sibling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Full, paternal and maternal siblings of every horse, from the foals of each parent and pair of parents."""
    h = table(spark, d, "horse").select("horse_id", "sire_id", "dam_id")

    def others(rows: DataFrame, parents: list[str], name: str) -> DataFrame:
        return rows.join(h.dropna(subset=parents).groupBy(*parents).agg((F.count(F.lit(1)) - 1).alias(name)), parents, "left")

    n = others(others(others(h, ["sire_id"], "by_sire"), ["dam_id"], "by_dam"), ["sire_id", "dam_id"], "both")
    known = lambda c: F.coalesce(c, F.lit(0))
    return n.select("horse_id", known("both").alias("n_full"), (known("by_sire") - known("both")).alias("n_paternal"), (known("by_dam") - known("both")).alias("n_maternal"))


@query("""WITH k AS (SELECT sire_id parent, 'sire' AS "role", horse_id, dam_id other FROM horse WHERE sire_id IS NOT NULL UNION ALL SELECT dam_id, 'dam', horse_id, sire_id FROM horse WHERE dam_id IS NOT NULL)
SELECT parent, "role", count(*) foals, count(DISTINCT other) partners, min(horse_id) first_foal FROM k GROUP BY ALL""")
def offspring_edges(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "horse").select("horse_id", "sire_id", "dam_id")
    one = lambda p, o, r: h.where(F.col(p).isNotNull()).select(F.col(p).alias("parent"), F.lit(r).alias("role"), "horse_id", F.col(o).alias("other"))
    k = one("sire_id", "dam_id", "sire").unionByName(one("dam_id", "sire_id", "dam"))
    return k.groupBy("parent", "role").agg(F.count(F.lit(1)).alias("foals"), F.countDistinct("other").alias("partners"), F.min("horse_id").alias("first_foal"))


@query(f"WITH {E} SELECT r.race_id, (SELECT count(*) FROM e WHERE e.race_id = r.race_id) entries, (SELECT e.horse_id FROM e WHERE e.race_id = r.race_id AND e.placement = 1 ORDER BY e.entry_id LIMIT 1) winner_id FROM race r")
def lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    per = fact(spark, d, "race_id", "placement", "horse_id").where("race_id is not null").groupBy("race_id").agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("placement") == 1, F.struct("entry_id", "horse_id"))).alias("w"))
    return table(spark, d, "race").select("race_id").join(per, "race_id", "left").select("race_id", F.coalesce("entries", F.lit(0)).alias("entries"), F.col("w.horse_id").alias("winner_id"))


@query(f"""WITH {E} SELECT 'entry_race' kind, entry_id::BIGINT id FROM e WHERE race_id IS NOT NULL AND race_id NOT IN (SELECT race_id FROM race WHERE race_id IS NOT NULL)
UNION ALL SELECT 'entry_horse', entry_id FROM e WHERE horse_id IS NOT NULL AND horse_id NOT IN (SELECT horse_id FROM horse) UNION ALL SELECT 'sire', horse_id FROM horse WHERE sire_id IS NOT NULL AND sire_id NOT IN (SELECT horse_id FROM horse)""")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    e, h, r = fact(spark, d, "race_id", "horse_id"), table(spark, d, "horse"), table(spark, d, "race")
    out = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("bigint").alias("id"))
    a = out(e.where("race_id is not null").join(r.select("race_id"), "race_id", "left_anti"), "entry_race", "entry_id")
    b = out(e.where("horse_id is not null").join(h.select("horse_id"), "horse_id", "left_anti"), "entry_horse", "entry_id")
    c = out(h.select("horse_id", "sire_id").where("sire_id is not null").join(h.select(F.col("horse_id").alias("sire_id")), "sire_id", "left_anti"), "sire", "horse_id")
    return a.unionByName(b).unionByName(c)


@query("""SELECT horse_id, trainer_id, from_date, to_date FROM horse_trainer_history WHERE horse_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY horse_id ORDER BY (to_date IS NULL) DESC, from_date DESC NULLS LAST, recorded_at DESC NULLS LAST, trainer_id DESC NULLS LAST) = 1""")
def scd2_current(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "horse_trainer_history").where("horse_id is not null")
    by = F.struct(F.col("to_date").isNull(), "from_date", "recorded_at", "trainer_id")
    return t.groupBy("horse_id").agg(F.max_by(F.struct("trainer_id", "from_date", "to_date"), by).alias("x")).select("horse_id", "x.*")


@query(f"""WITH {E}, t AS (SELECT e.horse_id, e.race_id, e.time_seconds, e.race_date FROM e WHERE time_seconds BETWEEN 65 AND 100 AND placement IS NOT NULL) SELECT * FROM t ORDER BY time_seconds, race_date, horse_id, race_id LIMIT 50""")
def fastest_times(spark: SparkSession, d: str) -> DataFrame:
    t = fact(spark, d, "horse_id", "race_id", "time_seconds", "race_date", "placement").where("time_seconds between 65 and 100 and placement is not null")
    return t.select("horse_id", "race_id", "time_seconds", "race_date").orderBy("time_seconds", F.col("race_date").asc_nulls_last(), F.col("horse_id").asc_nulls_last(), F.col("race_id").asc_nulls_last()).limit(50)


@query(f"""WITH {E} SELECT e.entry_id, e.horse_id, h.name, r.track_id, t.name track, e.placement, e.race_date FROM e LEFT JOIN race r USING (race_id) LEFT JOIN track t USING (track_id) LEFT JOIN horse h ON h.horse_id = e.horse_id
WHERE e.horse_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e.horse_id ORDER BY e.race_date DESC NULLS LAST, e.entry_id DESC) <= 5""")
def horse_races(spark: SparkSession, d: str) -> DataFrame:
    e = fact(spark, d, "horse_id", "race_id", "placement", "race_date").where("horse_id is not null")
    w = Window.partitionBy("horse_id").orderBy(F.col("race_date").desc_nulls_last(), F.desc("entry_id"))
    top = e.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    t = table(spark, d, "track").select("track_id", F.col("name").alias("track"))
    return top.join(table(spark, d, "race").select("race_id", "track_id"), "race_id", "left").join(t, "track_id", "left").join(table(spark, d, "horse").select("horse_id", "name"), "horse_id", "left").select("entry_id", "horse_id", "name", "track_id", "track", "placement", "race_date")


@query("WITH m AS (SELECT r.race_id, unnest(pool_types) pool FROM race r) SELECT pool, count(*) races FROM m GROUP BY pool")
def pool_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "race").select(F.explode("pool_types").alias("pool")).groupBy("pool").agg(F.count(F.lit(1)).alias("races"))
