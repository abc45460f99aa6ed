"""Identity resolution, merging, auditing and repair over the racing tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.parse import normalize_name
from paddock.operators import identity as I
from paddock.operators import incremental as N
from paddock.operators.hierarchy import nested_sets
from paddock.plans.base import E, fact, query
from paddock.runtime import table


def _norm_sql(c: str) -> str:
    """The SQL twin of normalize_name."""
    two = c
    for a, b in (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss"), ("ø", "o"), ("Ø", "O")):
        two = f"replace({two}, '{a}', '{b}')"
    bare = f"regexp_replace(strip_accents({two}), '[*·]+|\\s*\\([A-Z]{{1,3}}\\)\\s*$|\\s*\\?\\s*$', '', 'g')"
    return f"coalesce(regexp_replace(upper(trim({bare})), '\\s+', ' ', 'g'), '')"


def _named(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "horse").select("horse_id", "name", *more).withColumn("nn", normalize_name(F.col("name"))).where("length(nn) > 2 and nn not in ('N.N.', 'UNKNOWN', 'UNBEKANNT', 'INCONNU', 'OKAND')")


_H = f"h AS (SELECT *, {_norm_sql('name')} nn FROM horse WHERE length({_norm_sql('name')}) > 2 AND {_norm_sql('name')} NOT IN ('N.N.', 'UNKNOWN', 'UNBEKANNT', 'INCONNU', 'OKAND'))"


@query(f"SELECT horse_id, {_norm_sql('name')} norm FROM horse")
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse").select("horse_id", normalize_name(F.col("name")).alias("norm"))


@query(f"WITH {_H} SELECT nn, birth_country, year(date_of_birth)::INT birth_year, count(*) OVER g n, min(horse_id) OVER g keep, horse_id FROM h WHERE birth_country IS NOT NULL AND date_of_birth IS NOT NULL WINDOW g AS (PARTITION BY nn, birth_country, year(date_of_birth)) QUALIFY count(*) OVER g > 1")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicate_groups(_named(spark, d, "birth_country", "date_of_birth").withColumn("birth_year", F.year("date_of_birth")), ["nn", "birth_country", "birth_year"], "horse_id")


@query(f"WITH {_H} SELECT a.horse_id, b.horse_id other_id FROM h a JOIN h b ON a.nn = b.nn AND a.horse_id < b.horse_id AND (a.birth_country = b.birth_country OR a.birth_country IS NULL OR b.birth_country IS NULL)")
def null_tolerant_theta(spark: SparkSession, d: str) -> DataFrame:
    """Namesakes whose countries agree or are unknown: an equality on names, the rest a condition."""
    a = _named(spark, d, "birth_country")
    b = a.select(F.col("horse_id").alias("other_id"), "nn", F.col("birth_country").alias("c2"))
    return a.join(b, "nn").where("horse_id < other_id and (birth_country = c2 or birth_country is null or c2 is null)").select("horse_id", "other_id")


@query(f"WITH {_H}, k AS (SELECT horse_id, nn, year(date_of_birth) y, birth_country FROM h WHERE date_of_birth IS NOT NULL), p AS (SELECT a.horse_id, b.horse_id other_id FROM k a JOIN k b ON a.nn = b.nn AND a.y = b.y AND a.birth_country = b.birth_country AND a.horse_id <> b.horse_id) SELECT horse_id, min(other_id) other_id FROM p GROUP BY horse_id HAVING count(DISTINCT other_id) = 1")
def unique_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    k = _named(spark, d, "birth_country", "date_of_birth").withColumn("y", F.year("date_of_birth"))
    p = k.join(k.select("nn", "y", "birth_country", F.col("horse_id").alias("other_id")), ["nn", "y", "birth_country"]).where("horse_id <> other_id")
    return I.unique_matches(p, "horse_id", "other_id")


@query("SELECT a.race_id, b.race_id other_id FROM race a JOIN race b ON a.race_date = b.race_date AND a.race_number = b.race_number AND a.distance = b.distance AND a.track_id < b.track_id")
def cross_track_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "race").select("race_id", "race_date", "race_number", "distance", "track_id")
    o = r.select(F.col("race_id").alias("other_id"), "race_date", "race_number", "distance", F.col("track_id").alias("t2"))
    return r.join(o, ["race_date", "race_number", "distance"]).where("track_id < t2").select("race_id", "other_id")


@query(f"""WITH {E}, f AS (SELECT race_id, list_sort(list(DISTINCT horse_id)) horses FROM e WHERE race_id IS NOT NULL AND horse_id IS NOT NULL GROUP BY race_id),
p AS (SELECT a.race_id, b.race_id other_id FROM race a JOIN race b ON a.race_date = b.race_date AND a.race_number = b.race_number AND a.race_id < b.race_id)
SELECT p.race_id, p.other_id, len(list_intersect(x.horses, y.horses))::INT shared, round(len(list_intersect(x.horses, y.horses))::DOUBLE / len(list_distinct(list_concat(x.horses, y.horses))), 6) score
FROM p JOIN f x ON x.race_id = p.race_id JOIN f y ON y.race_id = p.other_id""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the fields of races with the same day and number."""
    f = fact(spark, d, "race_id", "horse_id").dropna().groupBy("race_id").agg(F.collect_set("horse_id").alias("horses"))
    r = table(spark, d, "race").select("race_id", "race_date", "race_number").join(f, "race_id")
    o = r.select(F.col("race_id").alias("other_id"), "race_date", "race_number", F.col("horses").alias("others"))
    p = r.join(o, ["race_date", "race_number"]).where("race_id < other_id")
    return p.select("race_id", "other_id", F.size(F.array_intersect("horses", "others")).alias("shared"), F.round(I.jaccard("horses", "others"), 6).alias("score"))


@query(f"""WITH {_H}, r AS (SELECT raw_id, {_norm_sql('name')} nn, {_norm_sql('sire_name')} s FROM horse_raw), a AS (SELECT nn, {_norm_sql('sire_name')} s, min(horse_id) horse_id FROM h WHERE {_norm_sql('sire_name')} <> '' GROUP BY ALL HAVING count(*) = 1), b AS (SELECT nn, min(horse_id) horse_id FROM h GROUP BY nn HAVING count(*) = 1)
SELECT r.raw_id, coalesce(a.horse_id, b.horse_id) horse_id, CASE WHEN a.horse_id IS NOT NULL THEN 'name+sire' WHEN b.horse_id IS NOT NULL THEN 'name' END how FROM r LEFT JOIN a ON a.nn = r.nn AND a.s = r.s LEFT JOIN b ON b.nn = r.nn""")
def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    """Foreign records matched by name and sire, else by name alone, where just one horse has them."""
    h = _named(spark, d, "sire_name").withColumn("s", normalize_name(F.col("sire_name")))
    r = table(spark, d, "horse_raw").select("raw_id", normalize_name(F.col("name")).alias("nn"), normalize_name(F.col("sire_name")).alias("s"))
    strict = r.join(h.where("s <> ''").groupBy("nn", "s").agg(F.min("horse_id").alias("horse_id"), F.count(F.lit(1)).alias("k")).where("k = 1"), ["nn", "s"]).select("raw_id", "horse_id")
    single = h.groupBy("nn").agg(F.min("horse_id").alias("horse_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    loose = r.join(single, "nn").select("raw_id", "horse_id")
    return I.cascade(r.select("raw_id"), "raw_id", [("name+sire", strict), ("name", loose)], "horse_id")


_LOG = "m AS (SELECT loser node, min(keeper) parent FROM horse_merge_log WHERE NOT rolled_back AND loser IS NOT NULL AND keeper IS NOT NULL AND loser <> keeper GROUP BY loser)"


@query(f"""WITH RECURSIVE {_LOG}, c AS (SELECT node, parent, 1 n FROM m UNION ALL SELECT c.node, m.parent, n + 1 FROM c JOIN m ON m.node = c.parent WHERE n < 100)
SELECT node from_id, parent to_id, n steps FROM c WHERE parent NOT IN (SELECT node FROM m)""")
def redirect_closure(spark: SparkSession, d: str) -> DataFrame:
    """The last keeper of each merged id; chains that go round in a circle have none."""
    log = table(spark, d, "horse_merge_log").where("not rolled_back and loser is not null and keeper is not null and loser <> keeper")
    m = log.groupBy(F.col("loser").alias("node")).agg(F.min("keeper").alias("parent")).withColumn("tree", F.lit("merge")).select("tree", "node", "parent")
    return nested_sets(m).where("depth > 0").select(F.col("node").alias("from_id"), F.col("root").alias("to_id"), F.col("depth").alias("steps"))


@query(f"""WITH RECURSIVE {E}, {_LOG}, c AS (SELECT node, parent, 1 n FROM m UNION ALL SELECT c.node, m.parent, n + 1 FROM c JOIN m ON m.node = c.parent WHERE n < 100), k AS (SELECT node, parent FROM c WHERE parent NOT IN (SELECT node FROM m))
SELECT entry_id, coalesce(k.parent, horse_id) horse_id FROM e LEFT JOIN k ON k.node = e.horse_id""")
def fk_remap(spark: SparkSession, d: str) -> DataFrame:
    return I.remapped(fact(spark, d, "horse_id"), redirect_closure(spark, d), "horse_id", "from_id", "to_id").select("entry_id", "horse_id")


_RANK = "coalesce(nullif(list_position(['usta', 'st', 'letrot', 'hvt', 'atg', 'breedly', 'kmtid'], primary_source), 0), 8)"


@query(f"""WITH {_H}, k AS (SELECT *, year(date_of_birth) y, {_RANK} rk FROM h WHERE date_of_birth IS NOT NULL)
SELECT nn, y::INT birth_year, arg_min(gender_code, (rk, -horse_id)) FILTER (gender_code IS NOT NULL) gender_code, arg_min(birth_country, (rk, -horse_id)) FILTER (birth_country IS NOT NULL) birth_country, arg_min(registration_number, (rk, -horse_id)) FILTER (registration_number IS NOT NULL) registration_number FROM k GROUP BY ALL""")
def priority_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One row a fingerprint, each column from the first source that knows it."""
    k = _named(spark, d, "date_of_birth", "gender_code", "birth_country", "registration_number", "primary_source").where("date_of_birth is not null").withColumn("birth_year", F.year("date_of_birth"))
    return I.fill_by_priority(k, ["nn", "birth_year"], ["gender_code", "birth_country", "registration_number"], I.priority(F.col("primary_source"), "horse"), F.col("horse_id"))


@query("""WITH m AS (SELECT min(merge_id) merge_id, loser, keeper FROM horse_merge_log WHERE NOT rolled_back AND loser <> keeper GROUP BY ALL)
SELECT m.merge_id, m.keeper, m.loser, coalesce(k.name, l.name) name, coalesce(k.date_of_birth, l.date_of_birth) date_of_birth, coalesce(k.is_dead, false) OR coalesce(l.is_dead, false) is_dead, greatest(coalesce(k.scraped_starts, 0), coalesce(l.scraped_starts, 0)) scraped_starts,
k.gender_code IS NOT NULL AND l.gender_code IS NOT NULL AND k.gender_code <> l.gender_code disagrees FROM m JOIN horse k ON k.horse_id = m.keeper JOIN horse l ON l.horse_id = m.loser""")
def columnwise_merge(spark: SparkSession, d: str) -> DataFrame:
    """Keeper and loser of each merge joined column by column, with disagreements flagged."""
    m = table(spark, d, "horse_merge_log").where("not rolled_back and loser <> keeper").groupBy("loser", "keeper").agg(F.min("merge_id").alias("merge_id"))
    h = table(spark, d, "horse").select("horse_id", F.struct("name", "date_of_birth", "is_dead", "scraped_starts", "gender_code").alias("x"))
    j = m.join(h.select(F.col("horse_id").alias("keeper"), F.col("x").alias("k")), "keeper").join(h.select(F.col("horse_id").alias("loser"), F.col("x").alias("l")), "loser")
    either = lambda c: F.coalesce(f"k.{c}", f"l.{c}").alias(c)
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select(
        "merge_id", "keeper", "loser", either("name"), either("date_of_birth"), (no("k.is_dead") | no("l.is_dead")).alias("is_dead"), F.greatest(F.coalesce("k.scraped_starts", F.lit(0)), F.coalesce("l.scraped_starts", F.lit(0))).alias("scraped_starts"),
        no(F.col("k.gender_code") != F.col("l.gender_code")).alias("disagrees"),
    )


_SPLIT = "TIMESTAMP '2023-07-01'"


def _two_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each entry's latest delivery before a day, and its latest since then."""
    cols = ["driver_id", "placement", "odds", "prize_kr"]
    e = table(spark, d, "entry").where("entry_id is not null and last_updated_at is not null")
    one = lambda df: df.groupBy("entry_id").agg(F.max(F.struct("last_updated_at", *cols)).alias("x")).select("entry_id", *(F.col(f"x.{c}").alias(c) for c in cols))
    at = F.expr("timestamp_ntz'2023-07-01'")
    return one(e.where(F.col("last_updated_at") < at)), one(e.where(F.col("last_updated_at") >= at))


def _state_sql(cond: str) -> str:
    return f"SELECT entry_id, driver_id, placement, odds, prize_kr FROM entry WHERE entry_id IS NOT NULL AND last_updated_at {cond} {_SPLIT} QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY last_updated_at DESC) = 1"


_STATES = f"a AS ({_state_sql('<')}), b AS ({_state_sql('>=')})"


@query(f"WITH {_STATES} SELECT * FROM b UNION ALL SELECT * FROM a WHERE entry_id NOT IN (SELECT entry_id FROM b)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    return N.upsert(*_two_states(spark, d), ["entry_id"])


@query(f"WITH {_STATES} SELECT coalesce(b.entry_id, a.entry_id) entry_id, coalesce(b.driver_id, a.driver_id) driver_id, CASE WHEN b.entry_id IS NOT NULL THEN b.placement ELSE a.placement END placement, coalesce(b.odds, a.odds) odds, CASE WHEN b.entry_id IS NOT NULL THEN b.prize_kr ELSE a.prize_kr END prize_kr FROM a FULL JOIN b ON a.entry_id = b.entry_id")
def upsert_preserve(spark: SparkSession, d: str) -> DataFrame:
    return N.upsert_preserving(*_two_states(spark, d), ["entry_id"], ["driver_id", "odds"])


@query(f"WITH {_STATES} SELECT b.* FROM b JOIN a USING (entry_id) WHERE a.driver_id IS DISTINCT FROM b.driver_id OR a.placement IS DISTINCT FROM b.placement OR a.odds IS DISTINCT FROM b.odds OR a.prize_kr IS DISTINCT FROM b.prize_kr")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.changed(*_two_states(spark, d), ["entry_id"], ["driver_id", "placement", "odds", "prize_kr"])


@query(f"WITH {_STATES} SELECT b.* FROM b WHERE entry_id NOT IN (SELECT entry_id FROM a)")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    return N.insert_absent(*_two_states(spark, d), ["entry_id"])


@query("SELECT entry_id, last_updated_at FROM entry WHERE last_updated_at >= TIMESTAMP '2024-06-30 23:00:00'")
def watermark_delta(spark: SparkSession, d: str) -> DataFrame:
    return N.since(table(spark, d, "entry"), "last_updated_at", datetime(2024, 7, 1)).select("entry_id", "last_updated_at")


# Audits: rows that break a rule, by category.


@query(f"WITH {E} SELECT e.entry_id, e.horse_id, (e.race_date - h.date_of_birth)::INT age_days FROM e JOIN horse h USING (horse_id) WHERE e.race_date - h.date_of_birth > 6570")
def starts_after_18_years(spark: SparkSession, d: str) -> DataFrame:
    """Starts of horses older than 18 years."""
    j = fact(spark, d, "horse_id", "race_date").join(table(spark, d, "horse").select("horse_id", "date_of_birth"), "horse_id")
    age = F.datediff("race_date", "date_of_birth")
    return j.where(age > 6570).select("entry_id", "horse_id", age.alias("age_days"))


@query(f"WITH {_H} SELECT nn, count(*) n FROM h WHERE sire_id IS NOT NULL GROUP BY nn, sire_id HAVING count(*) > 1")
def namesakes_by_sire(spark: SparkSession, d: str) -> DataFrame:
    """Namesakes by the same sire."""
    return _named(spark, d, "sire_id").where("sire_id is not null").groupBy("nn", "sire_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("nn", "n")


@query("SELECT c.horse_id, p.horse_id parent_id FROM horse c JOIN horse p ON p.horse_id = c.sire_id OR p.horse_id = c.dam_id WHERE p.date_of_birth >= c.date_of_birth")
def parents_not_older(spark: SparkSession, d: str) -> DataFrame:
    """Parents not older than their foal."""
    h = table(spark, d, "horse").select("horse_id", "date_of_birth", "sire_id", "dam_id")
    kids = h.select("horse_id", F.col("date_of_birth").alias("born"), F.explode(F.array_distinct(F.array("sire_id", "dam_id"))).alias("parent_id"))
    return kids.join(h.select(F.col("horse_id").alias("parent_id"), "date_of_birth"), "parent_id").where("date_of_birth >= born").select("horse_id", "parent_id")


@query("SELECT 'registration' AS \"key\", count(*) n FROM (SELECT registration_number FROM horse WHERE registration_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'st_id', count(*) FROM (SELECT st_id FROM horse WHERE st_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def repeated_key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Keys that should be unique and aren't."""
    h = table(spark, d, "horse")
    one = lambda k, c: h.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.lit(k).alias("key"), F.count(F.lit(1)).alias("n"))
    return one("registration", "registration_number").unionByName(one("st_id", "st_id"))


@query(f"WITH {E} SELECT e.entry_id, abs(e.age - (year(e.race_date) - year(h.date_of_birth)))::INT off FROM e JOIN horse h USING (horse_id) WHERE abs(e.age - (year(e.race_date) - year(h.date_of_birth))) > 1 AND e.race_date > h.date_of_birth + INTERVAL 6 MONTHS")
def age_mismatch(spark: SparkSession, d: str) -> DataFrame:
    j = fact(spark, d, "horse_id", "race_date", "age").join(table(spark, d, "horse").select("horse_id", "date_of_birth"), "horse_id")
    off = F.abs(F.col("age") - (F.year("race_date") - F.year("date_of_birth"))).cast("int")
    return j.where((off > 1) & (F.col("race_date") > F.add_months("date_of_birth", 6))).select("entry_id", off.alias("off"))


@query("SELECT source, lower(name) nm, count(*) OVER (PARTITION BY source, lower(name)) n, min(raw_id) OVER (PARTITION BY source, lower(name)) keep, raw_id FROM horse_raw WHERE name IS NOT NULL AND source IS NOT NULL QUALIFY count(*) OVER (PARTITION BY source, lower(name)) > 1")
def fetched_twice(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicate_groups(table(spark, d, "horse_raw").withColumn("nm", F.lower("name")), ["source", "nm"], "raw_id")


@query("SELECT c.horse_id, min(p.horse_id) parent_id, 'sire' AS link FROM hc c JOIN hp p ON c.sn = p.nn AND p.gender_code = 'H' AND c.horse_id <> p.horse_id GROUP BY c.horse_id HAVING count(*) = 1".replace("hc c", f"(SELECT horse_id, {_norm_sql('sire_name')} sn FROM horse WHERE sire_id IS NULL AND sire_name IS NOT NULL) c").replace("hp p", f"(SELECT horse_id, gender_code, {_norm_sql('name')} nn FROM horse WHERE length({_norm_sql('name')}) > 2 AND {_norm_sql('name')} NOT IN ('N.N.', 'UNKNOWN', 'UNBEKANNT', 'INCONNU', 'OKAND')) p"))
def link_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Missing sires found by a name that only one stallion has."""
    c = table(spark, d, "horse").where("sire_id is null and sire_name is not null").select("horse_id", normalize_name(F.col("sire_name")).alias("nn"))
    p = _named(spark, d, "gender_code").where("gender_code = 'H'").select(F.col("horse_id").alias("parent_id"), "nn")
    j = c.join(p, "nn").where("horse_id <> parent_id").groupBy("horse_id").agg(F.min("parent_id").alias("parent_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return j.select("horse_id", "parent_id", F.lit("sire").alias("link"))


@query("SELECT a.race_id, b.race_id other_id FROM race a JOIN race b ON a.track_id = b.track_id AND a.race_date = b.race_date AND abs(a.distance - b.distance) <= 50 AND a.race_number < b.race_number")
def natural_key_near(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "race").select("race_id", "track_id", "race_date", "distance", "race_number")
    o = r.select(F.col("race_id").alias("other_id"), "track_id", "race_date", F.col("distance").alias("d2"), F.col("race_number").alias("n2"))
    return r.join(o, ["track_id", "race_date"]).where("abs(distance - d2) <= 50 and race_number < n2").select("race_id", "other_id")


