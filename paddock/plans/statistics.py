"""Career, year, person, track and post statistics, leaderboards and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.operators import predicates as P
from paddock.operators import ranking
from paddock.operators.asof import rate
from paddock.plans.base import FLAGS, ND, PLACED, START, WIN, E, Q, fact, flagged, flagged_fact, n_if, query, total
from paddock.runtime import cut, table

WEEK30, LEAST_STARTS = 30, 7


def _counts() -> list[Column]:
    """Starts, wins, seconds, thirds, placed, qualifiers, prizes of a group."""
    nth = lambda k: P.count_if((F.col("placement_text") == k) & P.not_disqualified())
    return [
        P.count_if(F.col("is_start")).alias("starts"), nth("1").alias("wins"), nth("2").alias("seconds"), nth("3").alias("thirds"),
        P.count_if(F.col("placement_text").isin("1", "2", "3") & P.not_disqualified()).alias("placed"), P.count_if(F.col("is_qual")).alias("qualifiers"), total("prize_kr").alias("prize_money_kr"),
    ]


_NTH = lambda k: n_if(f"placement_text = '{k}' AND {ND}")
_COUNTS = f"""{n_if(START)} starts, {_NTH(1)} wins, {_NTH(2)} AS seconds, {_NTH(3)} AS thirds, {n_if(f"placement_text IN ('1', '2', '3') AND {ND}")} placed,
{n_if(Q)} qualifiers, coalesce(sum(prize_kr), 0)::BIGINT prize_money_kr"""


@query(f"""WITH {E}, c AS (SELECT horse_id, {_COUNTS}, min(race_date) first_start, max(race_date) last_start FROM e WHERE horse_id IS NOT NULL GROUP BY horse_id)
SELECT h.horse_id, greatest(coalesce(starts, 0), coalesce(scraped_starts, 0)) starts, greatest(coalesce(wins, 0), coalesce(scraped_wins, 0)) wins, coalesce(seconds, 0) AS seconds, coalesce(thirds, 0) AS thirds,
coalesce(placed, 0) placed, coalesce(qualifiers, 0) qualifiers, greatest(coalesce(prize_money_kr, 0), coalesce(scraped_prize_money_kr, 0)) prize_money_kr, first_start, last_start
FROM horse h LEFT JOIN c USING (horse_id) WHERE c.horse_id IS NOT NULL OR h.scraped_starts IS NOT NULL""")
def career_stats(spark: SparkSession, d: str) -> DataFrame:
    c = flagged_fact(spark, d, "horse_id", "prize_kr", "race_date").where("horse_id is not null").groupBy("horse_id").agg(*_counts(), F.min("race_date").alias("first_start"), F.max("race_date").alias("last_start"), F.lit(True).alias("ran"))
    h = table(spark, d, "horse").select("horse_id", "scraped_starts", "scraped_wins", "scraped_prize_money_kr")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    best = lambda a, b: F.greatest(zero(a), zero(b)).alias(a)
    met = h.join(c, "horse_id", "left").where("ran or scraped_starts is not null")
    return met.select("horse_id", best("starts", "scraped_starts"), best("wins", "scraped_wins"), *(zero(c).alias(c) for c in ("seconds", "thirds", "placed", "qualifiers")), best("prize_money_kr", "scraped_prize_money_kr"), "first_start", "last_start")


@query(f"WITH {E} SELECT horse_id, year(race_date)::INT AS \"year\", {_COUNTS} FROM e WHERE horse_id IS NOT NULL GROUP BY ALL")
def year_stats(spark: SparkSession, d: str) -> DataFrame:
    return flagged_fact(spark, d, "horse_id", "prize_kr", "race_date").where("horse_id is not null").groupBy("horse_id", F.year("race_date").alias("year")).agg(*_counts())


def _roles(e: DataFrame) -> DataFrame:
    """Each entry once for its driver and once for its trainer, in one scan."""
    each = F.explode(F.array(F.struct(F.lit("driver").alias("role"), F.col("driver_id").alias("person_id")), F.struct(F.lit("trainer").alias("role"), F.col("trainer_id").alias("person_id"))))
    return e.select("*", each.alias("r")).select("*", "r.*").where("person_id is not null")


_ROLES = "r AS (SELECT 'driver' AS \"role\", driver_id person_id, * FROM e WHERE driver_id IS NOT NULL UNION ALL SELECT 'trainer', trainer_id, * FROM e WHERE trainer_id IS NOT NULL)"


@query(f"WITH {E}, {_ROLES} SELECT \"role\", person_id, {_COUNTS} FROM r GROUP BY ALL")
def person_career_stats(spark: SparkSession, d: str) -> DataFrame:
    return _roles(flagged_fact(spark, d, "driver_id", "trainer_id", "prize_kr")).groupBy("role", "person_id").agg(*_counts())


@query(f"WITH {E}, {_ROLES} SELECT \"role\", person_id, {_COUNTS}, count(DISTINCT horse_id) horses, min(race_date) first_start, max(race_date) last_start FROM r GROUP BY ALL")
def person_stats(spark: SparkSession, d: str) -> DataFrame:
    return _roles(flagged_fact(spark, d, "driver_id", "trainer_id", "prize_kr", "horse_id", "race_date")).groupBy("role", "person_id").agg(*_counts(), F.countDistinct("horse_id").alias("horses"), F.min("race_date").alias("first_start"), F.max("race_date").alias("last_start"))


def _with_track(spark: SparkSession, d: str) -> DataFrame:
    return flagged_fact(spark, d, "race_id", "auto", "post", "odds", "race_date").join(table(spark, d, "race").select("race_id", "track_id", F.col("race_number")), "race_id")


_TRACK = f"{E}, t AS (SELECT e.*, race.track_id, race.race_number FROM e JOIN race USING (race_id))"


@query(f"""WITH {_TRACK} SELECT track_id, count(DISTINCT race_id) races, {n_if(START)} starts, {n_if(f'{START} AND auto')} auto_starts, {n_if(f'{START} AND auto = false')} volt_starts,
min(race_date) first_race, max(race_date) last_race FROM t WHERE track_id IS NOT NULL GROUP BY track_id""")
def track_stats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("is_start")
    return _with_track(spark, d).where("track_id is not null").groupBy("track_id").agg(
        F.countDistinct("race_id").alias("races"), P.count_if(s).alias("starts"), P.count_if(s & F.col("auto")).alias("auto_starts"), P.count_if(s & ~F.col("auto")).alias("volt_starts"),
        F.min("race_date").alias("first_race"), F.max("race_date").alias("last_race"),
    )


_POSTS = f"""{_TRACK}, p AS (SELECT track_id, auto, post, {n_if(START)} starts, {n_if(WIN)} wins, {n_if(PLACED)} placed,
coalesce(sum(CASE WHEN {WIN} AND odds > 1 THEN odds END), 0)::DOUBLE odds_sum, {n_if(f'{WIN} AND odds > 1')} odds_n FROM t WHERE track_id IS NOT NULL AND post BETWEEN 1 AND 15 GROUP BY ALL)"""


@query(f"WITH {_POSTS} SELECT * FROM p")
def track_post_stats(spark: SparkSession, d: str) -> DataFrame:
    paid = F.col("is_win") & (F.col("odds") > 1)
    return _with_track(spark, d).where("track_id is not null and post between 1 and 15").groupBy("track_id", "auto", "post").agg(
        P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"), P.count_if(F.col("is_placed")).alias("placed"),
        F.coalesce(F.sum(F.when(paid, F.col("odds"))), F.lit(0)).cast("double").alias("odds_sum"), P.count_if(paid).alias("odds_n"),
    )


@query(f"WITH {_POSTS} SELECT track_id, round(sum(odds_sum) / nullif(sum(odds_n), 0), 6) avg_winner_odds FROM p GROUP BY track_id")
def avg_winner_odds(spark: SparkSession, d: str) -> DataFrame:
    p = track_post_stats(spark, d).groupBy("track_id").agg(F.sum("odds_sum").alias("s"), F.sum("odds_n").alias("n"))
    return p.select("track_id", F.round(rate("s", "n"), 6).alias("avg_winner_odds"))


@query(f"""WITH {_POSTS}, b AS (SELECT track_id, post, sum(starts) starts, sum(wins) wins FROM p GROUP BY ALL HAVING sum(starts) >= 20)
SELECT post, count(*) tracks, round(avg(wins::DOUBLE / starts), 6) avg_rate, round(max(wins::DOUBLE / starts), 6) max_rate FROM b GROUP BY post""")
def post_average_max(spark: SparkSession, d: str) -> DataFrame:
    b = track_post_stats(spark, d).groupBy("track_id", "post").agg(F.sum("starts").alias("starts"), F.sum("wins").alias("wins")).where("starts >= 20").withColumn("r", rate("wins", "starts"))
    return b.groupBy("post").agg(F.count(F.lit(1)).alias("tracks"), F.round(F.avg("r"), 6).alias("avg_rate"), F.round(F.max("r"), 6).alias("max_rate"))


@query(f"""WITH {_POSTS}, b AS (SELECT track_id, post, sum(wins)::DOUBLE / sum(starts) r FROM p GROUP BY ALL HAVING sum(starts) >= 10),
k AS (SELECT *, rank() OVER (PARTITION BY post ORDER BY r) - 1 below, count(*) OVER (PARTITION BY post) n FROM b),
x AS (SELECT *, CASE WHEN n >= 5 THEN below::DOUBLE / (n - 1) END pct FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY r DESC, post) a, row_number() OVER (PARTITION BY track_id ORDER BY pct DESC NULLS LAST, post) z FROM x)
SELECT track_id, max(CASE WHEN a = 1 THEN post END) top_post, coalesce(max(CASE WHEN z = 1 AND pct IS NOT NULL THEN post END), max(CASE WHEN a = 1 THEN post END)) relative_post FROM o GROUP BY track_id""")
def top_post_relative(spark: SparkSession, d: str) -> DataFrame:
    b = track_post_stats(spark, d).groupBy("track_id", "post").agg(F.sum("starts").alias("s"), F.sum("wins").alias("w")).where("s >= 10").withColumn("r", rate("w", "s"))
    w, all_tracks = Window.partitionBy("post").orderBy("r"), Window.partitionBy("post")
    b = b.withColumns({"below": F.rank().over(w) - 1, "n": F.count(F.lit(1)).over(all_tracks)}).withColumn("pct", F.when(F.col("n") >= 5, F.col("below") / (F.col("n") - 1)))
    top = F.max_by("post", F.struct("r", -F.col("post")))
    relative = F.max_by(F.when(F.col("pct").isNotNull(), F.col("post")), F.when(F.col("pct").isNotNull(), F.struct("pct", -F.col("post"))))
    return b.groupBy("track_id").agg(top.alias("top_post"), F.coalesce(relative, top).alias("relative_post"))


@query(f"""WITH {E}, l AS (SELECT horse_id, arg_max(trainer_id, (race_date, entry_id)) last_trainer FROM e WHERE trainer_id IS NOT NULL AND horse_id IS NOT NULL GROUP BY horse_id),
s AS (SELECT horse_id, {n_if(START)} starts, {n_if(WIN)} wins FROM e WHERE horse_id IS NOT NULL GROUP BY horse_id),
k AS (SELECT sire_id parent, horse_id FROM horse WHERE sire_id IS NOT NULL UNION ALL SELECT dam_id, horse_id FROM horse WHERE dam_id IS NOT NULL),
o AS (SELECT parent horse_id, count(DISTINCT k.horse_id) foals, coalesce(sum(s.wins), 0)::BIGINT foal_wins FROM k LEFT JOIN s USING (horse_id) GROUP BY parent)
SELECT h.horse_id, h.name, coalesce(s.starts, 0) starts, coalesce(s.wins, 0) wins, l.last_trainer, coalesce(o.foals, 0) foals, coalesce(o.foal_wins, 0)::BIGINT foal_wins, f.name sire, m.name dam, g.name dam_sire
FROM horse h LEFT JOIN s USING (horse_id) LEFT JOIN l USING (horse_id) LEFT JOIN o USING (horse_id) LEFT JOIN horse f ON f.horse_id = h.sire_id LEFT JOIN horse m ON m.horse_id = h.dam_id LEFT JOIN horse g ON g.horse_id = m.sire_id""")
def horse_stats_wide(spark: SparkSession, d: str) -> DataFrame:
    e = flagged_fact(spark, d, "horse_id", "trainer_id", "race_date").where("horse_id is not null")
    s = e.groupBy("horse_id").agg(P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"), F.max(F.when(F.col("trainer_id").isNotNull(), F.struct("race_date", "entry_id", "trainer_id"))).alias("l"))
    s = s.select("horse_id", "starts", "wins", F.col("l.trainer_id").alias("last_trainer"))
    h = table(spark, d, "horse").select("horse_id", "name", "sire_id", "dam_id")
    edges = h.select("horse_id", F.explode(F.array("sire_id", "dam_id")).alias("parent")).where("parent is not null")
    o = edges.join(s.select("horse_id", F.col("wins").alias("w")), "horse_id", "left").groupBy(F.col("parent").alias("horse_id")).agg(F.countDistinct("horse_id").alias("foals"), total("w").alias("foal_wins"))
    named = lambda k, n: h.select(F.col("horse_id").alias(k), F.col("name").alias(n))
    dams = h.select(F.col("horse_id").alias("dam_id"), F.col("name").alias("dam"), F.col("sire_id").alias("dam_sire_id")).join(named("dam_sire_id", "dam_sire"), "dam_sire_id", "left").drop("dam_sire_id")
    out = h.join(s, "horse_id", "left").join(o, "horse_id", "left").join(named("sire_id", "sire"), "sire_id", "left").join(dams, "dam_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("horse_id", "name", zero("starts"), zero("wins"), "last_trainer", zero("foals"), zero("foal_wins"), "sire", "dam", "dam_sire")


@query(f"WITH {E}, {_ROLES}, s AS (SELECT \"role\", person_id, {n_if(START)} starts, {n_if(WIN)} wins, coalesce(sum(prize_kr), 0)::BIGINT prize_kr FROM r GROUP BY ALL HAVING {n_if(START)} >= 10) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY \"role\" ORDER BY wins DESC, prize_kr DESC, person_id) <= 25")
def top_people(spark: SparkSession, d: str) -> DataFrame:
    s = _roles(flagged_fact(spark, d, "driver_id", "trainer_id", "prize_kr")).groupBy("role", "person_id").agg(P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"), total("prize_kr").alias("prize_kr")).where("starts >= 10")
    w = Window.partitionBy("role").orderBy(F.desc("wins"), F.desc("prize_kr"), "person_id")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 25").drop("rn")


@query(f"""WITH {E}, s AS (SELECT horse_id, {n_if(START)} starts, {n_if(WIN)} wins, coalesce(sum(prize_kr), 0)::BIGINT prize FROM e GROUP BY horse_id),
o AS (SELECT h.sire_id, count(DISTINCT h.horse_id) foals, sum(starts)::BIGINT starts, sum(wins)::BIGINT wins, sum(prize)::BIGINT prize_kr FROM horse h JOIN s USING (horse_id) WHERE h.sire_id IS NOT NULL GROUP BY ALL HAVING sum(starts) >= 5)
SELECT *, round(prize_kr::DOUBLE / foals, 2) prize_per_foal FROM o ORDER BY prize_kr DESC, sire_id LIMIT 50""")
def top_offspring(spark: SparkSession, d: str) -> DataFrame:
    s = flagged_fact(spark, d, "horse_id", "prize_kr").groupBy("horse_id").agg(P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"), total("prize_kr").alias("prize"))
    o = table(spark, d, "horse").select("horse_id", "sire_id").where("sire_id is not null").join(s, "horse_id").groupBy("sire_id").agg(F.countDistinct("horse_id").alias("foals"), total("starts").alias("starts"), total("wins").alias("wins"), total("prize").alias("prize_kr"))
    return o.where("starts >= 5").withColumn("prize_per_foal", F.round(F.col("prize_kr").cast("double") / F.col("foals"), 2)).orderBy(F.desc("prize_kr"), "sire_id").limit(50)


_OUTPERF = f"""k AS (SELECT *, count(*) OVER (PARTITION BY race_id) n, row_number() OVER (PARTITION BY race_id ORDER BY odds, program_number NULLS LAST, entry_id) orank,
row_number() OVER (PARTITION BY race_id ORDER BY finish_order, program_number NULLS LAST, entry_id) frank, (1 / odds::DOUBLE) / sum(1 / odds::DOUBLE) OVER (PARTITION BY race_id) AS share
FROM e WHERE odds > 1 AND finish_order IS NOT NULL AND NOT coalesce(withdrawn, false) AND NOT {Q} AND race_id IS NOT NULL),
mo AS (SELECT *, (orank - frank)::DOUBLE / (n - 1) market_outperf FROM k WHERE n >= 4)"""
_PERF = f"""kp AS (SELECT *, count(*) OVER (PARTITION BY race_id) n, row_number() OVER (PARTITION BY race_id ORDER BY placement, program_number NULLS LAST, entry_id) rk
FROM e WHERE placement > 0 AND NOT coalesce(withdrawn, false) AND NOT {Q} AND race_id IS NOT NULL), pf AS (SELECT *, (n - rk)::DOUBLE / (n - 1) perf FROM kp WHERE n >= 4)"""


@query(f"WITH {E}, {_OUTPERF} SELECT entry_id, race_date, market_outperf FROM mo")
def market_outperf(spark: SparkSession, d: str) -> DataFrame:
    return ranking.market_outperformance(fact(spark, d, *ranking.MARKET, "race_date")).select("entry_id", "race_date", "market_outperf")


@query(f"WITH {E}, {_PERF} SELECT entry_id, race_date, perf FROM pf")
def finish_percentile(spark: SparkSession, d: str) -> DataFrame:
    return ranking.finish_percentile(fact(spark, d, *ranking.FINISH, "race_date")).select("entry_id", "race_date", "perf")


@query(f"""WITH {E}, {_OUTPERF} SELECT entry_id, round(share, 6) implied, round((CASE WHEN placement = 1 AND {ND} THEN 1 ELSE 0 END) - share, 6) win_resid, (frank < orank)::INT beat FROM mo""")
def implied_prob_residual(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.market_outperformance(fact(spark, d, *ranking.MARKET, "placement", "disqualified"))
    win = F.when(P.won(), 1).otherwise(0)
    return r.select("entry_id", F.round("share", 6).alias("implied"), F.round(win - F.col("share"), 6).alias("win_resid"), (F.col("fin_rank") < F.col("odds_rank")).cast("int").alias("beat"))


def _leaders(spark: SparkSession, d: str) -> DataFrame:
    """Drivers' last 365 days beside their career."""
    known = cut(fact(spark, d, *dict.fromkeys([*ranking.MARKET, *ranking.FINISH, *FLAGS, "driver_id", "race_date"])), "standing", last=F.max("race_date"))
    last = known.seen["last"]
    r = ranking.both_measures(flagged(known.df)).where("driver_id is not null")
    recent = F.col("race_date") >= F.date_sub(F.lit(last).cast("date"), 365)
    at = lambda c: F.when(recent, c)
    s = r.groupBy("driver_id").agg(
        P.count_if(recent & F.col("is_start")).alias("starts"), P.count_if(recent & F.col("is_win")).alias("wins"), F.count(at(F.col("market_outperf"))).alias("n_of"), F.sum(at(F.col("market_outperf"))).alias("sum_of"),
        F.count(at(F.col("perf"))).alias("n_pf"), F.sum(at(F.col("perf"))).alias("sum_pf"), P.count_if(F.col("is_start")).alias("career_starts"), P.count_if(F.col("is_win")).alias("career_wins"),
    )
    return s.where("starts >= 10").select("driver_id", "starts", "wins", "career_starts", "career_wins", F.round(rate("sum_of", "n_of"), 6).alias("outperf"), F.round(rate("sum_pf", "n_pf"), 6).alias("form"), F.round(rate("wins", "starts") - rate("career_wins", "career_starts"), 6).alias("delta"))


_LEADERS = f"""WITH {E}, {_OUTPERF}, {_PERF}, j AS (SELECT e.*, mo.market_outperf, pf.perf, e.race_date >= (SELECT max(race_date) FROM e) - 365 recent FROM e LEFT JOIN mo USING (entry_id) LEFT JOIN pf USING (entry_id) WHERE e.driver_id IS NOT NULL),
s AS (SELECT driver_id, {n_if(f'recent AND {START}')} starts, {n_if(f'recent AND {WIN}')} wins, {n_if(START)} career_starts, {n_if(WIN)} career_wins,
round(avg(CASE WHEN recent THEN market_outperf END), 6) outperf, round(avg(CASE WHEN recent THEN perf END), 6) form FROM j GROUP BY driver_id),
b AS (SELECT *, round(wins::DOUBLE / starts - career_wins::DOUBLE / nullif(career_starts, 0), 6) delta FROM s WHERE starts >= 10) SELECT * FROM b """


@query(_LEADERS + "ORDER BY form DESC NULLS LAST, delta DESC NULLS LAST, driver_id LIMIT 10")
def form_leaders_hot(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d).orderBy(F.col("form").desc_nulls_last(), F.col("delta").desc_nulls_last(), "driver_id").limit(10)


@query(_LEADERS + "WHERE career_wins >= 0.05 * career_starts ORDER BY form ASC NULLS LAST, delta ASC NULLS LAST, driver_id LIMIT 10")
def form_leaders_cold(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d).where("career_wins >= 0.05 * career_starts").orderBy(F.col("form").asc_nulls_last(), F.col("delta").asc_nulls_last(), "driver_id").limit(10)


@query(f"WITH {E}, s AS (SELECT trainer_id, horse_id, {n_if(START)} starts, {n_if(WIN)} wins, coalesce(sum(prize_kr), 0)::BIGINT prize_kr FROM e WHERE trainer_id IS NOT NULL AND horse_id IS NOT NULL GROUP BY ALL HAVING {n_if(START)} >= 2) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY trainer_id ORDER BY prize_kr DESC, horse_id) <= 5")
def trainer_top_horses(spark: SparkSession, d: str) -> DataFrame:
    s = flagged_fact(spark, d, "trainer_id", "horse_id", "prize_kr").where("trainer_id is not null and horse_id is not null").groupBy("trainer_id", "horse_id").agg(P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"), total("prize_kr").alias("prize_kr")).where("starts >= 2")
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("trainer_id").orderBy(F.desc("prize_kr"), "horse_id"))).where("rn <= 5").drop("rn")


@query(f"""WITH {E}, m AS (SELECT driver_id, date_trunc('month', race_date)::DATE AS "month", {n_if(START)} starts, {n_if(WIN)} wins FROM e WHERE driver_id IS NOT NULL GROUP BY ALL)
SELECT driver_id, "month", starts, wins, round(sum(wins) OVER c * 1000.0::DOUBLE / nullif(sum(starts) OVER c, 0), 6) career_rate, round(sum(wins) OVER q * 1000.0::DOUBLE / nullif(sum(starts) OVER q, 0), 6) quarter_rate
FROM m WINDOW c AS (PARTITION BY driver_id ORDER BY "month"), q AS (PARTITION BY driver_id ORDER BY "month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def monthly_form_series(spark: SparkSession, d: str) -> DataFrame:
    m = flagged_fact(spark, d, "driver_id", "race_date").where("driver_id is not null").groupBy("driver_id", F.trunc("race_date", "month").alias("month")).agg(P.count_if(F.col("is_start")).alias("starts"), P.count_if(F.col("is_win")).alias("wins"))
    w = Window.partitionBy("driver_id").orderBy("month")
    over = lambda f: F.round(F.sum("wins").over(f) * F.lit(1000.0) / F.when(F.sum("starts").over(f) != 0, F.sum("starts").over(f)), 6)
    return m.select("driver_id", "month", "starts", "wins", over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("career_rate"), over(w.rowsBetween(-2, 0)).alias("quarter_rate"))


@query(f"""WITH {E}, s AS (SELECT horse_id, race_date, {n_if(START)} starts, {n_if(WIN)} wins, {n_if(f'{START} AND NOT galopp')} clean FROM e WHERE horse_id IS NOT NULL GROUP BY ALL)
SELECT entry_id, coalesce(sum(s.starts), 0)::BIGINT starts, coalesce(sum(s.wins), 0)::BIGINT wins, coalesce(sum(s.clean), 0)::BIGINT clean_starts
FROM e LEFT JOIN s ON s.horse_id = e.horse_id AND s.race_date < e.race_date GROUP BY entry_id""")
def pre_race_snapshot(spark: SparkSession, d: str) -> DataFrame:
    from paddock.operators.asof import cumulative

    e = flagged_fact(spark, d, "horse_id", "race_date", "galopp")
    s = cumulative(e, ["horse_id"], "race_date", {"starts": P.count_if(F.col("is_start")), "wins": P.count_if(F.col("is_win")), "clean_starts": P.count_if(F.col("is_start") & ~F.col("galopp"))})
    return e.select("entry_id", "horse_id", "race_date").join(s, ["horse_id", "race_date"], "left").select("entry_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("starts", "wins", "clean_starts")))


@query(f"WITH {E} SELECT primary_source, count(*) n, count(DISTINCT horse_id) horses, max(race_date) newest FROM e GROUP BY primary_source")
def source_freshness(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d, "primary_source", "horse_id", "race_date").groupBy("primary_source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("horse_id").alias("horses"), F.max("race_date").alias("newest"))


@query(f"WITH {E}, c AS (SELECT race_id, distance, count(*) n FROM e WHERE race_id IS NOT NULL AND distance IS NOT NULL GROUP BY ALL) SELECT race_id, distance modal_distance FROM c QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY n DESC, distance) = 1")
def mode_vote(spark: SparkSession, d: str) -> DataFrame:
    c = fact(spark, d, "race_id", "distance").dropna().groupBy("race_id", "distance").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("race_id").agg(F.max_by("distance", F.struct("n", -F.col("distance"))).alias("modal_distance"))


@query("SELECT event_type, median(value) median_value, count(value) n FROM events GROUP BY event_type")
def median_latency(spark: SparkSession, d: str) -> DataFrame:
    m = ranking.exact_median(table(spark, d, "events").select("event_type", "value"), "event_type", "value")
    return m.select("event_type", F.col("median").alias("median_value"), "n")
