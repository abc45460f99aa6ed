"""Point-in-time features: what was known of horse, people and field before each start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from paddock.operators import asof, intervals, ranking
from paddock.operators import predicates as P
from paddock.operators.asof import before, days_before, rate
from paddock.plans.base import ND, START, E, fact, query
from paddock.plans.statistics import _OUTPERF, _PERF, _TRACK
from paddock.runtime import cut, table

ORDER = ["race_date", "entry_id"]
HORSE, DAY = "PARTITION BY horse_id ORDER BY race_date, entry_id", "ORDER BY race_date"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _prior() -> WindowSpec:
    """A horse's earlier starts."""
    return before(["horse_id"], ORDER)


#: Flags of a start and the columns each is made of.
MADE_OF = {"won": ["placement", "disqualified"], "gal": ["galopp"], "dq": ["disqualified"], "band": ["distance"], "expw": ["odds"], "barefoot": ["shoe_code"], "day": []}


def starts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Counting starts, race and horse known, with ``columns``, which may be flags of ``MADE_OF``; only what they need is read."""
    needed = [x for c in columns for x in MADE_OF.get(c, [c])]
    e = fact(spark, d, *dict.fromkeys(["withdrawn", "placement_text", "horse_id", "race_date", *needed])).where(P.started() & F.col("horse_id").isNotNull() & F.col("race_date").isNotNull())
    make = {
        "won": lambda: F.coalesce(P.won(), F.lit(False)), "gal": lambda: F.coalesce("galopp", F.lit(False)), "dq": lambda: F.coalesce("disqualified", F.lit(False)), "band": P.distance_band, "expw": P.expected_win,
        "barefoot": lambda: F.coalesce(F.col("shoe_code") == "1", F.lit(False)), "day": lambda: F.unix_date("race_date"),
    }
    return e.withColumns({c: make[c]() for c in columns if c in make}) if any(c in make for c in columns) else e


S = f"""{E}, s AS (SELECT *, coalesce(placement = 1 AND {ND}, false) won, coalesce(galopp, false) gal, coalesce(disqualified, false) dq,
CASE WHEN distance IS NULL THEN NULL WHEN distance <= 1700 THEN 's' WHEN distance <= 2250 THEN 'm' ELSE 'l' END band, CASE WHEN odds > 1 THEN least(0.7::DOUBLE, 1 / odds::DOUBLE) ELSE 0 END expw,
coalesce(shoe_code = '1', false) barefoot FROM e WHERE {START} AND horse_id IS NOT NULL AND race_date IS NOT NULL)"""
COUNTS = {"starts": "true", "wins": "won", "gals": "gal", "clean_starts": "NOT gal", "clean_wins": "NOT gal AND won", "nondq_starts": "NOT dq", "auto_starts": "auto", "auto_gals": "auto AND gal", "volt_starts": "NOT auto", "volt_gals": "NOT auto AND gal", "barefoot_starts": "barefoot", "barefoot_gals": "barefoot AND gal"}


@query(f"WITH {S} SELECT entry_id, {', '.join(f'count(CASE WHEN {c} THEN 1 END) OVER h {k}' for k, c in COUNTS.items())} FROM s WINDOW h AS ({HORSE} {PRIOR})")
def horse_asof_counts(spark: SparkSession, d: str) -> DataFrame:
    return starts(spark, d, "won", "gal", "dq", "auto", "barefoot").select("entry_id", *(F.count(F.when(F.expr(c), 1)).over(_prior()).alias(k) for k, c in COUNTS.items()))


@query(f"WITH {S} SELECT entry_id, lag(gal) OVER h gal_pre, (race_date - lag(race_date) OVER h)::INT days_since, (race_date - lag(race_date) OVER h) > 60 season_debut FROM s WINDOW h AS ({HORSE})")
def lag_gap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("horse_id").orderBy(*ORDER)
    gap = F.datediff("race_date", F.lag("race_date").over(w))
    return starts(spark, d, "gal").select("entry_id", F.lag("gal").over(w).alias("gal_pre"), gap.alias("days_since"), (gap > 60).alias("season_debut"))


@query(f"WITH {S} SELECT entry_id, {', '.join(f'''min(CASE WHEN band = '{b}' AND time_seconds > 0 THEN time_seconds END) OVER h record_{b}''' for b in 'sml')} FROM s WINDOW h AS ({HORSE} {PRIOR})")
def best_by_band_asof(spark: SparkSession, d: str) -> DataFrame:
    return starts(spark, d, "band", "time_seconds").select("entry_id", *(F.min(F.when((F.col("band") == b) & (F.col("time_seconds") > 0), F.col("time_seconds"))).over(_prior()).alias(f"record_{b}") for b in "sml"))


@query(f"""WITH {S} SELECT entry_id, CASE WHEN auto IS NULL THEN NULL WHEN auto THEN count(CASE WHEN auto THEN 1 END) OVER h = 0 ELSE count(CASE WHEN NOT auto THEN 1 END) OVER h = 0 END first_method,
CASE band {' '.join(f"WHEN '{b}' THEN count(CASE WHEN band = '{b}' THEN 1 END) OVER h = 0" for b in 'sml')} END first_band, barefoot AND count(CASE WHEN barefoot THEN 1 END) OVER h = 0 first_barefoot FROM s WINDOW h AS ({HORSE} {PRIOR})""")
def first_time_flags(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.count(F.when(c, 1)).over(_prior()) == 0
    auto, band = F.col("auto"), F.col("band")
    by_band = F.coalesce(*(F.when(band == b, none(band == b)) for b in "sml"))
    return starts(spark, d, "auto", "band", "barefoot").select("entry_id", F.when(auto, none(auto)).when(~auto, none(~auto)).alias("first_method"), by_band.alias("first_band"), (F.col("barefoot") & none(F.col("barefoot"))).alias("first_barefoot"))


@query(f"WITH {S} SELECT entry_id, CASE WHEN trainer_id IS NULL THEN 0 ELSE count(*) OVER t END with_trainer, CASE WHEN driver_id IS NULL THEN 0 ELSE count(*) OVER r END with_driver FROM s WINDOW t AS (PARTITION BY horse_id, trainer_id ORDER BY race_date, entry_id {PRIOR}), r AS (PARTITION BY horse_id, driver_id ORDER BY race_date, entry_id {PRIOR})")
def pair_prior_counts(spark: SparkSession, d: str) -> DataFrame:
    prior = lambda who: F.when(F.col(who).isNull(), F.lit(0)).otherwise(F.count(F.lit(1)).over(before(["horse_id", who], ORDER)))
    return starts(spark, d, "trainer_id", "driver_id").select("entry_id", prior("trainer_id").alias("with_trainer"), prior("driver_id").alias("with_driver"))


def _person() -> dict[str, Column]:
    return {"starts": F.count(F.lit(1)), "wins": F.count(F.when(F.col("won"), 1)), "gals": F.count(F.when(F.col("gal"), 1)), "odds_n": F.count(F.when(F.col("odds") > 1, 1)), "odds_wins": F.count(F.when((F.col("odds") > 1) & F.col("won"), 1)), "exp_wins": F.sum("expw")}
_DAILY = "dd AS (SELECT driver_id, race_date, count(*) starts, count(CASE WHEN won THEN 1 END) wins, count(CASE WHEN gal THEN 1 END) gals, count(CASE WHEN odds > 1 THEN 1 END) odds_n, count(CASE WHEN odds > 1 AND won THEN 1 END) odds_wins, sum(expw) exp_wins FROM s WHERE driver_id IS NOT NULL GROUP BY ALL)"


@query(f"WITH {S}, {_DAILY} SELECT driver_id, race_date, (sum(starts) OVER w)::BIGINT starts, (sum(wins) OVER w)::BIGINT wins, (sum(gals) OVER w)::BIGINT gals FROM dd WINDOW w AS (PARTITION BY driver_id {DAY} {PRIOR})")
def person_asof_career(spark: SparkSession, d: str) -> DataFrame:
    return asof.cumulative(starts(spark, d, "driver_id", "won", "gal"), ["driver_id"], "race_date", {k: _person()[k] for k in ("starts", "wins", "gals")})


@query(f"WITH {S}, {_DAILY} SELECT driver_id, race_date, (sum(starts) OVER w)::BIGINT starts, (sum(wins) OVER w)::BIGINT wins, (sum(odds_n) OVER w)::BIGINT odds_n, round((sum(odds_wins) OVER w - sum(exp_wins) OVER w) / nullif(sum(odds_n) OVER w, 0), 6) odds_form FROM dd WINDOW w AS (PARTITION BY driver_id {DAY} RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)")
def person_asof_30d(spark: SparkSession, d: str) -> DataFrame:
    t = asof.trailing_days(starts(spark, d, "driver_id", "won", "odds", "expw"), ["driver_id"], "race_date", {k: _person()[k] for k in ("starts", "wins", "odds_n", "odds_wins", "exp_wins")}, 30)
    return t.withColumn("gain", F.col("odds_wins") - F.col("exp_wins")).select("driver_id", "race_date", "starts", "wins", "odds_n", F.round(rate("gain", "odds_n"), 6).alias("odds_form"))


def _keyed(spark: SparkSession, d: str, keys: list[str], extra: DataFrame | None = None, on: str = "race_id") -> DataFrame:
    s = starts(spark, d, "race_id", "trainer_id", "post", "auto", "gal")
    s = s.join(extra, on) if extra is not None else s
    r = asof.asof_rate(s, keys, "race_date", F.col("gal"), F.lit(True))
    return r.select(*keys, "race_date", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.round("rate", 6).alias("gal_rate"))


def _keyed_sql(keys: str, source: str = "s") -> str:
    notnull = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""WITH {S}, y AS (SELECT {keys}, race_date, count(*) n, count(CASE WHEN gal THEN 1 END) g FROM {source} WHERE {notnull} GROUP BY ALL)
SELECT {keys}, race_date, coalesce(sum(n) OVER w, 0)::BIGINT n, round((sum(g) OVER w)::DOUBLE / nullif(sum(n) OVER w, 0), 6) gal_rate FROM y WINDOW w AS (PARTITION BY {keys} {DAY} {PRIOR})"""


def _races(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "race").select("race_id", "track_id")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse").select("horse_id", "sire_id", "dam_id")


_RACED, _BRED = "(SELECT s.*, track_id FROM s JOIN race USING (race_id))", "(SELECT s.*, sire_id, dam_id FROM s JOIN horse USING (horse_id))"


@query(_keyed_sql("trainer_id, track_id", _RACED))
def pair_track_asof(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, ["trainer_id", "track_id"], _races(spark, d))


@query(_keyed_sql("sire_id", _BRED))
def asof_rate_sire(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, ["sire_id"], _parents(spark, d), "horse_id")


@query(_keyed_sql("dam_id", _BRED))
def asof_rate_dam(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, ["dam_id"], _parents(spark, d), "horse_id")


@query(_keyed_sql("post, auto"))
def asof_rate_post(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, ["post", "auto"])


@query(_keyed_sql("track_id, post, auto", _RACED))
def asof_rate_track_post(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, ["track_id", "post", "auto"], _races(spark, d))


@query(_keyed_sql("horse_id, track_id", _RACED))
def asof_rate_horse_track(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, ["horse_id", "track_id"], _races(spark, d))


@query(f"WITH {E} SELECT entry_id, rank() OVER (PARTITION BY race_id ORDER BY earnings_pre DESC NULLS LAST) earnings_rank, round(percent_rank() OVER (PARTITION BY race_id ORDER BY earnings_pre ASC NULLS LAST), 6) earnings_pct FROM e WHERE race_id IS NOT NULL")
def rank_pct_in_race(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("race_id")
    return fact(spark, d, "race_id", "earnings_pre").where("race_id is not null").select("entry_id", F.rank().over(w.orderBy(F.col("earnings_pre").desc_nulls_last())).cast("bigint").alias("earnings_rank"), F.round(F.percent_rank().over(w.orderBy(F.col("earnings_pre").asc_nulls_last())), 6).alias("earnings_pct"))


@query(f"WITH {E} SELECT entry_id, round((time_seconds - avg(time_seconds) OVER r) / nullif(stddev_samp(time_seconds) OVER r, 0), 4) time_z FROM e WHERE time_seconds BETWEEN 60 AND 100 AND race_id IS NOT NULL WINDOW r AS (PARTITION BY race_id)")
def zscore_in_race(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("race_id")
    sd = F.stddev_samp("time_seconds").over(w)
    return fact(spark, d, "race_id", "time_seconds").where("time_seconds between 60 and 100 and race_id is not null").select("entry_id", F.round((F.col("time_seconds") - F.avg("time_seconds").over(w)) / F.when(sd != 0, sd), 4).alias("time_z"))


@query(f"WITH {S} SELECT entry_id, coalesce(sum(gal::INT) OVER (PARTITION BY horse_id ORDER BY race_date, entry_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT gals_last5 FROM s")
def last5_sum(spark: SparkSession, d: str) -> DataFrame:
    return starts(spark, d, "gal").select("entry_id", F.coalesce(F.sum(F.col("gal").cast("int")).over(before(["horse_id"], ORDER, 5)), F.lit(0)).alias("gals_last5"))


@query(f"""WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY race_date, entry_id) rn2 FROM s)
SELECT entry_id, greatest(rn2 - 1 - coalesce(max(CASE WHEN NOT gal THEN rn2 END) OVER h, 0), 0)::INT on_streak, greatest(rn2 - 1 - coalesce(max(CASE WHEN gal THEN rn2 END) OVER h, 0), 0)::INT off_streak FROM n WINDOW h AS ({HORSE} {PRIOR})""")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return asof.streaks(starts(spark, d, "gal"), ["horse_id"], ORDER, F.col("gal")).select("entry_id", "on_streak", "off_streak")


@query(f"""WITH {S} SELECT entry_id, CASE WHEN lag(auto) OVER h IS NULL THEN NULL ELSE auto IS DISTINCT FROM lag(auto) OVER h END method_switch,
CASE WHEN lag(auto) OVER h IS NULL THEN NULL ELSE shoe_code IS DISTINCT FROM lag(shoe_code) OVER h END shoe_switch, CASE WHEN lag(auto) OVER h IS NULL THEN NULL ELSE driver_id IS DISTINCT FROM lag(driver_id) OVER h END driver_switch,
distance - lag(distance) OVER h distance_delta FROM s WINDOW h AS ({HORSE})""")
def switch_flags(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("horse_id").orderBy(*ORDER)
    known = F.lag("auto").over(w).isNotNull()
    switched = lambda c: F.when(known, ~F.col(c).eqNullSafe(F.lag(c).over(w)))
    return starts(spark, d, "auto", "shoe_code", "driver_id", "distance").select("entry_id", switched("auto").alias("method_switch"), switched("shoe_code").alias("shoe_switch"), switched("driver_id").alias("driver_switch"), (F.col("distance") - F.lag("distance").over(w)).alias("distance_delta"))


@query(f"WITH {S} SELECT entry_id, round(avg(placement) OVER (PARTITION BY horse_id ORDER BY race_date, entry_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) avg_place10 FROM s")
def avg_last10(spark: SparkSession, d: str) -> DataFrame:
    return starts(spark, d, "placement").select("entry_id", F.round(F.avg("placement").over(before(["horse_id"], ORDER, 10)), 6).alias("avg_place10"))


@query(f"WITH {S} SELECT entry_id, count(*) OVER (PARTITION BY horse_id {DAY} RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) starts_90d FROM s")
def starts_90d(spark: SparkSession, d: str) -> DataFrame:
    return starts(spark, d, "day").select("entry_id", F.count(F.lit(1)).over(days_before(["horse_id"], "day", 90)).alias("starts_90d"))


def _form_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.market_outperformance(fact(spark, d, *ranking.MARKET, "trainer_id", "race_date")).where("trainer_id is not null").withColumns({"beat": (F.col("fin_rank") < F.col("odds_rank")).cast("int"), "day": F.unix_date("race_date")})


@query(f"""WITH {E}, {_OUTPERF}, y AS (SELECT trainer_id, race_date, count(*) n, sum(market_outperf::DECIMAL(18, 6)) pb, sum((frank < orank)::INT) bt FROM mo WHERE trainer_id IS NOT NULL GROUP BY ALL)
SELECT trainer_id, race_date, {', '.join(f"coalesce(sum(n) OVER w{k}, 0)::BIGINT n_{k}, (sum(pb) OVER w{k})::DOUBLE / nullif(sum(n) OVER w{k}, 0) posbeat_{k}, (sum(bt) OVER w{k})::DOUBLE / nullif(sum(n) OVER w{k}, 0) beatrate_{k}" for k in (90, 180))}
FROM y WINDOW {', '.join(f"w{k} AS (PARTITION BY trainer_id {DAY} RANGE BETWEEN INTERVAL {k} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)" for k in (90, 180))}""")
def form_90_180(spark: SparkSession, d: str) -> DataFrame:
    y = asof.daily(_form_rows(spark, d), ["trainer_id"], "race_date", {"n": F.count(F.lit(1)), "pb": F.sum(F.col("market_outperf").cast("decimal(18,6)")), "bt": F.sum("beat")}).withColumn("day", F.unix_date("race_date"))
    out = []
    for k in (90, 180):
        w = days_before(["trainer_id"], "day", k)
        n = F.sum("n").over(w)
        out += [F.coalesce(n, F.lit(0)).alias(f"n_{k}"), (F.sum("pb").over(w).cast("double") / F.when(n != 0, n)).alias(f"posbeat_{k}"), (F.sum("bt").over(w).cast("double") / F.when(n != 0, n)).alias(f"beatrate_{k}")]
    return y.select("trainer_id", "race_date", *out)


@query(f"""WITH {E}, {_OUTPERF} SELECT entry_id, {', '.join(f"count(*) OVER w{k} n_{k}, round(avg(market_outperf) OVER w{k}, 6) posbeat_last{k}" for k in (50, 100, 200))} FROM mo WHERE trainer_id IS NOT NULL
WINDOW {', '.join(f"w{k} AS (PARTITION BY trainer_id ORDER BY race_date, entry_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (50, 100, 200))}""")
def form_last_n(spark: SparkSession, d: str) -> DataFrame:
    rows = asof.numbered(_form_rows(spark, d).select("entry_id", "trainer_id", "race_date", "market_outperf"), ["trainer_id"], "race_date", "entry_id")
    measures = {}
    for k in (50, 100, 200):
        measures[f"n_{k}"] = lambda last, k=k: F.count(F.lit(1)).over(last(k))
        measures[f"posbeat_last{k}"] = lambda last, k=k: F.round(F.avg("market_outperf").over(last(k)), 6)
    return asof.over_last(rows, ["trainer_id"], 200, measures).select("entry_id", *measures)


@query(f"""WITH {E}, {_OUTPERF} SELECT entry_id, {', '.join(f"round(sum(pow(2, (race_date - DATE '2021-01-01') / {h}.0::DOUBLE) * market_outperf) OVER w / sum(pow(2, (race_date - DATE '2021-01-01') / {h}.0::DOUBLE)) OVER w, 6) decay{h}" for h in (120, 365))}
FROM mo WHERE trainer_id IS NOT NULL WINDOW w AS (PARTITION BY trainer_id ORDER BY race_date, entry_id {PRIOR})""")
def form_decay(spark: SparkSession, d: str) -> DataFrame:
    age, x = F.datediff("race_date", F.lit("2021-01-01").cast("date")), F.col("market_outperf")
    weight = {h: F.pow(F.lit(2.0), age / F.lit(float(h))) for h in (120, 365)}
    sums = {f"{p}{h}": c for h, w in weight.items() for p, c in (("sum", w * x), ("held", w))}
    rows = asof.before_row(_form_rows(spark, d).select("entry_id", "trainer_id", "race_date", "market_outperf"), ["trainer_id"], "race_date", "entry_id", sums)
    return rows.select("entry_id", *(F.round(rate(f"sum{h}", f"held{h}"), 6).alias(f"decay{h}") for h in weight))


@query(f"WITH {E}, {_OUTPERF} SELECT entry_id, round(sum(market_outperf) OVER w / (count(*) OVER w + 30), 6) shrunk FROM mo WHERE trainer_id IS NOT NULL WINDOW w AS (PARTITION BY trainer_id ORDER BY race_date, entry_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)")
def form_shrunk(spark: SparkSession, d: str) -> DataFrame:
    rows = asof.numbered(_form_rows(spark, d).select("entry_id", "trainer_id", "race_date", "market_outperf"), ["trainer_id"], "race_date", "entry_id")
    shrunk = lambda last: F.round(F.sum("market_outperf").over(last(100)) / (F.count(F.lit(1)).over(last(100)) + 30), 6)
    return asof.over_last(rows, ["trainer_id"], 100, {"shrunk": shrunk}).select("entry_id", "shrunk")


@query(f"""WITH {E}, {_PERF}, y AS (SELECT trainer_id, race_date, count(*) n, sum(perf::DECIMAL(18, 6)) pp, count(CASE WHEN placement = 1 THEN 1 END) w FROM pf WHERE trainer_id IS NOT NULL GROUP BY ALL)
SELECT trainer_id, race_date, {', '.join(f"(sum(pp) OVER w{k})::DOUBLE / nullif(sum(n) OVER w{k}, 0) perf_{k}, (sum(w) OVER w{k})::DOUBLE / nullif(sum(n) OVER w{k}, 0) winrate_{k}" for k in (30, 90))}
FROM y WINDOW {', '.join(f"w{k} AS (PARTITION BY trainer_id {DAY} RANGE BETWEEN INTERVAL {k} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)" for k in (30, 90))}""")
def perf_30_90(spark: SparkSession, d: str) -> DataFrame:
    y = asof.daily(ranking.finish_percentile(fact(spark, d, *ranking.FINISH, "trainer_id", "race_date")), ["trainer_id"], "race_date", {"n": F.count(F.lit(1)), "pp": F.sum(F.col("perf").cast("decimal(18,6)")), "w": F.count(F.when(F.col("placement") == 1, 1))}).withColumn("day", F.unix_date("race_date"))
    out = []
    for k in (30, 90):
        w = days_before(["trainer_id"], "day", k)
        n = F.sum("n").over(w)
        out += [(F.sum(c).over(w).cast("double") / F.when(n != 0, n)).alias(f"{a}_{k}") for c, a in (("pp", "perf"), ("w", "winrate"))]
    return y.select("trainer_id", "race_date", *out)


@query(f"WITH {E} SELECT horse_id, arg_max(trainer_id, (race_date, entry_id)) trainer_id, max(race_date) race_date FROM e WHERE horse_id IS NOT NULL AND trainer_id IS NOT NULL GROUP BY horse_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d, "horse_id", "trainer_id", "race_date").where("horse_id is not null and trainer_id is not null").groupBy("horse_id").agg(F.max_by("trainer_id", F.struct("race_date", "entry_id")).alias("trainer_id"), F.max("race_date").alias("race_date"))


def ranks_continued(results: DataFrame) -> DataFrame:
    """Places after the last one for timed starters that have none, by time."""
    e = results.where("race_id is not null")
    e = e.withColumn("top", F.coalesce(F.max("placement").over(Window.partitionBy("race_id")), F.lit(0)))
    todo = e.where("placement is null and time_seconds between 60 and 100 and not withdrawn")
    return todo.select("entry_id", (F.col("top") + F.row_number().over(Window.partitionBy("race_id").orderBy("time_seconds", "entry_id"))).cast("int").alias("placement"))


_DAYS = "g AS (SELECT ccy, unnest(generate_series(min(rate_date), max(rate_date), INTERVAL 1 DAY))::DATE rate_date FROM fx_rate GROUP BY ccy)"


@query(f"WITH {_DAYS} SELECT g.ccy, g.rate_date, last_value(f.sek_per_unit IGNORE NULLS) OVER (PARTITION BY g.ccy ORDER BY g.rate_date) sek_per_unit FROM g LEFT JOIN fx_rate f USING (ccy, rate_date)")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return asof.forward_filled(table(spark, d, "fx_rate"), "ccy", "rate_date", "sek_per_unit")


@query(f"""WITH {E}, k AS (SELECT DISTINCT prize_currency ccy, race_date FROM e WHERE prize_currency <> 'SEK' AND race_date IS NOT NULL)
SELECT k.ccy, k.race_date, f.rate_date, f.sek_per_unit FROM k ASOF JOIN fx_rate f ON k.ccy = f.ccy AND k.race_date >= f.rate_date WHERE k.race_date - f.rate_date <= 7""")
def fx_asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    asked = fact(spark, d, "prize_currency", "race_date").where("prize_currency <> 'SEK'").select(F.col("prize_currency").alias("ccy"), F.unix_date("race_date").alias("day")).dropna().distinct()
    rates = table(spark, d, "fx_rate").select("ccy", "rate_date", "sek_per_unit", F.unix_date("rate_date").alias("start"))
    nxt = F.lead("start").over(Window.partitionBy("ccy").orderBy("start"))
    rates = rates.withColumn("stop", F.least(F.coalesce(nxt, F.col("start") + 8), F.col("start") + 8)).withColumns({"known": F.col("start"), "replaced": F.col("stop")})
    got = intervals.as_known(asked, rates, ["ccy"], "day", "start", "stop", "known", "replaced", ["start"], ["rate_date", "sek_per_unit"])
    return got.select("ccy", F.date_from_unix_date("day").alias("race_date"), "rate_date", "sek_per_unit")


@query(f"WITH {S}, a AS (SELECT entry_id, race_id, (count(CASE WHEN gal THEN 1 END) OVER h)::DOUBLE / nullif(count(*) OVER h, 0) r FROM s WINDOW h AS ({HORSE} {PRIOR})) SELECT entry_id, round((sum(r) OVER f - coalesce(r, 0)) / nullif(count(r) OVER f - (r IS NOT NULL)::INT, 0), 6) field_rate FROM a WINDOW f AS (PARTITION BY race_id)")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).over(_prior())
    a = starts(spark, d, "race_id", "gal").select("entry_id", "race_id", (F.count(F.when(F.col("gal"), 1)).over(_prior()).cast("double") / F.when(n != 0, n)).alias("r"))
    w = Window.partitionBy("race_id")
    others = F.count("r").over(w) - F.col("r").isNotNull().cast("int")
    return a.select("entry_id", F.round((F.sum("r").over(w) - F.coalesce("r", F.lit(0.0))) / F.when(others != 0, others), 6).alias("field_rate"))


@query(f"""WITH {S}, {_DAILY}, pk AS (SELECT DISTINCT driver_id, race_date + 3 as_of FROM s WHERE driver_id IS NOT NULL AND race_date IS NOT NULL)
SELECT pk.driver_id, pk.as_of, coalesce(sum(dd.starts), 0)::BIGINT starts, coalesce(sum(dd.wins), 0)::BIGINT wins FROM pk LEFT JOIN dd ON dd.driver_id = pk.driver_id AND dd.race_date >= pk.as_of - 30 AND dd.race_date < pk.as_of GROUP BY ALL""")
def asof_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """A driver's starts and wins over the 30 days before a day, for every driver and race day (three days on)."""
    s = starts(spark, d, "driver_id", "won")
    return _asof_pairs(s, s.where("race_date is not null"))


def _asof_pairs(s: DataFrame, asked: DataFrame) -> DataFrame:
    from paddock.operators.rolling import trailing

    pk = asked.where("driver_id is not null").select("driver_id", F.date_add("race_date", 3).alias("race_date")).distinct()
    y = asof.daily(s, ["driver_id"], "race_date", {"starts": F.count(F.lit(1)), "wins": F.count(F.when(F.col("won"), 1))})
    t = trailing(pk, y, "driver_id", "race_date", ["starts", "wins"], [30])
    return t.select("driver_id", F.col("race_date").alias("as_of"), F.coalesce("starts_30", F.lit(0)).alias("starts"), F.coalesce("wins_30", F.lit(0)).alias("wins"))


_FT = ["horse_starts", "horse_winrate", "horse_galrate", "days_since", "gals_last5", "starts_90d", "driver_starts", "driver_winrate_30d", "trainer_starts", "earnings_rank", "n_starters", "race_complete", "is_springspar", "is_bakspar", "first_trainer", "y_win", "y_top3"]


def _people(s: DataFrame, who: str, p: str) -> DataFrame:
    y = asof.daily(s, [who], "race_date", {"n": F.count(F.lit(1)), "w": F.count(F.when(F.col("won"), 1))}).withColumn("_d", F.unix_date("race_date"))
    month = days_before([who], "_d", 30)
    return y.select(who, "race_date", F.sum("n").over(before([who], ["race_date"])).alias(f"{p}_starts"), (F.sum("w").over(month).cast("double") / F.when(F.sum("n").over(month) != 0, F.sum("n").over(month))).alias(f"{p}_winrate_30d"))


@query(f"""WITH {S}, {_DAILY}, dr AS (SELECT driver_id, race_date, sum(starts) OVER c starts, round((sum(wins) OVER m)::DOUBLE / nullif(sum(starts) OVER m, 0), 6) rate30 FROM dd WINDOW c AS (PARTITION BY driver_id {DAY} {PRIOR}), m AS (PARTITION BY driver_id {DAY} RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)),
ty AS (SELECT trainer_id, race_date, count(*) c FROM s WHERE trainer_id IS NOT NULL GROUP BY trainer_id, race_date), tr AS (SELECT trainer_id, race_date, sum(c) OVER (PARTITION BY trainer_id {DAY} {PRIOR}) starts FROM ty),
q AS (SELECT race_id, count(*) n_starters, max(program_number) max_pgm FROM s WHERE race_id IS NOT NULL GROUP BY race_id)
SELECT s.entry_id, count(*) OVER h horse_starts, round((count(CASE WHEN won THEN 1 END) OVER h)::DOUBLE / nullif(count(*) OVER h, 0), 6) horse_winrate, round((count(CASE WHEN gal THEN 1 END) OVER h)::DOUBLE / nullif(count(*) OVER h, 0), 6) horse_galrate,
(s.race_date - lag(s.race_date) OVER (PARTITION BY s.horse_id ORDER BY s.race_date, s.entry_id))::INT days_since, coalesce(sum(gal::INT) OVER (PARTITION BY s.horse_id ORDER BY s.race_date, s.entry_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT gals_last5,
count(*) OVER (PARTITION BY s.horse_id ORDER BY s.race_date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) starts_90d, coalesce(dr.starts, 0)::BIGINT driver_starts, dr.rate30 driver_winrate_30d, coalesce(tr.starts, 0)::BIGINT trainer_starts,
CASE WHEN s.race_id IS NOT NULL THEN rank() OVER (PARTITION BY s.race_id ORDER BY earnings_pre DESC NULLS LAST) END earnings_rank, q.n_starters, q.n_starters >= 3 AND (q.max_pgm IS NULL OR q.max_pgm <= q.n_starters) race_complete,
auto = false AND post IN (6, 7) is_springspar, auto AND post >= 9 is_bakspar, CASE WHEN s.trainer_id IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY s.horse_id, s.trainer_id ORDER BY s.race_date, s.entry_id {PRIOR}) = 0 END first_trainer,
placement = 1 AND NOT dq y_win, placement BETWEEN 1 AND 3 AND NOT dq y_top3
FROM s LEFT JOIN dr ON dr.driver_id = s.driver_id AND dr.race_date = s.race_date LEFT JOIN tr ON tr.trainer_id = s.trainer_id AND tr.race_date = s.race_date LEFT JOIN q ON q.race_id = s.race_id WINDOW h AS (PARTITION BY s.horse_id ORDER BY s.race_date, s.entry_id {PRIOR})""")
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    plain = cut(starts(spark, d, "won", "gal", "dq", "day", "trainer_id", "driver_id", "race_id", "earnings_pre", "program_number", "auto", "post", "placement"), "starts").df
    s = plain
    last = Window.partitionBy("horse_id").orderBy(*ORDER)
    n = F.count(F.lit(1)).over(_prior())
    share = lambda c: F.round(F.count(F.when(F.col(c), 1)).over(_prior()).cast("double") / F.when(n != 0, n), 6)
    s = s.withColumns({
        "horse_starts": n, "horse_winrate": share("won"), "horse_galrate": share("gal"), "days_since": F.datediff("race_date", F.lag("race_date").over(last)),
        "gals_last5": F.coalesce(F.sum(F.col("gal").cast("int")).over(before(["horse_id"], ORDER, 5)), F.lit(0)), "starts_90d": F.count(F.lit(1)).over(days_before(["horse_id"], "day", 90)),
        "first_trainer": F.when(F.col("trainer_id").isNotNull(), F.count(F.lit(1)).over(before(["horse_id", "trainer_id"], ORDER)) == 0),
        "earnings_rank": F.when(F.col("race_id").isNotNull(), F.rank().over(Window.partitionBy("race_id").orderBy(F.col("earnings_pre").desc_nulls_last())).cast("bigint")),
        "n_starters": F.when(F.col("race_id").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("race_id"))), "max_pgm": F.when(F.col("race_id").isNotNull(), F.max("program_number").over(Window.partitionBy("race_id"))),
    })
    out = s.join(_people(plain, "driver_id", "driver"), ["driver_id", "race_date"], "left").join(_people(plain, "trainer_id", "trainer").drop("trainer_winrate_30d"), ["trainer_id", "race_date"], "left")
    return out.withColumns({
        "driver_starts": F.coalesce("driver_starts", F.lit(0)), "trainer_starts": F.coalesce("trainer_starts", F.lit(0)), "driver_winrate_30d": F.round("driver_winrate_30d", 6),
        "race_complete": (F.col("n_starters") >= 3) & (F.col("max_pgm").isNull() | (F.col("max_pgm") <= F.col("n_starters"))), "is_springspar": (F.col("auto") == F.lit(False)) & F.col("post").isin(6, 7), "is_bakspar": F.col("auto") & (F.col("post") >= 9),
        "y_win": (F.col("placement") == 1) & ~F.col("dq"), "y_top3": F.col("placement").between(1, 3) & ~F.col("dq"),
    }).select("entry_id", *_FT)
