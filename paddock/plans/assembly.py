"""The whole table of trainers' form, rates by start method, and watermarks of incremental reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.operators import asof, incremental, ranking
from paddock.operators.asof import before, days_before, rate
from paddock.plans.base import ND, E, fact, query
from paddock.plans.features import HORSE, PRIOR, S, _prior, starts
from paddock.plans.planted import Planted
from paddock.plans.statistics import _OUTPERF, _PERF
from paddock.runtime import cut, table

_BY_DAY = "PARTITION BY trainer_id ORDER BY race_date"
_RANGE = lambda k: f"({_BY_DAY} RANGE BETWEEN INTERVAL {k} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"
_ROWS = lambda k: f"(PARTITION BY trainer_id ORDER BY race_date, entry_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
_DEC = lambda h, x: f"sum(pow(2, (race_date - DATE '2021-01-01') / {h}.0::DOUBLE) * {x}) OVER wall / sum(pow(2, (race_date - DATE '2021-01-01') / {h}.0::DOUBLE)) OVER wall"
_R6 = lambda x, a: f"round({x}, 6) {a}"
_OVER = lambda c, n, w: f"(sum({c}) OVER {w})::DOUBLE / nullif(sum({n}) OVER {w}, 0)"

_SQL = f"""WITH {E}, {_OUTPERF}, {_PERF},
b AS (SELECT entry_id, trainer_id, race_date, market_outperf pb, (frank < orank)::INT bt, (CASE WHEN placement = 1 AND {ND} THEN 1 ELSE 0 END) - share wr, coalesce(placement = 1 AND {ND}, false)::INT w, coalesce(placement BETWEEN 1 AND 3 AND {ND}, false)::INT t FROM mo WHERE trainer_id IS NOT NULL AND race_date IS NOT NULL),
y AS (SELECT trainer_id, race_date, count(*) n, sum(pb) pb, sum(bt) bt, sum(wr) wr, sum(t) t FROM b GROUP BY ALL),
w AS (SELECT trainer_id, race_date, {', '.join(f"{_R6(_OVER(c, 'n', f'w{k}'), f'{a}_{k}')}" for k in (90, 180) for c, a in (('pb', 'posbeat'), ('bt', 'beatrate'), ('wr', 'winresid')))}, {_R6(_OVER('t', 'n', 'c'), 'top3_career')}, coalesce(sum(n) OVER w180, 0)::BIGINT n_180
 FROM y WINDOW w90 AS {_RANGE(90)}, w180 AS {_RANGE(180)}, c AS ({_BY_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT entry_id, {', '.join(_R6(f'avg(pb) OVER l{k}', f'posbeat_last{k}') for k in (50, 100, 150, 200))}, {', '.join(_R6(_DEC(h, 'pb'), f'posbeat_decay{h}') for h in (120, 365))}, {_R6('sum(pb) OVER l100 / (count(*) OVER l100 + 30)', 'posbeat_last100_shrunk')},
 {', '.join(_R6(f'avg({c}) OVER l50', f'{a}_last50') for c, a in (('bt', 'beatrate'), ('wr', 'winresid'), ('t', 'top3'), ('w', 'win')))}, count(*) OVER l50 n_last50
 FROM b WINDOW {', '.join(f'l{k} AS {_ROWS(k)}' for k in (50, 100, 150, 200))}, wall AS {_ROWS('UNBOUNDED')}),
q AS (SELECT entry_id, trainer_id, race_date, perf, (placement = 1 AND {ND})::INT w, (placement BETWEEN 1 AND 3 AND {ND})::INT t FROM pf WHERE trainer_id IS NOT NULL AND race_date IS NOT NULL),
qy AS (SELECT trainer_id, race_date, count(*) n, sum(perf) p, sum(w) w, sum(t) t FROM q GROUP BY ALL),
qw AS (SELECT trainer_id, race_date, {', '.join(_R6(_OVER('p', 'n', f'w{k}'), f'perf_{k}') for k in (30, 90, 180))}, {', '.join(_R6(_OVER('w', 'n', f'w{k}'), f'winrate_{k}') for k in (30, 90))}, {_R6(_OVER('t', 'n', 'w90'), 'top3rate_90')}
 FROM qy WINDOW {', '.join(f'w{k} AS {_RANGE(k)}' for k in (30, 90, 180))}),
ql AS (SELECT entry_id, {', '.join(_R6(f'avg(perf) OVER l{k}', f'perf_last{k}') for k in (50, 100))}, {', '.join(_R6(_DEC(h, 'perf'), f'perf_decay{h}') for h in (120, 365))}, {_R6('avg(w) OVER l50', 'winrate_last50')}, count(*) OVER l50 perf_n_last50
 FROM q WINDOW {', '.join(f'l{k} AS {_ROWS(k)}' for k in (50, 100))}, wall AS {_ROWS('UNBOUNDED')})
SELECT b.entry_id, b.race_date, w.* EXCLUDE (trainer_id, race_date), l.* EXCLUDE (entry_id), qw.* EXCLUDE (trainer_id, race_date), ql.* EXCLUDE (entry_id, perf_n_last50), coalesce(ql.perf_n_last50, 0)::BIGINT perf_n_last50, b.bt y_beat_exp, round(b.pb, 6) y_outperf
FROM b JOIN w USING (trainer_id, race_date) LEFT JOIN l USING (entry_id) LEFT JOIN qw ON qw.trainer_id = b.trainer_id AND qw.race_date = b.race_date LEFT JOIN ql ON ql.entry_id = b.entry_id"""

_KEY = ["trainer_id"]


def _family(rows: DataFrame, value: str, others: list[str], last: dict[str, tuple[str, int]], value_name: str) -> DataFrame:
    """Measures over the last rows and decayed means of one family of form, by entry."""
    r6 = lambda c: F.round(c, 6)
    numbered = asof.numbered(rows.select("entry_id", *_KEY, "race_date", value, *others), _KEY, "race_date", "entry_id")
    measures = {name: (lambda w, c=c, k=k: r6(F.avg(c).over(w(k)))) for name, (c, k) in last.items()}
    count = "perf_n_last50" if value_name == "perf" else "n_last50"
    measures[count] = lambda w: F.count(F.lit(1)).over(w(50))
    if value_name == "posbeat":
        measures["posbeat_last100_shrunk"] = lambda w: r6(F.sum(value).over(w(100)) / (F.count(F.lit(1)).over(w(100)) + 30))
    out = asof.over_last(numbered, _KEY, 200, measures).select("entry_id", *measures)
    age = F.datediff("race_date", F.lit("2021-01-01").cast("date"))
    weight = {h: F.pow(F.lit(2.0), age / F.lit(float(h))) for h in (120, 365)}
    sums = {f"{p}{h}": c for h, w in weight.items() for p, c in (("s", w * F.col(value)), ("h", w))}
    decayed = asof.before_row(rows.select("entry_id", *_KEY, "race_date", value), _KEY, "race_date", "entry_id", sums)
    return out.join(decayed.select("entry_id", *(r6(rate(f"s{h}", f"h{h}")).alias(f"{value_name}_decay{h}") for h in weight)), "entry_id")


def _by_day(rows: DataFrame, sums: dict[str, Column], windows: dict[str, tuple[str, int]]) -> DataFrame:
    """Means over the days before each active day of each trainer; 0 days stands for all before."""
    y = asof.daily(rows, _KEY, "race_date", {"n": F.count(F.lit(1)), **sums}).withColumn("day", F.unix_date("race_date"))
    over = lambda k: days_before(_KEY, "day", k) if k else before(_KEY, ["race_date"])
    mean = lambda c, k: F.round(F.sum(c).over(over(k)).cast("double") / F.when(F.sum("n").over(over(k)) != 0, F.sum("n").over(over(k))), 6)
    return y.select(*_KEY, "race_date", *(mean(c, k).alias(name) for name, (c, k) in windows.items()), F.coalesce(F.sum("n").over(over(180)), F.lit(0)).alias("n_180"))


@query(_SQL)
def form_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Every form column of a trainer before each start: against the market and by results, with counts and outcomes."""
    e = cut(fact(spark, d, *dict.fromkeys([*ranking.MARKET, *ranking.FINISH, "disqualified", "trainer_id", "race_date"])).where("race_date is not null"), "form_fact").df
    good = lambda c: F.coalesce(c & ~F.coalesce("disqualified", F.lit(False)), F.lit(False)).cast("int")
    flags = {"w": good(F.col("placement") == 1), "t": good(F.col("placement").between(1, 3))}
    b = ranking.market_outperformance(e).where("trainer_id is not null").withColumns({"pb": F.col("market_outperf"), "bt": (F.col("fin_rank") < F.col("odds_rank")).cast("int"), **flags})
    b = cut(b.withColumn("wr", F.col("w") - F.col("share")).select("entry_id", "trainer_id", "race_date", "pb", "bt", "wr", "w", "t"), "market").df
    q = cut(ranking.finish_percentile(e).where("trainer_id is not null").withColumns(flags).select("entry_id", "trainer_id", "race_date", "perf", "w", "t"), "finish").df
    days = _by_day(b, {c: F.sum(c) for c in ("pb", "bt", "wr", "t")}, {**{f"{a}_{k}": (c, k) for k in (90, 180) for c, a in (("pb", "posbeat"), ("bt", "beatrate"), ("wr", "winresid"))}, "top3_career": ("t", 0)})
    last = _family(b, "pb", ["bt", "wr", "w", "t"], {**{f"posbeat_last{k}": ("pb", k) for k in (50, 100, 150, 200)}, "beatrate_last50": ("bt", 50), "winresid_last50": ("wr", 50), "top3_last50": ("t", 50), "win_last50": ("w", 50)}, "posbeat")
    p_days = _by_day(q, {"p": F.sum("perf"), "w": F.sum("w"), "t": F.sum("t")}, {**{f"perf_{k}": ("p", k) for k in (30, 90, 180)}, **{f"winrate_{k}": ("w", k) for k in (30, 90)}, "top3rate_90": ("t", 90)}).drop("n_180")
    p_last = _family(q, "perf", ["w"], {**{f"perf_last{k}": ("perf", k) for k in (50, 100)}, "winrate_last50": ("w", 50)}, "perf")
    out = b.join(days, [*_KEY, "race_date"]).join(last, "entry_id", "left").join(p_days, [*_KEY, "race_date"], "left").join(p_last, "entry_id", "left")
    keys = {*_KEY, "race_date", "entry_id", "perf_n_last50", "n"}
    named = [c for part in (days, last, p_days, p_last) for c in part.columns if c not in keys]
    return out.select("entry_id", "race_date", *named, F.coalesce("perf_n_last50", F.lit(0)).alias("perf_n_last50"), F.col("bt").alias("y_beat_exp"), F.round("pb", 6).alias("y_outperf"))


@query(f"""WITH {S}, h AS (SELECT entry_id, race_id, auto, {', '.join(f"count(CASE WHEN {c} THEN 1 END) OVER w {a}" for a, c in {'n': 'true', 'g': 'gal', 'na': 'auto', 'ga': 'auto AND gal', 'nv': 'NOT auto', 'gv': 'NOT auto AND gal'}.items())} FROM s WINDOW w AS ({HORSE} {PRIOR})),
r AS (SELECT entry_id, race_id, auto, g::DOUBLE / nullif(n, 0) r, ga::DOUBLE / nullif(na, 0) ra, gv::DOUBLE / nullif(nv, 0) rv FROM h),
k AS (SELECT entry_id, round(percent_rank() OVER (PARTITION BY race_id ORDER BY r), 6) p FROM r WHERE r IS NOT NULL AND race_id IS NOT NULL)
SELECT r.entry_id, round(r, 6) galrate, round(ra, 6) galrate_auto, round(rv, 6) galrate_volt, round(ra - rv, 6) auto_volt_delta, round(CASE WHEN auto THEN ra ELSE rv END, 6) galrate_method, p gal_rank_in_field FROM r LEFT JOIN k USING (entry_id)""")
def method_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of breaking gait before each start, by start method, and their rank in the field."""
    n = lambda c: F.count(F.when(c, 1)).over(_prior())
    share = lambda top, all_: n(top).cast("double") / F.when(n(all_) != 0, n(all_))
    gal, auto, any_ = F.col("gal"), F.col("auto"), F.lit(True)
    r = starts(spark, d, "gal", "auto", "race_id").withColumns({"r": share(gal, any_), "ra": share(auto & gal, auto), "rv": share(~auto & gal, ~auto)})
    ranks = Window.partitionBy("race_id", F.col("r").isNull()).orderBy("r")
    place = F.when(F.col("r").isNotNull() & F.col("race_id").isNotNull(), F.round(F.percent_rank().over(ranks), 6))
    r6 = lambda c: F.round(c, 6)
    return r.select("entry_id", r6("r").alias("galrate"), r6("ra").alias("galrate_auto"), r6("rv").alias("galrate_volt"), r6(F.col("ra") - F.col("rv")).alias("auto_volt_delta"), r6(F.when(auto, F.col("ra")).otherwise(F.col("rv"))).alias("galrate_method"), place.alias("gal_rank_in_field"))


STORE = Planted("wm", "name string, watermark timestamp_ntz", [("entry", __import__("datetime").datetime(2024, 7, 1)), ("horse", None)])


@query(f"WITH {STORE.sql}, d AS (SELECT 'entry' AS \"name\", last_updated_at u FROM entry UNION ALL SELECT 'horse', last_updated_at FROM horse) SELECT wm.\"name\", count(*) FILTER (wm.watermark IS NULL OR u >= wm.watermark - INTERVAL 1 HOUR) delta, greatest(max(u), any_value(wm.watermark)) watermark FROM wm LEFT JOIN d USING (\"name\") GROUP BY wm.\"name\"")
def watermark_advance(spark: SparkSession, d: str) -> DataFrame:
    """What each table has new since its stored watermark, and the watermark to store next."""
    return incremental.advanced(STORE.df(spark), {t: table(spark, d, t) for t in ("entry", "horse")}, "last_updated_at")


@query("SELECT h.horse_id, h.trainer_id, h.from_date, h.recorded_at FROM horse_trainer_history h WHERE h.horse_id IN (SELECT horse_id FROM horse WHERE last_updated_at >= TIMESTAMP '2024-06-30 23:00:00')")
def dependent_delta(spark: SparkSession, d: str) -> DataFrame:
    """History rows of the horses that changed since their watermark."""
    from datetime import datetime

    changed = incremental.since(table(spark, d, "horse"), "last_updated_at", datetime(2024, 7, 1))
    return incremental.of_changed(table(spark, d, "horse_trainer_history"), changed, "horse_id").select("horse_id", "trainer_id", "from_date", "recorded_at")
