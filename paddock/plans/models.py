"""Model queries: calibration, rank measures, a fitted model over the features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import learning as L
from paddock.operators import ranking
from paddock.plans.base import ND, E, fact, query
from paddock.plans.features import feature_table
from paddock.plans.statistics import _OUTPERF
from paddock.runtime import cut, table

_SCORED = f"{E}, {_OUTPERF}, sc AS (SELECT entry_id, share score, coalesce(placement = 1 AND {ND}, false) won FROM mo)"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.market_outperformance(fact(spark, d, *ranking.MARKET, "placement", "disqualified"))
    return cut(r.select("entry_id", F.round("share", 9).alias("score"), F.coalesce((F.col("placement") == 1) & ~F.coalesce("disqualified", F.lit(False)), F.lit(False)).alias("won")), "scores").df


@query(f"WITH {_SCORED}, r AS (SELECT won, score, row_number() OVER (ORDER BY round(score, 9), entry_id) rk, count(*) OVER () n FROM sc) SELECT (floor((rk - 1) * 10 / n) + 1)::INT bin, count(*) n, round(avg(round(score, 9)), 6) mean_score, round(avg(won::INT), 6) hit_rate FROM r GROUP BY ALL")
def calibration_deciles(spark: SparkSession, d: str) -> DataFrame:
    return L.calibration(_shares(spark, d), "score", "won", "entry_id")


@query(f"WITH {_SCORED}, r AS (SELECT won, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0::DOUBLE rk FROM sc), s AS (SELECT sum(CASE WHEN won THEN rk END) s, count(CASE WHEN won THEN 1 END) pos, count(CASE WHEN NOT won THEN 1 END) neg FROM r) SELECT pos, neg, round((s - pos * (pos + 1) / 2) / (pos * neg), 6) auc FROM s")
def auc_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return L.auc(_shares(spark, d), "score", "won", "entry_id")


@query(f"""WITH {E}, x AS (SELECT entry_id, odds::DOUBLE odds, placement FROM e WHERE odds > 1 AND placement > 0),
r AS (SELECT rank() OVER (ORDER BY odds) + (count(*) OVER (PARTITION BY odds) - 1) / 2.0::DOUBLE a, rank() OVER (ORDER BY placement) + (count(*) OVER (PARTITION BY placement) - 1) / 2.0::DOUBLE b FROM x) SELECT count(*) n, round(corr(a, b), 6) rho FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the ranks of odds and placement; ranks come from counts by value."""
    from pyspark.sql import Window

    x = fact(spark, d, "odds", "placement").where("odds > 1 and placement > 0")

    def mid(c: str) -> DataFrame:
        n = x.groupBy(c).agg(F.count(F.lit(1)).alias("n"))  # one row a distinct value
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return n.select(c, (F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2).alias(f"r_{c}"))

    pairs = x.groupBy("odds", "placement").agg(F.count(F.lit(1)).alias("k")).join(mid("odds"), "odds").join(mid("placement"), "placement")
    a, b, k = F.col("r_odds"), F.col("r_placement"), F.col("k")
    s = pairs.agg(F.sum(k).alias("n"), F.sum(k * a).alias("a"), F.sum(k * b).alias("b"), F.sum(k * a * a).alias("aa"), F.sum(k * b * b).alias("bb"), F.sum(k * a * b).alias("ab"))
    n = F.col("n")
    rho = (n * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt((n * F.col("aa") - F.col("a") * F.col("a")) * (n * F.col("bb") - F.col("b") * F.col("b")))
    return s.select("n", F.round(rho, 6).alias("rho"))


FEATURES = ["horse_starts", "horse_winrate", "horse_galrate", "days_since", "gals_last5", "starts_90d", "driver_starts", "driver_winrate_30d", "trainer_starts", "earnings_rank", "n_starters"]


@query()
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Win probabilities of the starts of 2024 by trees fitted on the years before."""
    f = feature_table(spark, d).join(table(spark, d, "entry_features").select("entry_id", "race_date"), "entry_id")
    f = cut(f.select("entry_id", "race_date", "y_win", *FEATURES), "features").df
    train, test = L.time_split(f, "race_date", "2024-01-01")
    return L.scored(L.fitted(train, FEATURES, "y_win"), test, FEATURES).select("entry_id", "y_win", F.round("p", 6).alias("p"))
