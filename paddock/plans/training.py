"""Queries of the core training-data operators over the racing tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.operators import hierarchy, intervals, rolling, units
from paddock.operators.standing import standing
from paddock.runtime import cut, table

LINEAGES = {"sire": "sire_id", "dam": "dam_id"}
PERIODS = [7, 30, 90]


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.valid_links(table(spark, sf_dir, "horse").select("horse_id", "sire_id", "dam_id"), "horse_id", LINEAGES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founders and steps of both lines, and the horses recorded as their own ancestors."""
    links = cut(_links(spark, sf_dir), "pedigree").df
    lines = hierarchy.nested_sets(links).where("depth > 0")
    loops = hierarchy.cyclic_groups(links)
    return lines.select(F.col("tree").alias("lineage"), F.col("node").alias("horse_id"), F.col("root").alias("root_id"), F.col("depth").alias("n_steps")).unionByName(
        loops.select(F.lit("loop").alias("lineage"), F.col("node").alias("horse_id"), F.col("root").alias("root_id"), F.col("members").alias("n_steps"))
    )


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, founder, steps and nested-set range of each horse in its sire and its dam line."""
    forest = hierarchy.nested_sets(_links(spark, sf_dir), with_path=True)
    return forest.select(
        F.col("tree").alias("lineage"), F.col("node").alias("horse_id"), F.col("root").alias("root_id"), F.col("depth").alias("n_steps"),
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), (F.col("size") - 1).alias("n_descendants"),
    )


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descendant of every horse along each line, with the steps between them."""
    pairs = hierarchy.descendants(hierarchy.nested_sets(_links(spark, sf_dir)))
    return pairs.select(F.col("tree").alias("lineage"), F.col("ancestor").alias("horse_id"), F.col("node").alias("descendant_id"), F.col("steps").alias("n_steps"))


def p1_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descendant of every horse over any mix of both links, on and below cycles too."""
    return hierarchy.all_descendants(_links(spark, sf_dir)).select(F.col("ancestor").alias("horse_id"), F.col("node").alias("descendant_id"))


def _trainer_of(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """The trainer each horse was known to have on each day asked for."""
    day = lambda c: F.unix_date(F.to_date(c))
    said = table(spark, sf_dir, "horse_trainer_history").where("horse_id is not null and from_date is not null and recorded_at is not null")
    tie = F.struct("trainer_id", "to_date", "trainer_name", "source")
    rows = said.select("horse_id", "from_date", "recorded_at", "trainer_id", "to_date", tie.alias("tie"))
    # the last record of an instant stands for it; the next instant ends what it said
    rows = rows.groupBy("horse_id", "from_date", "recorded_at").agg(F.max_by(F.struct("trainer_id", "to_date"), "tie").alias("r"))
    by_start = Window.partitionBy("horse_id", "from_date").orderBy("recorded_at")
    versions = rows.select(
        "horse_id", F.col("r.trainer_id").alias("trainer_id"), "recorded_at", day("from_date").alias("start"), day("r.to_date").alias("stop"),
        (day("recorded_at") + 1).alias("known"), (day(F.lead("recorded_at").over(by_start)) + 1).alias("replaced"),
    ).where("trainer_id is not null")
    return intervals.as_known(events, versions, ["horse_id"], "day", "start", "stop", "known", "replaced", ["start", "recorded_at"], ["trainer_id"])


def _form_of(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """The last form row of each trainer before each day asked for."""
    form = table(spark, sf_dir, "trainer_form_exp").select("entry_id", F.unix_date("race_date").alias("d"))
    rows = form.join(standing(table(spark, sf_dir, "entry"), "trainer_id"), "entry_id").where("trainer_id is not null and d is not null")
    daily = rows.groupBy("trainer_id", "d").agg(F.max("entry_id").alias("ref_id"))
    versions = daily.select("trainer_id", "d", "ref_id", (F.col("d") + 1).alias("start"), (F.lead("d").over(Window.partitionBy("trainer_id").orderBy("d")) + 1).alias("stop"))
    versions = versions.withColumns({"known": F.col("start"), "replaced": F.col("stop")})
    return intervals.as_known(events, versions, ["trainer_id"], "day", "start", "stop", "known", "replaced", ["d"], ["ref_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trainer known on the race day and that trainer's last form row before it."""
    events = table(spark, sf_dir, "entry_features").select("entry_id", "horse_id", F.unix_date("race_date").alias("day"))
    trainers = cut(_trainer_of(spark, sf_dir, events), "trainers").df
    known = trainers.join(_form_of(spark, sf_dir, trainers), ["trainer_id", "day"], "left")
    found = events.join(known, ["horse_id", "day"])
    pair = lambda name, c: F.struct(F.lit(name).alias("attr_name"), F.col(c).cast("long").alias("ref_id"))
    return found.select("entry_id", F.explode(F.array(pair("trainer", "trainer_id"), pair("form", "ref_id"))).alias("x")).select("entry_id", "x.*").where("ref_id is not null")


def _form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form rows with their trainer, one an entry_id."""
    form = table(spark, sf_dir, "trainer_form_exp").select("entry_id", "race_date", "tf_posbeat_90", "tf_beatrate_90", "y_beat_exp", "y_outperf")
    one = form.where("entry_id is not null").groupBy("entry_id").agg(F.max(F.struct(*form.columns[1:])).alias("r")).select("entry_id", "r.*")
    return one.join(standing(table(spark, sf_dir, "entry"), "trainer_id"), "entry_id")


def _daily(rows: DataFrame) -> DataFrame:
    """Totals a trainer and day: rows, and sum and number of each result."""
    plain = lambda c: F.when(~F.isnan(c), F.col(c))
    return rows.where("trainer_id is not null").groupBy("trainer_id", "race_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_beat_exp").alias("beat"), F.count("y_beat_exp").alias("beat_n"),
        F.sum(plain("y_outperf").cast("decimal(18,6)")).alias("outperf"), F.count(plain("y_outperf")).alias("outperf_n"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form rows whose 90-day figures aren't those of the trainer's preceding 90 days."""
    rows = cut(_form_rows(spark, sf_dir), "form").df
    days = rows.select("trainer_id", "race_date").dropna().distinct()
    totals = rolling.trailing(days, _daily(rows), "trainer_id", "race_date", ["beat", "beat_n", "outperf", "outperf_n"], [90])
    mean = lambda c: F.col(f"{c}_90") / F.when(F.col(f"{c}_n_90") > 0, F.col(f"{c}_n_90"))
    totals = totals.select("trainer_id", "race_date", mean("outperf").cast("double").alias("posbeat"), mean("beat").alias("beatrate"))
    said = lambda c: F.when(~F.isnan(c), F.col(c))
    off = lambda a, b: F.coalesce(F.abs(a - b) > 0.001, a.isNull() != b.isNull())
    met = rows.join(totals, ["trainer_id", "race_date"], "left")
    return met.where(off(said("tf_posbeat_90"), F.col("posbeat")) | off(said("tf_beatrate_90"), F.col("beatrate"))).select("entry_id")


def p7_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of each trainer over 7, 30 and 90 days before every calendar day."""
    daily = cut(_daily(_form_rows(spark, sf_dir)), "daily").df
    days = rolling.calendar(daily, "trainer_id", "race_date")
    sums = ["n", "beat", "beat_n", "outperf", "outperf_n"]
    totals = rolling.trailing(days, daily, "trainer_id", "race_date", sums, PERIODS, tasks=rolling.tasks_for(daily, "trainer_id", "race_date"))
    out = []
    for p in PERIODS:
        mean = lambda c, p=p: F.col(f"{c}_{p}").cast("double") / F.when(F.col(f"{c}_n_{p}") > 0, F.col(f"{c}_n_{p}"))
        out += [F.coalesce(f"n_{p}", F.lit(0)).alias(f"n_{p}"), F.col(f"beat_{p}"), F.col(f"outperf_{p}").cast("double").alias(f"outperf_{p}"), mean("beat").alias(f"beatrate_{p}"), mean("outperf").alias(f"posbeat_{p}")]
    return totals.select("trainer_id", "race_date", *out)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated prizes and times that the number columns don't hold in kronor or seconds a km."""
    return units.restated(table(spark, sf_dir, "entry"), table(spark, sf_dir, "fx_rate"))


def queries() -> dict:
    """The core training-data queries by name."""
    return {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_all_descendants, p3_found, p6_found, p7_found, p7_rolling)}
