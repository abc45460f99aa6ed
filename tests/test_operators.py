"""Properties of reference operators and hand-worked fixtures."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from paddock.operators import asof, identity, incremental, ranking
from paddock.plans.features import feature_table
from paddock.streaming import events as S

RUN = "entry_id bigint, race_id int, program_number int, odds double, finish_order int, placement int, withdrawn boolean, placement_text string"


def test_outperformance_and_percentile(spark):
    rows = [(1, 1, 1, 2.0, 2, 2, False, "2"), (2, 1, 2, 3.0, 1, 1, False, "1"), (3, 1, 3, 10.0, 3, 3, False, "3"), (4, 1, 4, 50.0, 4, 4, False, "4"), (5, 2, 1, 2.0, 1, 1, False, "1"), (6, 2, 2, 2.0, 2, 2, False, "2"), (7, 2, 3, 2.0, 3, 3, False, "3"), (8, None, 1, 2.0, 1, 1, False, "1")]
    df = spark.createDataFrame(rows, RUN)
    assert {r.entry_id: round(r.market_outperf * 3) for r in ranking.market_outperformance(df).collect()} == {1: -1, 2: 1, 3: 0, 4: 0}
    assert {r.entry_id: round(r.perf * 3) for r in ranking.finish_percentile(df).collect()} == {1: 2, 2: 3, 3: 1, 4: 0}


def test_streaks(spark):
    df = spark.createDataFrame([(1, i, g) for i, g in enumerate([False, True, True, False, False])], "h int, i int, g boolean")
    got = asof.streaks(df, ["h"], ["i"], F.col("g")).orderBy("i").collect()
    assert [r.on_streak for r in got] == [0, 0, 1, 2, 0] and [r.off_streak for r in got] == [0, 1, 0, 0, 1]


def test_days_before(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, d), (1, d + dt.timedelta(30)), (1, d + dt.timedelta(30)), (1, d + dt.timedelta(31))], "p int, d date")
    got = {r.d: r.n for r in asof.trailing_days(df, ["p"], "d", {"n": F.count(F.lit(1))}, 30).collect()}
    assert got == {d: None, d + dt.timedelta(30): 1, d + dt.timedelta(31): 2}


def test_features_know_nothing_later(spark, small, tmp_path):
    from paddock.runtime import table

    e = table(spark, small, "entry")
    e.where("race_date < '2023-01-01'").write.parquet(str(tmp_path / "entry.parquet"))
    keep = ["entry_id", "horse_starts", "horse_winrate", "days_since", "starts_90d", "driver_starts", "driver_winrate_30d", "trainer_starts"]
    whole = feature_table(spark, small).join(e.select("entry_id", "race_date").distinct(), "entry_id").where("race_date < '2023-01-01'").select(keep)
    assert set(whole.collect()) == set(feature_table(spark, str(tmp_path)).select(keep).collect())


def test_jaccard_and_mutual_best(spark):
    df = spark.createDataFrame([(["1:A", "2:B", "3:C"], ["1:A", "2:B", "4:D"]), ([], [])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(identity.jaccard("a", "b").alias("j")).collect()] == [0.5, 0.0]
    p = spark.createDataFrame([("a", "x", 40), ("a", "y", 10), ("b", "x", 15), ("c", "z", 30), ("d", "z", 20)], "l string, r string, s int")
    assert {(r.l, r.r) for r in identity.mutual_best(p, "l", "r", "s").collect()} == {("a", "x")}


def test_upserts(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, None, 2), (None, "n", 0)], "k int, s string, v int")
    b = spark.createDataFrame([(2, "b", None), (3, None, 3)], "k int, s string, v int")
    assert set(map(tuple, incremental.upsert(a, b, ["k"]).collect())) == {(1, "a", 1), (None, "n", 0), (2, "b", None), (3, None, 3)}
    assert set(map(tuple, incremental.upsert_preserving(a, b, ["k"], ["v"]).collect())) == {(1, "a", 1), (None, "n", 0), (2, "b", 2), (3, None, 3)}
    once = incremental.upsert(a, b, ["k"])
    assert sorted(map(str, incremental.upsert(once, b, ["k"]).collect())) == sorted(map(str, once.collect()))
    assert [r.k for r in incremental.changed(a, b, ["k"], ["s", "v"]).collect()] == [2]


def test_stream_upsert_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for i in range(3):
        spark.createDataFrame([(k, i * 10 + k, i) for k in range(i, i + 3)], "k int, v int, t int").coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    S.upserts(stream, str(out), ["k"], "t", str(tmp_path / "state"))()
    want = {r.k: r.v for r in spark.read.parquet(str(src)).groupBy("k").agg(F.max_by("v", "t").alias("v")).collect()}
    assert {r.k: r.v for r in S.current(spark, str(out), ["k"], "t").collect()} == want
    assert {r.k: r.v for r in spark.read.parquet(S.compacted(spark, str(out), ["k"], "t")).collect()} == want


def test_shared_folder_is_not_made_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as N

    from paddock import runtime

    none = N(isDefined=lambda: False)
    sc = N(getConf=lambda: {}, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        runtime.shared_dir(N(sparkContext=sc, conf=N(get=lambda k, default: default)))


def test_increment_equals_recompute(spark):
    from paddock.plans import increment

    cols = "entry_id int, x int, y_win boolean, y_top3 boolean"
    stored = spark.createDataFrame([(1, 5, None, None), (2, 6, True, True)], cols)
    computed = spark.createDataFrame([(1, 5, False, True), (2, 6, True, True), (3, 7, None, None)], cols)
    once = increment.refreshed(stored, computed)
    assert set(map(tuple, once.collect())) == set(map(tuple, computed.collect()))
    assert set(map(tuple, increment.refreshed(once, computed).collect())) == set(map(tuple, computed.collect()))
    assert [r.entry_id for r in increment.late_labels(stored, computed).collect()] == [1]


def test_pipeline(spark):
    from paddock.plans.pipeline import Phase, run

    done = []
    phases = [Phase("a", lambda: spark.range(3), lambda df: done.append("a")), Phase("b", lambda: spark.range(1), lambda df: done.append("b")), Phase("c", lambda: 1 / 0), Phase("d", lambda: spark.range(9))]
    dry = run(phases, skip={"b"})
    assert dry.rows == {"a": 3} and dry.failed.startswith("c: ") and done == []
    run(phases, execute=True)
    assert done == ["a", "b"]


def test_sql_functions(spark):
    from paddock.functions.sql import register

    assert "normalize_name" in register(spark)
    r = spark.sql("SELECT km_time_code('*15,3ag') a, money_kr('84.700 kr') b, distance_band(2140) c, normalize_name('Kjær* (FR)') d, normalize_name(NULL) e, km_time_code('ug') f").first()
    assert tuple(r) == (1153, 84700, "m", "KJAER", "", None)


def test_asof_pairs_on_every_day(spark, small):
    from paddock.plans.features import asof_pairs_all, starts

    s = starts(spark, small, "driver_id", "won").where("driver_id is not null and race_date is not null").select("driver_id", "race_date", "won").collect()
    want = {(k.driver_id, k.race_date + dt.timedelta(3)) for k in s}
    got = {(r.driver_id, r.as_of): (r.starts, r.wins) for r in asof_pairs_all(spark, small).collect()}
    assert set(got) == want and any(day.day > 8 for _, day in want)
    for who, day in sorted(want)[::20]:
        near = [k for k in s if k.driver_id == who and 1 <= (day - k.race_date).days <= 30]
        assert got[who, day] == (len(near), sum(bool(k.won) for k in near))


def test_sibling_counts_of_every_horse(spark, tmp_path):
    from paddock.plans.browse import sibling_counts

    rows = [(1, 100, 200), (2, 100, 200), (3, 100, 201), (4, 101, 200), (5, None, 200), (6, 100, None), (7, None, None)]
    spark.createDataFrame(rows, "horse_id int, sire_id int, dam_id int").write.parquet(str(tmp_path / "horse.parquet"))
    got = {tuple(r) for r in sibling_counts(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 2, 2), (2, 1, 2, 2), (3, 0, 3, 0), (4, 0, 0, 3), (5, 0, 0, 3), (6, 0, 3, 0), (7, 0, 0, 0)}
