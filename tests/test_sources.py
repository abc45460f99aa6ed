"""Readers and sinks on small documents."""

import json

import pytest

from pyspark.sql import functions as F

from paddock.sources import readers, sinks


def test_race_documents(spark):
    good = {"id": "r1", "date": "2024-05-01", "number": 3, "distance": 2140, "startMethod": "auto", "track": {"id": 5, "name": "X"}, "starts": [{"number": 1, "horse": {"id": 7, "name": "A"}, "result": {"place": 1, "kmTime": {"minutes": 1, "seconds": 13, "tenths": 5}}}]}
    rows = [("r1", json.dumps(good)), ("r2", ""), ("r3", "{bad"), ("r4", json.dumps({**good, "starts": []})), ("r5", json.dumps({**good, "track": None})), ("r6", None)]
    head, starts, bad = readers.races(spark.createDataFrame(rows, "race_id string, raw string"))
    assert [r.race_id for r in head.collect()] == ["r1"] and starts.first().time_seconds == 73.5
    assert {r.race_id: r.reason for r in bad.collect()} == {"r2": "empty_raw", "r3": "unreadable", "r4": "no_date_or_starts", "r5": "no_track", "r6": "empty_raw"}


def test_calendar(spark):
    doc = {"tracks": [{"id": 1, "name": "A", "sport": "trot", "races": [{"id": "a", "number": 1, "status": "results"}, {"id": "b", "number": 2, "status": "upcoming"}]}, {"id": 2, "name": "G", "sport": "gallop", "races": [{"id": "c", "number": 1, "status": "results"}]}]}
    assert [r.race_id for r in readers.calendar(spark.createDataFrame([(json.dumps(doc),)], "raw string"), ["results"]).collect()] == ["a"]


def test_script_and_html(spark):
    js = 'x=1; /* races = [0] */ var races = [{"a": "b]\\"", "c": [1, 2]}]; y'
    assert json.loads(readers.scripted_json(spark.createDataFrame([(js,), (None,), ("races = [1",)], "t string"), "t", "races").collect()[0].json) == [{"a": 'b]"', "c": [1, 2]}]
    html = "<table><tr><th>Q</th></tr></table><table><tr><th>N°</th><th>Cheval</th></tr><tr><td>1</td><td> Foo <b>Bar</b></td></tr></table>"
    rows = readers.html_rows(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), "id", "h", ["N°", "Cheval"]).collect()
    assert [(r.id, r.row, r.cells) for r in rows] == [(1, 0, ["1", "Foo Bar"])]


def test_rates_chain_and_merge(spark, tmp_path):
    (tmp_path / "fx.csv").write_text("Date,SEK,USD,NOK\n2024-01-02,11.2,1.12,11.0\n2024-01-03,N/A,1.1,11.0\n")
    got = {(r.ccy, str(r.rate_date)): float(r.sek_per_unit) for r in readers.wide_rates(spark, str(tmp_path / "fx.csv")).collect()}
    assert got == {("USD", "2024-01-02"): 10.0, ("NOK", "2024-01-02"): 1.018182, ("EUR", "2024-01-02"): 11.2}
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "id int, nxt int")
    assert {(r.id, r.step) for r in readers.chain(links, [1], "id", "nxt").collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError):
        readers.chain(links, [1], "id", "nxt", steps=1)
    rows = spark.createDataFrame([(1, "a", None), (2, None, 5.5), (3, "c", 1.0)], "id int, n string, v double")
    kept, lost = sinks.merged(rows, spark.createDataFrame([(2, 1), (3, 3)], "loser int, keeper int"), "id")
    assert {r.id for r in kept.collect()} == {1, 3}
    assert set(sinks.rolled_back(kept, lost).collect()) == set(rows.collect())  # merge then rollback changes nothing


def test_fact_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2023-01-01"), (2, "2024-01-01")], "horse_id int, d string").withColumn("race_date", F.to_date("d")).drop("d")
    sinks.fact_table(rows, str(tmp_path / "fact"))
    assert spark.read.parquet(str(tmp_path / "fact")).where("year = 2024").first().horse_id == 2
