"""Golden values of the parsers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paddock.functions import parse as p


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "code"), [("14,4a", 1144), ("1.13,2", 1132), ("*15,3ag", 1153), ("2,14,4", 2144), ("ug", None), ("", None), ("14.4", None), (None, None)])
def test_km_time(spark, text, code):
    assert one(spark, p.km_time, text) == code


def test_seconds(spark):
    assert one(spark, p.km_seconds, "14,4a") == pytest.approx(74.4)
    assert one(spark, p.km_seconds, "2,14,4") == pytest.approx(134.4)
    assert one(spark, p.clock_seconds, "1'13\"5") == pytest.approx(73.5)
    assert one(spark, p.clock_seconds, "DA") is None
    assert one(spark, p.to_milliseconds, "1.21,6 min/km") == pytest.approx(81600.0)


@pytest.mark.parametrize(("text", "kr"), [("6 685 000 kr", 6685000), ("84.700 kr", 84700), ("0 kr", 0), ("-", None), ("kr", None), (None, None)])
def test_money(spark, text, kr):
    assert one(spark, p.money_kr, text) == kr


@pytest.mark.parametrize(("text", "both"), [("7/2140", (7, 2140)), ("/2140", (None, 2140)), ("7/0", (7, None)), ("abc", (None, None))])
def test_position(spark, text, both):
    assert tuple(one(spark, p.position_distance, text)) == both


@pytest.mark.parametrize(("text", "both"), [("Solvalla Onsdag 12 Mars 2025", ("Solvalla", dt.date(2025, 3, 12))), ("Solvalla 12", ("Solvalla 12", None)), ("Solvalla Onsdag 31 Februari 2025", ("Solvalla", None))])
def test_heading(spark, text, both):
    assert tuple(one(spark, p.heading, text)) == both


@pytest.mark.parametrize(("a", "b", "want"), [("1", "1", (1, False)), ("0", "d", (None, True)), ("99", "r2", (99, True)), (None, "", (None, False))])
def test_placement(spark, a, b, want):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(p.classify_placement(F.col("a"), F.col("b")).alias("y")).first().y
    assert tuple(r) == want


@pytest.mark.parametrize(("text", "want"), [("14,4a", "A"), ("13,2g", "V"), ("ug", None), ("ag", None)])
def test_start_method(spark, text, want):
    assert one(spark, p.start_method, text) == want


@pytest.mark.parametrize(("code", "flags"), [("DA", (True, True, False)), ("D3", (True, True, False)), ("NP", (False, False, True)), ("A", (False, True, False)), ("4D", (False, False, False)), ("1", (False, False, False)), (None, (False, False, False))])
def test_rank_codes(spark, code, flags):
    assert tuple(one(spark, p.french_rank, code)) == flags


@pytest.mark.parametrize(("name", "want"), [("Redén", "REDEN"), ("Bjørn", "BJORN"), ("Kjær", "KJAER"), ("Aubrion* (FR)", "AUBRION"), ("Anna K.J.", "ANNA K.J."), (None, "")])
def test_names(spark, name, want):
    assert one(spark, p.normalize_name, name) == want


def test_keys_and_names(spark):
    df = spark.createDataFrame([("fr", "Indy Rock", "Aubrion du Gers", "AUBRION DU GERS (FR)"), (None, "A", "AUBRION", "Aubrion"), ("FR", "", "Foo (SE)", "FOO")], "c string, n string, a string, b string")
    rows = df.select(p.synth_id(F.col("c"), F.col("n")).alias("k"), p.better_name(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.k for r in rows] == ["x:FR:INDY ROCK", "x:??:A", None]
    assert [r.m for r in rows] == ["Aubrion du Gers (FR)", "Aubrion", "Foo"]


@pytest.mark.parametrize(("s", "want"), [(70.9, "10,9"), (68.0, "08,0"), (59.5, "59,5"), (120.0, "2'00\"0"), (0.0, None)])
def test_swedish_time(spark, s, want):
    assert one(spark, p.swedish_time, s, "double") == want


def test_the_rest(spark):
    assert one(spark, p.country, " se ") == "SE" and one(spark, p.country, "SWE") is None and one(spark, p.country, "1A") is None
    assert [one(spark, p.sex_hvs, x) for x in ("mare", "mâle", "hongre", "g", "m")] == ["S", "H", "V", "V", None]
    assert one(spark, p.german_date, "16.04.2002") == dt.date(2002, 4, 16)
    assert tuple(one(spark, p.placement_split, "35 (8-3-4)")) == (35, 8, 3, 4) and tuple(one(spark, p.placement_split, "12")) == (12, None, None, None)
    assert one(spark, p.rotated_name, "Goop Björn") == "Björn Goop"
    assert one(spark, p.slug, "Saint-Galmier") == "saintgalmier"
    assert one(spark, p.kr_text, 1234567, "bigint") == "1 234 567 kr"
    assert one(spark, p.no_sentinel, 9.0e15, "double") is None
    r = spark.createDataFrame([(7, 2), (6, 6)], "n int, w int").select(p.permille(F.col("n"), F.col("w")).alias("y")).collect()
    assert [x.y for x in r] == [286, None]
