"""Every parser over texts with known meaning: the query parses, its SQL states what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import parse
from paddock.plans.base import QUERIES, SQL

c = F.col
SHAPE = "a string, b string, c string, d string, e string"


def _flags(r: Column) -> Column:
    return F.concat_ws(" ", *(F.when(r[k], k) for k in ("galopp", "disqualified", "withdrawn")))


def _both(r: Column, *names: str) -> Column:
    """Fields of a struct as one text, '-' for null."""
    return F.concat_ws("|", *(F.coalesce(r[n].cast("string"), F.lit("-")) for n in names))


def _bool(name: str) -> Column:
    return c(name).cast("boolean")


#: Parser over the texts a to e, and rows of texts with the result as text. Fixed values of the formats.
GOLDENS: dict[str, tuple[Callable[[], Column], list[tuple]]] = {
    "km_time": (lambda: parse.km_time(c("a")), [("14,4a", "1144"), ("1.13,2", "1132"), ("*15,3ag", "1153"), ("2,14,4", "2144"), ("ug", None), ("", None), ("14.4", None), (" 14,4 ", "1144")]),
    "km_seconds": (lambda: F.round(parse.km_seconds(c("a")), 1), [("14,4a", "74.4"), ("1.13,2", "73.2"), ("*15,3ag", "75.3"), ("2,14,4", "134.4"), ("ug", None)]),
    "money_kr": (lambda: parse.money_kr(c("a")), [("6 685 000 kr", "6685000"), ("84.700 kr", "84700"), ("84.700 kr, 2:a 40.000 kr", "84700"), ("0 kr", "0"), ("-", None), ("kr", None), ("6\u00a0500 kr", "6500"), ("", None)]),
    "position_distance": (lambda: _both(parse.position_distance(c("a")), "position", "distance"), [("7/2140", "7|2140"), ("/2140", "-|2140"), ("7/0", "7|-"), ("0/2140", "0|2140"), ("7/", "-|-"), ("abc", "-|-")]),
    "heading": (
        lambda: _both(parse.heading(c("a")), "track", "date"),
        [("Solvalla Onsdag 12 Mars 2025", "Solvalla|2025-03-12"), ("Solvalla ONSDAG 12 mars 2025", "Solvalla|2025-03-12"), ("Solvalla Someday 12 Mars 2025", "Solvalla Someday 12 Mars 2025|-"), ("Solvalla Onsdag 12 March 2025", "Solvalla|-"), ("Solvalla Onsdag 31 Februari 2025", "Solvalla|-"), ("Åby Lördag 1 Maj 2024", "Åby|2024-05-01")],
    ),
    "classify_placement": (lambda: _both(parse.classify_placement(c("a"), c("b")), "placement", "disqualified"), [("1", "1", "1|false"), ("0", "d", "-|true"), ("99", "r2", "99|true"), (None, "", "-|false"), ("0", "dist", "-|true"), ("0", "r", "-|false"), ("x", "da", "-|true")]),
    "start_method": (lambda: parse.start_method(c("a")), [("14,4a", "A"), ("13,2g", "V"), ("ug", None), ("ag", None), ("15,0ag", "A"), ("xyz", "V")]),
    "french_rank": (lambda: _flags(parse.french_rank(c("a"))), [("DA", "galopp disqualified"), ("D3", "galopp disqualified"), ("NP", "withdrawn"), ("A", "disqualified"), ("T", "disqualified"), ("4D", ""), ("1", ""), ("CV", "")]),
    "country": (lambda: parse.country(c("a")), [(" se ", "SE"), ("SWE", None), ("1A", None)]),
    "normalize_name": (lambda: parse.normalize_name(c("a")), [("Redén", "REDEN"), ("Bjørn", "BJORN"), ("Kjær", "KJAER"), ("Aubrion* (FR)", "AUBRION"), ("Anna K.J.", "ANNA K.J."), ("Čech", "CECH"), ("Őz", "OZ"), ("Redén", "REDEN"), ("Straße  Þór ?", "STRASSE THOR"), (None, "")]),
    "synth_id": (lambda: parse.synth_id(c("a"), c("b")), [("fr", "Indy Rock", "x:FR:INDY ROCK"), (None, "A", "x:??:A"), ("FR", "", None)]),
    "better_name": (
        lambda: parse.better_name(c("a"), c("b")),
        [("Aubrion du Gers", "AUBRION DU GERS (FR)", "Aubrion du Gers (FR)"), ("AUBRION", "Aubrion", "Aubrion"), ("Foo (SE)", "FOO", "Foo"), ("Foo", "Bar (USA)", "Bar (USA)"), ("Foo (FR)", "Foo", "Foo (FR)"), (None, "Foo", "Foo"), ("Foo", None, "Foo")],
    ),
    "swedish_time": (lambda: parse.swedish_time(c("a").cast("double")), [("70.9", "10,9"), ("68.0", "08,0"), ("59.5", "59,5"), ("120.0", "2'00\"0"), ("0", None)]),
    "swedish_placement": (lambda: parse.swedish_placement(c("a")), [("15e", "15"), ("DA", "DA"), ("1", "1"), ("e", "e"), (" 2e ", "2")]),
    "french_sex": (lambda: parse.french_sex(c("a")), [("H", "V"), ("F", "S"), ("M", "H"), ("x", "x")]),
    "sex_hvs": (lambda: parse.sex_hvs(c("a")), [("mare", "S"), ("mâle", "H"), ("hongre", "V"), ("entier", "H"), ("g", "V"), ("m", None), ("h", None), ("s", None)]),
    "total_prize": (lambda: parse.total_prize(c("a")), [("Prispengar max total: 84.700 kr.", "84700"), ("Max Total: 1 200 kr", "1200"), ("84.700 kr", None)]),
    "proposition": (lambda: parse.proposition(F.split(c("a"), ";")), [("a ; b;;c", "a\nb\nc"), ("", None)]),
    "placement_text": (
        lambda: parse.placement_text(c("a").cast("int"), c("b").cast("int"), _bool("c"), _bool("d"), _bool("e")),
        [("1", "1", "false", "false", "true", "utg"), ("1", "1", "true", "false", None, "d"), ("3", "3", None, "true", None, "3"), ("0", "3", None, "true", None, "g"), (None, "7", None, None, None, "0"), (None, None, None, None, None, None), ("2", "2", None, None, None, "2")],
    ),
    "studbook_placement_text": (lambda: parse.studbook_placement_text(c("a").cast("int"), _bool("b"), _bool("c"), _bool("d"), c("e")), [("1", None, None, "true", None, "utg"), ("1", "true", None, None, None, "d"), (None, None, "true", None, None, "g"), ("4", None, "true", None, None, "4"), (None, None, None, None, " k ", "k"), (None, None, None, None, "", None)]),
    "broke_gait": (lambda: parse.broke_gait(c("a")), [("19,3g", "true"), ("18,3a", "false"), (None, "false")]),
    "shoe_code": (lambda: parse.shoe_code(_bool("a"), _bool("b"), _bool("c")), [("true", "true", "true", "4"), ("true", "true", "false", "3"), ("true", "false", "true", "2"), ("true", None, None, "1"), ("false", "true", "true", None)]),
    "french_seconds": (lambda: parse.french_seconds(c("a")), [("1'13\"5", "73.5"), ("1.13.5", "73.5"), ("DA", None), ("-", None)]),
    "euros": (lambda: parse.euros(c("a")), [("12 345 €", "12345"), ("7\u202f532€", "7532"), ("6.038.408 €", "6038408"), ("-", None), ("", None)]),
    "french_place": (lambda: _both(parse.french_place(c("a")), "number", "text"), [("2e", "2|2e"), ("0", "-|0"), ("DA", "-|DA")]),
    "french_date": (lambda: parse.french_date(c("a")), [("9/5/2026", "2026-05-09"), ("31/02/2026", None), ("2026-05-09", None)]),
    "sex_and_age": (lambda: _both(parse.sex_and_age(c("a")), "sex", "age"), [("H10", "H|10"), ("f4", "F|4"), ("x", "-|-")]),
    "german_date": (lambda: parse.german_date(c("a")), [("16.04.2002", "2002-04-16"), ("31.02.2002", None)]),
    "german_seconds": (lambda: parse.german_seconds(c("a")), [("1:13,7", "73.7"), ("dis.r.", None)]),
    "suffix_country": (lambda: parse.suffix_country(c("a")), [("Nuncio (US)", "US"), ("Marlen (DE) ", "DE"), ("Nuncio", None)]),
    "german_sex": (lambda: parse.german_sex(c("a")), [("Hengst", "H"), ("Stute", "S"), ("Wallach", "V"), ("Fohlen", None)]),
    "to_milliseconds": (lambda: parse.to_milliseconds(c("a")), [("1.21,6 min/km", "81600.0"), ("x", None)]),
    "race_key": (lambda: _both(parse.race_key(c("a")), "date", "track", "number"), [("2026-05-09_6_1", "2026-05-09|6|1"), ("2026-05-09_6", "-|-|-"), ("2026-13-09_6_1", "-|-|-")]),
    "no_sentinel": (lambda: parse.no_sentinel(c("a").cast("double")), [("9.0e15", None), ("12.5", "12.5"), ("NaN", None)]),
    "placement_split": (lambda: _both(parse.placement_split(c("a")), "starts", "first", "second", "third"), [("35 (8-3-4)", "35|8|3|4"), ("12", "12|-|-|-"), ("x", "-|-|-|-")]),
    "rotated_name": (lambda: parse.rotated_name(c("a")), [("Goop Björn", "Björn Goop"), ("Svensson Erik Karl", "Erik Karl Svensson"), ("Goop", "Goop")]),
    "short_name": (lambda: parse.short_name(c("a")), [("Goop Björn", "Goo Bj"), ("Svensson Erik Karl", "Sve EK"), ("goop", "Goo"), (None, "")]),
    "slug": (lambda: parse.slug(c("a")), [("Saint-Galmier", "saintgalmier"), ("Åby", "aby")]),
    "kr_text": (lambda: parse.kr_text(c("a").cast("bigint")), [("1234567", "1 234 567 kr"), ("0", "0 kr")]),
    "race_title": (lambda: parse.race_title(c("a")), [("V75-1 (x) - Klass I", "Klass I"), ("Plain  name", "Plain name"), (None, "")]),
    "distance_label": (lambda: parse.distance_label(c("a").cast("int"), c("b")), [("2140", "volte", "2140m volt"), ("2140", "Auto", "2140m auto"), ("2140", None, "2140m"), (None, "auto", None)]),
    "track_name": (lambda: parse.track_name(c("a")), [("ENGHIEN", "Enghien"), ("SAINT-GALMIER", "Saint-Galmier"), ("Bjerke Travbane", "Bjerke Travbane"), ("aby park", "Aby Park")]),
    "permille": (lambda: parse.permille(c("a").cast("int"), c("b").cast("int")), [("7", "2", "286"), ("6", "6", None)]),
    "birth_year": (lambda: parse.birth_year(c("a").cast("date"), c("b").cast("int"), c("c").cast("date")), [("2010-05-01", "3", "2020-01-01", "2010"), (None, "3", "2020-01-01", "2017"), (None, None, "2020-01-01", None)]),
    "iso_date": (lambda: parse.iso_date(c("a")), [("2025-01-31T10:00:00", "2025-01-31"), ("2025-02-31", None), ("x", None)]),
    "iso_datetime": (lambda: parse.iso_datetime(c("a")), [("2025-01-31T10:00:00", "2025-01-31 10:00:00"), ("2025-01-31", "2025-01-31 00:00:00"), ("x", None)]),
    "lifetime": (
        lambda: _both(parse.lifetime(c("a")), "starts", "wins", "prize_money_kr", "record"),
        [('{"statistics": [{"year": "2024", "numberOfStarts": "3"}, {"year": "Livs", "numberOfStarts": "35", "placements": "8-3-4", "prizeMoney": "1 234 500 kr", "mark": "13,2a"}]}', "35|8|1234500|13,2a"), ('{"statistics": []}', "-|-|-|-"), ("cut off {", "-|-|-|-")],
    ),
    "live_odds": (lambda: parse.live_odds(c("a").cast("int")), [("345", "3.45"), ("0", None)]),
    "percent": (lambda: parse.percent(c("a").cast("int"), c("b").cast("int")), [("1", "3", "33.3"), ("1", "0", None), ("1", "16", "6.2")]),
    "placeholder": (lambda: parse.is_placeholder(c("a")), [("Ej färdigreg 12", "true"), ("Unnamed", "true"), ("Real Name", "false"), (None, "false")]),
    "gender_label": (lambda: parse.gender_label(c("a")), [("H", "stallion"), ("V", "gelding"), ("S", "mare"), ("x", None)]),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build, rows = GOLDENS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        given = [(i, *r[:-1], *([None] * (6 - len(r)))) for i, r in enumerate(rows)]
        return spark.createDataFrame(given, f"n int, {SHAPE}").select("n", build().cast("string").alias("result"))

    return run


def _sql(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "SELECT n, result FROM (VALUES " + ", ".join(f"({i}, {text(r[-1])}::VARCHAR)" for i, r in enumerate(rows)) + ") v(n, result)"


for _name, (_, _rows) in GOLDENS.items():
    QUERIES[f"golden_{_name}"], SQL[f"golden_{_name}"] = _query(_name), _sql(_rows)
