"""Documents of the sources taken in, over planted documents that hold one case of each rule."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.plans.base import query
from paddock.plans.planted import Planted
from paddock.sources import shaping as Z


def _start(number: int, name: str, place: int | None = None, **more: object) -> dict:
    return {"number": number, "postPosition": number, "horse": {"name": name, "age": 5, "sex": "mare", "shoes": {"reported": True, "front": {"hasShoe": True}, "back": {"hasShoe": number % 2 == 0}}}, "result": {"place": place, **more}}


_KM = {"minutes": 1, "seconds": 14, "tenths": 4}
_RACE = {
    "sport": "trot", "date": "2024-05-01", "number": 1, "distance": 2140, "track": {"id": 6, "name": "Solvalla", "countryCode": "SE"}, "result": {"scratchings": [4]},
    "starts": [_start(1, "Alpha", 1, finishOrder=1, kmTime=_KM, finalOdds=3.5, prizeMoney=50000), _start(2, "Beta", 0, finishOrder=5, galloped=True), _start(3, "Gamma", None, disqualified=True), _start(4, "Delta"), _start(5, "", 2), {**_start(6, "Eta", 2, finishOrder=2, galloped=True, kmTime={"minutes": 2, "seconds": 1, "tenths": 0}), "distance": 2160}],
}
BETS = Planted("bt", "race_key string, raw string", [
    ("2024-05-01_6_1", json.dumps(_RACE)), ("2024-05-01_6_2", json.dumps({**_RACE, "sport": "gallop"})), ("2024-05-01_6_3", json.dumps({**_RACE, "starts": []})), ("2024-05-01_6_4", json.dumps({**_RACE, "track": None})),
    ("2024-05-01_6_5", "{cut"), ("2024-05-01_6_6", None), ("x", json.dumps({**_RACE, "date": None})),
])


@query("SELECT * FROM (VALUES ('2024-05-01_6_1', NULL), ('2024-05-01_6_2', 'gallop'), ('2024-05-01_6_3', 'no_date_or_starts'), ('2024-05-01_6_4', 'no_track'), ('2024-05-01_6_5', 'empty_raw'), ('2024-05-01_6_6', 'empty_raw'), ('x', 'no_date_or_starts')) v(race_key, skipped)")
def ingest_skips(spark: SparkSession, d: str) -> DataFrame:
    return Z.betting_races(BETS.df(spark)).select("race_key", "skipped")


@query(f"""WITH {BETS.sql}, r AS (SELECT race_key, raw::JSON j FROM bt WHERE race_key = '2024-05-01_6_1'), s AS (SELECT race_key, j, unnest(json_extract(j, '$.starts[*]')) s FROM r),
f AS (SELECT race_key, (s->>'$.number')::INT program_number, coalesce((s->>'$.distance')::INT, (j->>'$.distance')::INT) distance, (s->>'$.result.place')::INT place, s->>'$.result.finishOrder' fo, coalesce((s->>'$.result.disqualified')::BOOLEAN, false) disqualified, coalesce((s->>'$.result.galloped')::BOOLEAN, false) galopp,
list_contains((j->'$.result.scratchings')::INT[], (s->>'$.number')::INT) withdrawn, (s->>'$.result.kmTime.minutes')::INT * 60 + (s->>'$.result.kmTime.seconds')::INT + (s->>'$.result.kmTime.tenths')::INT / 10.0::DOUBLE time_seconds, s->'$.horse.shoes' sh FROM s WHERE s->>'$.horse.name' <> '')
SELECT race_key, program_number, distance, CASE WHEN place >= 1 THEN place END placement, CASE WHEN withdrawn THEN 'utg' WHEN disqualified THEN 'd' WHEN galopp AND place >= 1 THEN place::VARCHAR WHEN galopp THEN 'g' WHEN place IS NOT NULL THEN place::VARCHAR WHEN fo IS NOT NULL THEN '0' END placement_text, withdrawn, disqualified, galopp, time_seconds,
CASE WHEN (sh->>'$.back.hasShoe')::BOOLEAN THEN '4' ELSE '3' END shoe_code, DATE '2019-01-01' born_about, 'S' sex FROM f""")
def ingest_starts(spark: SparkSession, d: str) -> DataFrame:
    return Z.betting_starts(BETS.df(spark)).select("race_key", "program_number", "distance", "placement", "placement_text", "withdrawn", "disqualified", "galopp", "time_seconds", "shoe_code", "born_about", "sex")


def _ran(i: int, number: str, place: str | None, display: str | None, time: str | None, at: str | None) -> dict:
    return {"horse": {"id": i, "name": f"H{i}"}, "programNumber": number, "placementNumber": place, "placementDisplay": display, "time": time, "startPositionAndDistance": at}


_DAY = {"raceDate": "2024-05-01", "races": [
    {"raceId": 1, "raceNumber": 1, "results": [_ran(1, "1", "1", "1", "14,4a", "1/2140"), _ran(2, "2", "0", "d", "9g", "2/2140"), _ran(3, "x", "3", "3", "15,0ag", None), _ran(4, "4", "99", "k", "ug", "/2160")], "prohibitedHorses": [{"id": 5, "programNumber": "5", "cause": "ill"}, {"id": 1, "programNumber": "1"}, {"id": None}]},
    {"raceId": 2, "raceNumber": 2, "results": [], "prohibitedHorses": [{"id": 1, "programNumber": "7"}]}, {"raceId": 3, "raceNumber": 3, "results": None, "prohibitedHorses": None},
]}
DAYS = Planted("dy", "raw string", [(json.dumps(_DAY),), ("{cut",), (None,)])
_RES = """SELECT (r->>'$.raceId')::INT race_id, unnest(json_extract(r, '$.results[*]')) s FROM r"""


@query(f"""WITH {DAYS.sql}, r AS (SELECT unnest(json_extract(raw::JSON, '$.races[*]')) r FROM dy WHERE json_valid(raw)), s AS ({_RES}),
f AS (SELECT race_id, (s->>'$.horse.id')::INT horse_id, TRY_CAST(s->>'$.programNumber' AS INT) program_number, TRY_CAST(nullif(regexp_extract(s->>'$.startPositionAndDistance', '^([0-9]*)/', 1), '') AS INT) post, TRY_CAST(nullif(regexp_extract(s->>'$.startPositionAndDistance', '/([0-9]+)$', 1), '') AS INT) dist,
CASE WHEN (s->>'$.placementNumber')::INT > 0 THEN (s->>'$.placementNumber')::INT END placement, starts_with(lower(coalesce(s->>'$.placementDisplay', '')), 'd') disqualified, coalesce(ends_with(lower(s->>'$.time'), 'g'), false) galopp FROM s),
u AS (SELECT race_id, dist FROM f WHERE dist IS NOT NULL GROUP BY race_id, dist QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY count(*) DESC, dist) = 1),
p AS (SELECT (r->>'$.raceId')::INT race_id, unnest(json_extract(r, '$.prohibitedHorses[*]')) h FROM r), q AS (SELECT race_id, (h->>'$.id')::INT horse_id, TRY_CAST(h->>'$.programNumber' AS INT) program_number FROM p WHERE h->>'$.id' IS NOT NULL)
SELECT f.race_id, horse_id, program_number, post, coalesce(f.dist, u.dist) distance, placement, CASE WHEN disqualified THEN 'd' ELSE placement::VARCHAR END placement_text, false withdrawn FROM f LEFT JOIN u USING (race_id)
UNION ALL SELECT race_id, horse_id, program_number, NULL, NULL, NULL, 'utg', true FROM q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.race_id = q.race_id AND f.horse_id = q.horse_id)""")
def ingest_raceday(spark: SparkSession, d: str) -> DataFrame:
    return Z.raceday_starts(DAYS.df(spark)).select("race_id", "horse_id", "program_number", "post", "distance", "placement", "placement_text", "withdrawn")


@query(f"WITH {DAYS.sql}, r AS (SELECT unnest(json_extract(raw::JSON, '$.races[*]')) r FROM dy WHERE json_valid(raw)), n AS (SELECT unnest(list_concat(json_extract_string(r, '$.results[*].horse.id'), json_extract_string(r, '$.prohibitedHorses[*].id'))) i FROM r) SELECT DISTINCT i::INT horse_id FROM n WHERE i IS NOT NULL AND i::INT NOT IN (1, 2)")
def ingest_discovered(spark: SparkSession, d: str) -> DataFrame:
    return Z.discovered(DAYS.df(spark), spark.createDataFrame([(1,), (2,)], "horse_id int"))


def _runner(n: int, distance: int | None, place: int | None, code: str | None, time: str | None, prize: float | None = None, record: str | None = None, sex: str = "H") -> dict:
    return {"program_number": n, "distance": distance, "placement": place, "placement_text": code, "km_time_text": time, "prize_eur": prize, "musique": record, "sex": sex}


COURSES = Planted("fr", "race_key string, raw string", [("c1", json.dumps({"race_date": "2024-05-01", "runners": [_runner(1, 2700, 1, "1", "1'13\"5", 9000.0), _runner(2, 2700, 2, "2e", "1'13\"9", 4000.0, "1a", "F"), _runner(3, 2725, None, "DA", "DA"), _runner(4, None, None, "0", None), _runner(5, 2725, None, "0", None, None, "2a", "M"), _runner(6, 2700, None, "NP", None), _runner(7, None, None, "0", "DI")]})), ("c2", "{cut"), ("c3", None)])


@query(f"""WITH {COURSES.sql}, r AS (SELECT race_key, unnest(json_extract(raw::JSON, '$.runners[*]')) s FROM fr WHERE json_valid(raw)),
f AS (SELECT race_key, (s->>'$.program_number')::INT program_number, (s->>'$.placement')::INT placement, s->>'$.placement_text' code, s->>'$.km_time_text' km, (s->>'$.prize_eur') prize, s->>'$.musique' mu, s->>'$.sex' sx FROM r)
SELECT race_key, 2700 race_distance, program_number, placement, regexp_replace(code, '^([0-9]+)e$', '\\1') placement_text, CASE WHEN regexp_matches(km, '[0-9]') THEN regexp_extract(km, '^([0-9]+)', 1)::INT * 60 + regexp_extract(km, chr(39) || '([0-9]+)', 1)::INT + regexp_extract(km, '"([0-9]+)', 1)::INT / 10.0::DOUBLE END time_seconds,
CASE WHEN program_number = 1 THEN '13,5' WHEN program_number = 2 THEN '13,9' END time_text, CASE sx WHEN 'H' THEN 'V' WHEN 'F' THEN 'S' WHEN 'M' THEN 'H' END sex, (placement IS NULL AND code = '0' AND km IS NULL AND prize IS NULL AND mu IS NULL) OR code = 'NP' withdrawn, code = 'DA' OR coalesce(km IN ('DI', 'DA'), false) disqualified, code = 'DA' galopp FROM f""")
def ingest_course(spark: SparkSession, d: str) -> DataFrame:
    return Z.course_starts(COURSES.df(spark)).withColumn("time_seconds", F.round("time_seconds", 6))
