"""Queries over small planted frames, and over the supplied entries with planted ones beside them.

The supplied tables hold no case of some rules; these frames hold one of each, so that a query and
its SQL have rows to disagree about.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.parse import is_placeholder
from paddock.operators import audit as A
from paddock.operators import identity as I
from paddock.operators import merging as M
from paddock.operators import resolving as R
from paddock.plans.base import query

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@dataclass
class Planted:
    """Rows as a frame and as SQL."""

    name: str
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        def text(v: object) -> str:
            if v is None:
                return "NULL"
            return str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"

        fields = [f.split() for f in self.schema.split(", ")]
        casts = ", ".join(f'"{n}"::{KINDS[k]} AS "{n}"' for n, k in fields)
        names = ", ".join(f'"{n}"' for n, _ in fields)
        values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) v({names}))"


def _d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


HORSE = Planted(
    "ph", "horse_id int, name string, date_of_birth date, birth_country string, sire_name string, dam_name string, st_id int, atg_id string, ueln string, registration string",
    [
        (1, "Old Ghost", _d("1990-05-01"), "SE", "A", "B", 11, "x:SE:OLD GHOST", "u1", "r1"), (2, "Face Time", _d("2015-05-01"), "FR", "A", "B", 12, "x:FR:FACE TIME", "u2", "r1"),
        (3, "Josh Power", _d("2014-01-01"), "FR", None, None, None, "x:FR:JOSH POWER", "u3", None), (4, "Josh Power", _d("2014-03-01"), None, "C", "D", None, "5004", "u3", "r4"),
        (5, "Josh  Pówer*", _d("2014-06-01"), "IT", "C", "D", None, "x:IT:JOSH POWER", None, None), (6, "Josh Power", _d("2014-09-01"), "DE", "Ć", "d", None, "5006", None, "r6"),
        (7, "Idle", _d("2010-01-01"), "SE", None, None, 17, None, None, None), (8, "Zero", None, "SE", None, None, None, "0", None, None), (9, None, None, None, None, None, None, None, None, None),
    ],
)
ENTRY = Planted(
    "pe", "entry_id bigint, race_id int, horse_id int, primary_source string, placement_text string, race_date date, post int, name string",
    [
        (1, 1, 1, "st", "1", _d("2015-01-01"), 1, "Old Ghost"), (2, 2, 1, "st", "2", _d("2016-01-01"), 2, "Old Ghost"), (3, 1, 2, "atg", "1", _d("2021-01-01"), 2, "Face Time"), (4, 2, 3, "atg", "1", _d("2021-01-02"), 3, "Josh Power"),
        (5, 3, 3, "atg", "3", _d("2021-01-03"), 1, "Josh Power"), (6, 3, 4, "st", "1", _d("2021-01-03"), 5, "Josh"), (7, 4, 4, "st", "2", _d("2021-01-03"), 2, "Josh"), (8, 4, 4, "atg", "2", _d("2021-01-03"), None, "Josh"),
        (9, 5, 5, "atg", "4", _d("2021-01-03"), 1, "Other"), (10, 5, 3, "atg", "5", _d("2021-01-03"), 2, "Josh Power"), (11, 5, 4, "atg", "6", _d("2021-01-03"), 3, "Josh"), (12, None, 6, "atg", "1", None, 1, "Nowhere"),
    ],
)
RACE = Planted(
    "pr", "race_id int, race_date date, track_id int, race_number int, st_race_id int, atg_race_id string, track string",
    [
        (1, _d("2021-01-01"), 1, 1, 101, "a1", "Solvalla"), (2, _d("2021-01-02"), 1, 2, 102, "a2", "Solvalla"), (3, _d("2021-01-03"), 2, 1, 103, "a3", "France"), (4, _d("2021-01-03"), 2, 1, 104, "a4", "Åby"),
        (5, _d("2021-01-03"), 3, 1, None, "a5", "Vincennes"), (6, None, 3, None, None, None, "Vincennes"), (7, _d("2021-01-03"), 2, 1, None, None, "Åby"),
    ],
)
PERSON = Planted("pp", "person_id int, name string, st_id int, atg_id string", [(1, "Anna B", 1, "77"), (2, "ANNA B", None, "x:SE:ANNA B"), (3, "Carl", None, "x:??:CARL"), (4, "Carl", 4, "0"), (5, None, None, None)])
TRACK = Planted("pt", "track_id int, name string, country string", [(1, "Solvalla", "SE"), (2, "solvalla", "SE"), (3, "Vincennes", None), (4, "VINCENNES", None), (5, "Vincennes", "FR"), (6, "Åby", "SE"), (7, "Lonely", "SE")])
NAMES = Planted("pn", "row_id int, name string, country string", [(1, "SOLVALLA", "SE"), (2, "Vincennes", "FR"), (3, "Vincennes", "DE"), (4, "vincennes", None), (5, "Nowhere", "SE"), (6, None, "SE"), (7, "Lonely", "NO")])


def _pure(name: str, frames: list[Planted], sql: str):
    return query(f"WITH {', '.join(f.sql for f in frames)} {sql}", name=name)


def _nn(c: str) -> str:
    from paddock.plans.identity import _norm_sql

    return _norm_sql(c)


@_pure("audit_a", [HORSE, ENTRY], """, p AS (SELECT h.horse_id, any_value(h.date_of_birth) dob FROM ph h JOIN pe e USING (horse_id) WHERE atg_id LIKE 'x:%' AND st_id IS NOT NULL AND date_of_birth IS NOT NULL GROUP BY h.horse_id HAVING min(e.race_date) - any_value(h.date_of_birth) > 6570)
SELECT count(*) "count", coalesce(sum((SELECT count(*) FROM pe e WHERE e.horse_id = p.horse_id AND e.race_date - p.dob > 6570)), 0)::BIGINT entries FROM p""")
def audit_a(spark: SparkSession, d: str) -> DataFrame:
    return A.polluted(HORSE.df(spark), ENTRY.df(spark))


@_pure("audit_b", [HORSE, ENTRY], f""", p AS (SELECT a.horse_id a, b.horse_id b FROM ph a JOIN ph b ON regexp_matches(a.atg_id, '^[0-9]+$') AND TRY_CAST(a.atg_id AS INT) <> 0 AND b.atg_id LIKE 'x:%' AND {_nn('a.name')} = {_nn('b.name')} AND {_nn('a.name')} <> '' AND (a.birth_country = b.birth_country OR a.birth_country IS NULL OR b.birth_country IS NULL))
SELECT count(*) "count", coalesce(sum((SELECT count(*) FROM pe e WHERE e.horse_id IN (p.a, p.b))), 0)::BIGINT entries FROM p""")
def audit_b(spark: SparkSession, d: str) -> DataFrame:
    return A.real_and_synthetic(HORSE.df(spark), ENTRY.df(spark))


@_pure("audit_c_pedigree", [HORSE], f"""SELECT count(*) "count", NULL::BIGINT entries FROM (SELECT 1 FROM ph WHERE name IS NOT NULL AND date_of_birth IS NOT NULL AND sire_name IS NOT NULL AND dam_name IS NOT NULL GROUP BY {_nn('name')}, year(date_of_birth), {_nn('sire_name')}, {_nn('dam_name')} HAVING count(*) > 1)""")
def audit_c_pedigree(spark: SparkSession, d: str) -> DataFrame:
    return A.same_pedigree(HORSE.df(spark))


@_pure("audit_c_loose", [HORSE], f"""SELECT count(*) "count", NULL::BIGINT entries FROM (SELECT 1 FROM ph WHERE atg_id LIKE 'x:%' GROUP BY {_nn('name')} HAVING count(*) > 1)""")
def audit_c_loose(spark: SparkSession, d: str) -> DataFrame:
    return A.synthetic_namesakes(HORSE.df(spark))


@_pure("audit_d", [HORSE, ENTRY], """SELECT count(*) "count", 0::BIGINT entries FROM ph h WHERE NOT EXISTS (SELECT 1 FROM pe e WHERE e.horse_id = h.horse_id) AND st_id IS NOT NULL AND atg_id IS NULL""")
def audit_d(spark: SparkSession, d: str) -> DataFrame:
    return A.never_entered(HORSE.df(spark), ENTRY.df(spark))


@_pure("audit_e", [HORSE], """SELECT 'registration' AS "key", coalesce((SELECT sum(c) FROM (SELECT count(*) c FROM ph WHERE registration IS NOT NULL GROUP BY registration HAVING count(*) > 1)), 0)::BIGINT AS "rows" UNION ALL SELECT 'ueln', coalesce((SELECT sum(c) FROM (SELECT count(*) c FROM ph WHERE ueln IS NOT NULL GROUP BY ueln HAVING count(*) > 1)), 0)::BIGINT""")
def audit_e(spark: SparkSession, d: str) -> DataFrame:
    return A.repeated_keys(HORSE.df(spark), ["registration", "ueln"])


@_pure("audit_f", [RACE, ENTRY], """, g AS (SELECT track_id, race_date, race_number FROM pr WHERE track_id IS NOT NULL AND race_number IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) "count", coalesce(sum((SELECT count(*) FROM pe e JOIN pr r USING (race_id) WHERE r.track_id = g.track_id AND r.race_date = g.race_date AND r.race_number = g.race_number)), 0)::BIGINT entries FROM g""")
def audit_f(spark: SparkSession, d: str) -> DataFrame:
    return A.repeated_races(RACE.df(spark), ENTRY.df(spark))


@_pure("audit_g", [PERSON], """SELECT (SELECT count(*) FROM pp a JOIN pp b ON regexp_matches(a.atg_id, '^[0-9]+$') AND TRY_CAST(a.atg_id AS INT) <> 0 AND b.atg_id LIKE 'x:%' AND upper(a.name) = upper(b.name) AND a.person_id <> b.person_id) "count", (SELECT count(*) FROM pp WHERE atg_id LIKE 'x:%' AND st_id IS NULL) orphans""")
def audit_g(spark: SparkSession, d: str) -> DataFrame:
    return A.synthetic_people(PERSON.df(spark))


@_pure("audit_h", [TRACK], """SELECT count(*) "count", NULL::BIGINT entries FROM (SELECT 1 FROM pt GROUP BY lower(name), country HAVING count(*) > 1)""")
def audit_h(spark: SparkSession, d: str) -> DataFrame:
    return A.repeated_tracks(TRACK.df(spark))


@_pure("audit_i", [HORSE, ENTRY], """SELECT count(*) "count", NULL::BIGINT entries FROM ph h WHERE atg_id LIKE 'x:%' AND st_id IS NULL AND EXISTS (SELECT 1 FROM pe e WHERE e.horse_id = h.horse_id)""")
def audit_i(spark: SparkSession, d: str) -> DataFrame:
    return A.foreign_only(HORSE.df(spark), ENTRY.df(spark))


@_pure("audit_same_row", [HORSE, ENTRY], """SELECT count(*) "count", coalesce(sum((SELECT count(*) FROM pe e WHERE e.horse_id = h.horse_id)), 0)::BIGINT entries FROM ph h WHERE st_id IS NOT NULL AND atg_id LIKE 'x:%'""")
def audit_same_row(spark: SparkSession, d: str) -> DataFrame:
    return A.two_ids_in_a_row(HORSE.df(spark), ENTRY.df(spark))


@query("SELECT merge_id, loser, keeper, reason, method, entries_moved, conflicts_resolved, merged_at, merged_by, rolled_back FROM horse_merge_log ORDER BY merged_at DESC NULLS LAST, merge_id DESC LIMIT 20")
def recent_merges(spark: SparkSession, d: str) -> DataFrame:
    from paddock.runtime import table

    return A.latest(table(spark, d, "horse_merge_log")).select("merge_id", "loser", "keeper", "reason", "method", "entries_moved", "conflicts_resolved", "merged_at", "merged_by", "rolled_back")


@_pure("misjoined_races", [RACE, ENTRY], """, j AS (SELECT r.race_id, count(DISTINCT CASE WHEN e.primary_source = 'st' THEN e.entry_id END) one_n, count(DISTINCT CASE WHEN e.primary_source = 'atg' THEN e.entry_id END) other_n, count(DISTINCT CASE WHEN placement_text = '1' THEN primary_source END) winners FROM pr r JOIN pe e USING (race_id) WHERE st_race_id IS NOT NULL AND atg_race_id IS NOT NULL GROUP BY r.race_id)
SELECT race_id, one_n, other_n, CASE WHEN winners > 1 THEN 'two winners' ELSE 'no common horse' END why FROM j WHERE one_n > 0 AND other_n > 0 AND (winners > 1 OR NOT EXISTS (SELECT 1 FROM pe a JOIN pe b ON a.race_id = b.race_id AND a.horse_id = b.horse_id WHERE a.race_id = j.race_id AND a.primary_source = 'st' AND b.primary_source = 'atg'))""")
def misjoined_races(spark: SparkSession, d: str) -> DataFrame:
    return R.misjoined(RACE.df(spark), ENTRY.df(spark))


@_pure("stub_races", [RACE, ENTRY], """, n AS (SELECT race_id, count(*) n FROM pe GROUP BY race_id)
SELECT s.race_id stub_race_id, r.race_id real_race_id, count(DISTINCT a.horse_id) shared FROM pr s JOIN n sn ON sn.race_id = s.race_id JOIN pe a ON a.race_id = s.race_id JOIN pe b ON b.horse_id = a.horse_id JOIN pr r ON r.race_id = b.race_id AND r.race_date = s.race_date AND r.race_id <> s.race_id JOIN n rn ON rn.race_id = r.race_id
WHERE s.track IN ('France', 'USA') AND r.track NOT IN ('France', 'USA') AND sn.n <= 5 AND rn.n > sn.n GROUP BY ALL""")
def stub_races(spark: SparkSession, d: str) -> DataFrame:
    """Real races of stub races on placeholder tracks, by the horses they share that day."""
    return R.stub_links(RACE.df(spark), ENTRY.df(spark), F.col("track").isin("France", "USA"), 5)


@_pure("track_match", [TRACK, NAMES], """SELECT n.row_id, CASE WHEN n.country IS NULL THEN (SELECT track_id FROM pt WHERE lower(pt.name) = lower(n.name) ORDER BY country NULLS LAST, track_id LIMIT 1)
ELSE coalesce((SELECT min(track_id) FROM pt WHERE lower(pt.name) = lower(n.name) AND pt.country = n.country), (SELECT min(track_id) FROM pt WHERE lower(pt.name) = lower(n.name) AND pt.country IS NULL)) END track_id FROM pn n WHERE track_id IS NOT NULL""")
def track_match(spark: SparkSession, d: str) -> DataFrame:
    return R.matched_tracks(NAMES.df(spark), TRACK.df(spark))


TIMED = Planted("pk", "row_id int, race_id int, post int, name string", [(1, 1, 1, "x"), (2, 1, 9, "FACE TIME"), (3, 2, 9, "nobody"), (4, None, 1, "Old Ghost"), (5, 4, None, "JOSH")])


@_pure("post_else_name", [TIMED, ENTRY], """SELECT row_id, coalesce(a, b) entry_id, CASE WHEN a IS NOT NULL THEN 'post' WHEN b IS NOT NULL THEN 'name' END how FROM (SELECT row_id, (SELECT min(entry_id) FROM pe WHERE pe.race_id = pk.race_id AND pe.post = pk.post) a, (SELECT min(entry_id) FROM pe WHERE pe.race_id = pk.race_id AND lower(pe.name) = lower(pk.name)) b FROM pk)""")
def post_else_name(spark: SparkSession, d: str) -> DataFrame:
    return R.post_else_name(TIMED.df(spark), ENTRY.df(spark))


REDIRECTS = Planted("pd", "source string, source_key string, to_id int", [("atg", "900", 4), ("synth", "900", 5), ("synth", "x:FR:GONE", 3), ("st", "x:FR:GONE", 2)])
ASKED = Planted("pq", "row_id int, source string, source_key string", [(1, "atg", "900"), (2, "st", "900"), (3, "atg", "x:FR:GONE"), (4, "st", "x:FR:GONE"), (5, "st", "none")])


@_pure("redirect_precedence", [REDIRECTS, ASKED], """SELECT row_id, to_id FROM (SELECT q.row_id, r.to_id, row_number() OVER (PARTITION BY q.row_id ORDER BY r.source = 'synth', r.to_id) rn FROM pq q JOIN pd r ON r.source_key = q.source_key AND r.source IN (q.source, 'synth')) WHERE rn = 1""")
def redirect_precedence(spark: SparkSession, d: str) -> DataFrame:
    return R.first_redirect(ASKED.df(spark), REDIRECTS.df(spark), "row_id", "source", "source_key")


KNOWN = Planted(
    "kn", "horse_id int, source string, source_id string, registration_number string, name string, birth_year int, sire_name string, dam_name string",
    [(1, "st", "11", "r1", "Alpha", 2010, "S", "D"), (1, "atg", "21", "r1", "Alpha", 2010, "S", "D"), (2, "st", "12", None, "Beta", 2011, "S", "D"), (3, "st", "13", None, "Beta", 2011, "S", "D"), (4, "atg", "x:FR:GAMMA", None, "Gamma", 2012, None, None), (5, "st", "15", None, "Delta", 2013, "T", "E")],
)
COMING = Planted(
    "cm", "row_id int, source string, source_id string, registration_number string, name string, country string, birth_year int, sire_name string, dam_name string, race_id int, program_number int",
    [
        (1, "atg", "900", None, "Alpha", "SE", None, None, None, None, None), (2, "atg", "21", None, "Alpha", "SE", None, None, None, None, None), (3, "hvt", "77", "r1", "Alpha", "SE", None, None, None, None, None),
        (4, "atg", None, None, "Alpha", "SE", None, None, None, 7, 3), (5, "letrot", None, None, "DÉLTA*", "SE", 2013, "T", "E", None, None), (6, "letrot", None, None, "Beta", "SE", 2011, "S", "D", None, None), (7, "atg", "", None, "Gone", "FR", None, None, None, None, None),
        (8, "atg", None, None, "Gamma", "fr", None, None, None, None, None), (9, "atg", "x:FR:NEW", None, "New", "FR", None, None, None, None, None), (10, "atg", None, None, "new", "FR", None, None, None, 9, 9), (11, "atg", None, None, None, "FR", None, None, None, None, None),
    ],
)
PLACED = Planted("pl", "race_id int, program_number int, horse_id int", [(7, 3, 2), (8, 1, 1)])


@_pure("resolve_horse", [KNOWN, COMING, PLACED, REDIRECTS], f""", c AS (SELECT *, CASE WHEN source_id <> '' AND source_id NOT LIKE 'x:%' THEN source_id END sid, CASE WHEN {_nn('name')} <> '' THEN 'x:' || upper(coalesce(country, '??')) || ':' || {_nn('name')} END syn FROM cm),
f AS (SELECT row_id, source, coalesce(sid, syn) k, CASE WHEN sid IS NOT NULL THEN (SELECT to_id FROM pd WHERE source_key = sid AND pd.source IN (c.source, 'synth') ORDER BY pd.source = 'synth' LIMIT 1) END r,
CASE WHEN sid IS NOT NULL THEN (SELECT min(horse_id) FROM kn WHERE kn.source = c.source AND kn.source_id = sid) END i, CASE WHEN sid IS NOT NULL THEN (SELECT min(horse_id) FROM kn WHERE kn.registration_number = c.registration_number) END g,
CASE WHEN sid IS NULL THEN (SELECT min(horse_id) FROM pl WHERE pl.race_id = c.race_id AND pl.program_number = c.program_number) END x,
CASE WHEN sid IS NULL THEN (SELECT CASE WHEN count(DISTINCT horse_id) = 1 THEN min(horse_id) END FROM kn WHERE {_nn('kn.name')} = {_nn('c.name')} AND kn.birth_year = c.birth_year AND {_nn('kn.sire_name')} = {_nn('c.sire_name')} AND {_nn('kn.dam_name')} = {_nn('c.dam_name')} AND {_nn('c.sire_name')} <> '' AND {_nn('c.dam_name')} <> '') END p,
CASE WHEN sid IS NULL THEN (SELECT to_id FROM pd WHERE source_key = syn AND pd.source IN (c.source, 'synth') ORDER BY pd.source = 'synth' LIMIT 1) END sr, CASE WHEN sid IS NULL THEN (SELECT min(horse_id) FROM kn WHERE kn.source = c.source AND kn.source_id = syn) END sy FROM c)
SELECT row_id, coalesce(r, i, g, x, p, sr, sy, CASE WHEN k IS NOT NULL THEN (SELECT max(horse_id) FROM kn) + dense_rank() OVER (PARTITION BY coalesce(r, i, g, x, p, sr, sy) IS NULL AND k IS NOT NULL ORDER BY source, k) END)::INT horse_id,
CASE WHEN r IS NOT NULL THEN 'redirect' WHEN i IS NOT NULL THEN 'id' WHEN g IS NOT NULL THEN 'registration' WHEN x IS NOT NULL THEN 'race' WHEN p IS NOT NULL THEN 'pedigree' WHEN sr IS NOT NULL THEN 'synth_redirect' WHEN sy IS NOT NULL THEN 'synth' WHEN k IS NOT NULL THEN 'insert' END how FROM f""")
def resolve_horse(spark: SparkSession, d: str) -> DataFrame:
    """Every incoming record's horse, known or new; the new ones' order among themselves is free, so it is made the SQL's."""
    got = R.resolved(COMING.df(spark), KNOWN.df(spark), REDIRECTS.df(spark), PLACED.df(spark))
    from pyspark.sql import Window

    key = COMING.df(spark).select("row_id", "source", F.coalesce(F.when((F.col("source_id") != "") & ~F.col("source_id").startswith("x:"), F.col("source_id")), F.upper("name")).alias("k"))
    new = F.col("how") == "insert"
    ranked = F.dense_rank().over(Window.partitionBy(new).orderBy("source", "k"))
    last = F.min(F.when(new, F.col("horse_id"))).over(Window.partitionBy()) - 1
    return got.join(key, "row_id").select("row_id", F.when(new, last + ranked).otherwise(F.col("horse_id")).cast("int").alias("horse_id"), "how")


_START = "entry_id int, placement int, time_seconds double, odds double, prize_kr bigint, age int, sex string, shoe_code string, sulky string, post int, time_text string, withdrawn boolean, galopp boolean, primary_source string"
KEEP = Planted("mk", f"pair int, is_french boolean, {_START}", [
    (1, False, 1, 3, None, 5.0, 0, 4, "H", None, "RED", None, "a", False, None, "st"), (2, True, 2, 2, 74.4, None, 500, None, None, "1", "VA", 3, None, True, False, "st"), (3, True, 3, None, 74.4, 7.0, 900, 5, "H", "4", None, 3, "b", None, None, "atg"),
    (4, False, 4, 1, 70.0, 7.0, 900, 5, "H", "4", None, 3, "b", None, None, "st"), (5, False, 5, None, None, None, None, None, None, None, "", None, None, None, None, None),
])
LOSE = Planted("ml", f"pair int, {_START}", [
    (1, 11, 2, 74.0, 6.0, 700, 5, "V", "2", "HY", 7, "c", True, None, "atg"), (2, 12, 2, 75.0, 9.0, 400, 6, "V", "1", "BLUE", 4, "d", None, None, "letrot"), (3, 13, 4, 76.0, 8.0, 800, 6, "S", "3", "AM", None, "b", None, True, "letrot"),
    (4, 14, 9, 71.5, 8.0, 900, 6, "S", "3", "AM", 3, None, None, False, "hvt"), (5, 15, None, None, None, None, None, None, None, None, None, None, None, None, None),
])


def _either(c: str) -> str:
    return f"(coalesce(k.{c}, false) OR coalesce(l.{c}, false)) {c}"


@_pure("entry_merge", [KEEP, LOSE], f"""SELECT k.pair, coalesce(k.post, l.post) post, coalesce(k.time_text, l.time_text) time_text, {_either('withdrawn')}, {_either('galopp')},
CASE WHEN k.placement IS NULL THEN l.placement WHEN l.placement IS NULL OR k.placement = l.placement THEN k.placement WHEN l.time_seconds IS NOT NULL AND k.time_seconds IS NULL THEN l.placement ELSE k.placement END placement, coalesce(k.time_seconds, l.time_seconds) time_seconds,
CASE WHEN k.odds IS NULL OR (k.odds <> l.odds AND l.primary_source = 'atg' AND k.primary_source <> 'atg') THEN l.odds ELSE k.odds END odds, greatest(coalesce(k.prize_kr, 0), coalesce(l.prize_kr, 0)) prize_kr,
CASE WHEN k.age IS NULL OR (k.age <> l.age AND CASE WHEN is_french THEN l.primary_source = 'letrot' AND k.primary_source <> 'letrot' ELSE l.primary_source = 'atg' AND k.primary_source <> 'atg' END) THEN l.age ELSE k.age END age,
CASE WHEN k.sex IS NULL OR (k.sex <> l.sex AND CASE WHEN is_french THEN l.primary_source = 'letrot' AND k.primary_source <> 'letrot' ELSE l.primary_source = 'atg' AND k.primary_source <> 'atg' END) THEN l.sex ELSE k.sex END sex,
coalesce(k.shoe_code, l.shoe_code) shoe_code, CASE WHEN k.shoe_code <> l.shoe_code THEN l.shoe_code END shoe_stashed,
CASE WHEN nullif(k.sulky, '') IS NULL THEN nullif(l.sulky, '') WHEN l.sulky IN ('VA', 'AM', 'HY', 'BG') AND k.sulky NOT IN ('VA', 'AM', 'HY', 'BG') THEN l.sulky ELSE k.sulky END sulky,
CASE WHEN k.time_seconds IS NULL AND l.time_seconds IS NULL THEN 'both_null' WHEN k.time_seconds IS NULL THEN 'loser' WHEN l.time_seconds IS NULL THEN 'keeper' WHEN k.time_seconds = l.time_seconds THEN 'equal' WHEN abs(k.time_seconds - l.time_seconds) <= 1 THEN 'keeper_close' ELSE 'keeper_disagree' END time_decision,
(k.placement <> l.placement AND (k.time_seconds IS NULL) = (l.time_seconds IS NULL)) IS TRUE placement_disagrees FROM mk k JOIN ml l USING (pair)""")
def entry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two rows of one start merged column by column, with what was decided on the time."""
    fields = [f.split()[0] for f in _START.split(", ")]
    k = KEEP.df(spark).select("pair", "is_french", F.struct(*fields).alias("k"))
    m = M.merged(k.join(LOSE.df(spark).select("pair", F.struct(*fields).alias("l")), "pair"))
    return m.select("pair", "post", "time_text", "withdrawn", "galopp", "placement", "time_seconds", "odds", "prize_kr", "age", "sex", "shoe_code", "shoe_stashed", "sulky", F.col("decisions")["time_seconds"].alias("time_decision"), F.array_contains("disagreements", "placement").alias("placement_disagrees"))


CURRENT = Planted("cu", "id int, name string, birth_country string, primary_source string", [(1, "A", None, "atg"), (2, "B", "SE", "usta"), (3, "C", "SE", "atg"), (4, None, "NO", None), (5, "E", "FI", "st")])
INCOMING = Planted("ic", "id int, name string, birth_country string, primary_source string", [(1, "A2", "SE", "st"), (2, "B2", None, "st"), (3, None, "FR", "kmtid"), (4, "D2", None, "kmtid")])
_ORDER = "['usta', 'st', 'letrot', 'hvt', 'atg', 'breedly', 'kmtid']"


@_pure("priority_overwrite", [CURRENT, INCOMING], f""", j AS (SELECT c.*, i.name n2, i.birth_country c2, i.primary_source s2, i.id IS NOT NULL AS came, c.primary_source IS NULL OR c.primary_source = i.primary_source OR list_position({_ORDER}, i.primary_source) < list_position({_ORDER}, c.primary_source) wins FROM cu c LEFT JOIN ic i USING (id))
SELECT id, CASE WHEN wins THEN coalesce(n2, name) ELSE coalesce(name, n2) END AS "name", CASE WHEN wins THEN coalesce(c2, birth_country) ELSE coalesce(birth_country, c2) END birth_country, CASE WHEN came AND wins THEN s2 ELSE primary_source END primary_source FROM j""")
def priority_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Rows of other sources written over current ones by rank of source."""
    rank = lambda side: I.priority(F.col(f"{side}.primary_source"), "horse")
    return M.overwritten(CURRENT.df(spark), INCOMING.df(spark), "id", ["name", "birth_country"], rank("k"), rank("l"))


SHARING = Planted(
    "sh", "entry_id int, horse_id int, driver_id int, primary_source string",
    [(i, 1000 + i % 35, 1, "atg") for i in range(40)] + [(100 + i, 1000 + i, 2, "letrot") for i in range(35)] + [(200 + i, 1000 + i, 3, "letrot") for i in range(12)] + [(300 + i, 2000 + i, 4, "atg") for i in range(32)]
    + [(400 + i, 2000 + i, 5, "letrot") for i in range(32)] + [(500 + i, 2000 + i, 6, "letrot") for i in range(31)] + [(600, 1000, None, "atg"), (601, None, 1, "letrot")],
)
_SHARED = "a AS (SELECT DISTINCT horse_id, driver_id p FROM sh WHERE primary_source = 'atg' AND driver_id IS NOT NULL), l AS (SELECT DISTINCT horse_id, driver_id p FROM sh WHERE primary_source = 'letrot' AND driver_id IS NOT NULL), s AS (SELECT a.p person_id, l.p other_id, count(*) shared FROM a JOIN l USING (horse_id) WHERE a.p <> l.p GROUP BY 1, 2)"


@_pure("cooccurrence", [SHARING], f", {_SHARED} SELECT * FROM s WHERE shared >= 10")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Drivers of two sources with at least ten horses in common."""
    return R.shared_horses(SHARING.df(spark), "driver_id", "atg", "letrot", 10)


@_pure("mutual_best", [SHARING], f""", {_SHARED}, t AS (SELECT * FROM s WHERE shared >= 30), r AS (SELECT *, (SELECT max(shared) FROM t x WHERE x.person_id = t.person_id AND x.other_id <> t.other_id) a, (SELECT max(shared) FROM t x WHERE x.other_id = t.other_id AND x.person_id <> t.person_id) b FROM t)
SELECT person_id, other_id, shared FROM r WHERE coalesce(a, 0) < shared * 0.5 AND coalesce(b, 0) < shared * 0.5""")
def mutual_best(spark: SparkSession, d: str) -> DataFrame:
    """Drivers of two sources who are each other's best match, without a close second."""
    return R.same_people(SHARING.df(spark), "driver_id", "atg", "letrot")


RESULTS = Planted(
    "rs", "entry_id bigint, race_id int, horse_id int, program_number int, post int, placement int, placement_text string, withdrawn boolean, galopp boolean, disqualified boolean, time_seconds double, source_data string",
    [
        (1, 1, 1, 1, 1, 1, "1", False, False, False, 74.0, "{}"), (2, 1, 2, 2, 2, None, "k", False, False, False, 75.5, "{}"), (3, 1, 3, 3, 3, None, None, False, False, False, 75.0, "{}"), (4, 1, 4, 4, 4, None, None, True, False, False, 75.1, "{}"),
        (5, 2, 5, 1, 1, None, "3", False, False, False, 74.0, "{}"), (6, 2, 6, 2, 2, 1, "0", False, False, False, None, "{}"), (7, 2, 7, 3, 3, 4, "g", False, None, False, 76.0, "{}"), (8, 2, 8, 4, 4, None, "g", False, True, False, 76.0, "{}"),
        (9, 3, 9, 1, None, 1, "1", False, False, False, None, "{}"), (10, 3, 10, 2, None, 2, "2", False, False, False, None, "{}"), (11, 4, 11, 1, None, None, None, False, False, False, 74.0, "{}"), (12, 4, 12, 9, None, None, None, None, False, False, 75.0, "{}"),
        (13, 5, 13, 1, 1, None, "utg", True, False, False, 77.0, '{"letrot": {"km_time_text": "1 17"}}'), (14, 5, 13, 2, 2, 1, "1", False, False, False, 73.0, "{}"), (15, 5, 15, 3, 3, 7, "7", True, False, False, None, '{"letrot": {}}'), (16, 5, 16, 4, 4, 12, "2e", False, False, False, 75.0, "cut off {"),
    ],
)


@_pure("repair_placement", [RESULTS], """, t AS (SELECT *, CASE WHEN regexp_matches(placement_text, '^[1-9][0-9]?$') AND placement_text::INT BETWEEN 1 AND 15 THEN placement_text::INT ELSE placement END p FROM rs), m AS (SELECT *, max(p) OVER (PARTITION BY race_id) top FROM t), z AS (SELECT *, CASE WHEN placement_text = '0' AND p = 1 AND top > 1 THEN NULL ELSE p END q FROM m)
SELECT entry_id, placement old, q placement FROM z WHERE placement IS DISTINCT FROM q""")
def repair_placement(spark: SparkSession, d: str) -> DataFrame:
    from paddock.plans.repairs import placements_repaired

    return placements_repaired(RESULTS.df(spark))


@_pure("rank_continuation", [RESULTS], """, x AS (SELECT race_id, coalesce(max(placement), 0) top FROM rs GROUP BY race_id) SELECT r.entry_id, (x.top + row_number() OVER (PARTITION BY r.race_id ORDER BY time_seconds, r.entry_id))::INT placement FROM rs r JOIN x USING (race_id) WHERE r.placement IS NULL AND time_seconds BETWEEN 60 AND 100 AND NOT withdrawn""")
def rank_continuation(spark: SparkSession, d: str) -> DataFrame:
    from paddock.plans.features import ranks_continued

    return ranks_continued(RESULTS.df(spark))


@_pure("repair_galopp_text", [RESULTS], "SELECT entry_id, placement::VARCHAR placement_text, true galopp FROM rs WHERE placement_text = 'g' AND placement >= 1")
def repair_galopp_text(spark: SparkSession, d: str) -> DataFrame:
    """Starts that broke gait and kept a place: the place as text, the break as flag."""
    return RESULTS.df(spark).where("placement_text = 'g' and placement >= 1").select("entry_id", F.col("placement").cast("string").alias("placement_text"), F.lit(True).alias("galopp"))


@_pure("repair_withdrawn", [RESULTS], "SELECT entry_id, false withdrawn FROM rs WHERE withdrawn AND time_seconds IS NOT NULL AND CASE WHEN json_valid(source_data) THEN json_extract(source_data, '$.letrot') IS NOT NULL ELSE false END")
def repair_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    """Starts marked withdrawn whose French source timed them."""
    named = F.map_contains_key(F.from_json("source_data", "map<string,string>"), "letrot")
    return RESULTS.df(spark).where(F.col("withdrawn") & F.col("time_seconds").isNotNull() & F.coalesce(named, F.lit(False))).select("entry_id", F.lit(False).alias("withdrawn"))


@_pure("incomplete_results", [RESULTS], """, g AS (SELECT race_id, count(*) FILTER (NOT coalesce(withdrawn, false)) n_run, count(placement) n_place, count(post) n_post, count(*) FILTER (NOT coalesce(withdrawn, false) AND NOT coalesce(galopp, false) AND NOT coalesce(disqualified, false)) n_clean,
count(*) FILTER (time_seconds IS NOT NULL AND NOT coalesce(withdrawn, false) AND NOT coalesce(galopp, false) AND NOT coalesce(disqualified, false)) n_timed FROM rs GROUP BY race_id)
SELECT race_id, n_place > 0 AND n_clean >= 2 AND n_timed = 0 missing_times, n_run >= 2 AND n_post = 0 missing_posts FROM g WHERE missing_times OR missing_posts""")
def incomplete_results(spark: SparkSession, d: str) -> DataFrame:
    """Races whose times or posts are missing altogether."""
    not_ = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    clean = not_("withdrawn") & not_("galopp") & not_("disqualified")
    n = lambda c: F.count(F.when(c, 1))
    g = RESULTS.df(spark).groupBy("race_id").agg(n(not_("withdrawn")).alias("run"), F.count("placement").alias("placed"), F.count("post").alias("posts"), n(clean).alias("clean"), n(clean & F.col("time_seconds").isNotNull()).alias("timed"))
    return g.select("race_id", ((F.col("placed") > 0) & (F.col("clean") >= 2) & (F.col("timed") == 0)).alias("missing_times"), ((F.col("run") >= 2) & (F.col("posts") == 0)).alias("missing_posts")).where("missing_times or missing_posts")


@_pure("placement_text_disagrees", [RESULTS], "SELECT entry_id, placement, placement_text FROM rs WHERE regexp_matches(placement_text, '^[1-9][0-9]?$') AND TRY_CAST(placement_text AS INT) BETWEEN 1 AND 15 AND placement IS DISTINCT FROM TRY_CAST(placement_text AS INT)")
def placement_text_disagrees(spark: SparkSession, d: str) -> DataFrame:
    """Placement numbers that disagree with their text."""
    n = F.col("placement_text").try_cast("int")
    return RESULTS.df(spark).where(F.col("placement_text").rlike("^[1-9][0-9]?$") & n.between(1, 15) & ~F.col("placement").eqNullSafe(n)).select("entry_id", "placement", "placement_text")


@_pure("horse_twice_in_race", [RESULTS], "SELECT race_id, horse_id, count(*) n FROM rs GROUP BY ALL HAVING count(*) > 1")
def horse_twice_in_race(spark: SparkSession, d: str) -> DataFrame:
    return RESULTS.df(spark).dropna(subset=["race_id", "horse_id"]).groupBy("race_id", "horse_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@_pure("dirty_results", [RESULTS], "SELECT entry_id FROM rs WHERE regexp_matches(placement_text, '^[0-9]+e$') OR (placement_text IS NULL AND time_seconds IS NOT NULL)")
def dirty_results(spark: SparkSession, d: str) -> DataFrame:
    """Results in a foreign form: ordinal places, times without text."""
    return RESULTS.df(spark).where(F.col("placement_text").rlike("^[0-9]+e$") | (F.col("placement_text").isNull() & F.col("time_seconds").isNotNull())).select("entry_id")


@query("SELECT horse_id FROM horse WHERE regexp_matches(lower(name), '^(ej färdigreg|ej fardigreg|ej regist|unnamed|no name|sans nom|ohne name|namnlös|namnlos|nimeton)') UNION ALL SELECT -1")
def placeholder_names(spark: SparkSession, d: str) -> DataFrame:
    """Horses whose name says that there is none yet; a planted one has the id -1."""
    from paddock.runtime import table

    planted = spark.createDataFrame([(-1, "Unnamed 7"), (-2, "Named")], "horse_id int, name string")
    return table(spark, d, "horse").select("horse_id", "name").unionByName(planted).where(is_placeholder(F.col("name"))).select("horse_id")
