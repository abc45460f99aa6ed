"""Texts, JSON and money as sources write them, parsed by built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import parse
from paddock.operators.predicates import count_if
from paddock.plans.base import E, fact, query
from paddock.runtime import table


@query(r"SELECT DISTINCT time_text, CASE WHEN regexp_matches(trim(time_text), '^\*?(?:(\d+)[.,])?(\d{1,2}),(\d)[a-zA-Z]*$') THEN coalesce(TRY_CAST(nullif(regexp_extract(trim(time_text), '^\*?(?:(\d+)[.,])?(\d{1,2}),(\d)', 1), '') AS INT), 1) * 1000 + regexp_extract(trim(time_text), '^\*?(?:(\d+)[.,])?(\d{1,2}),(\d)', 2)::INT * 10 + regexp_extract(trim(time_text), '^\*?(?:(\d+)[.,])?(\d{1,2}),(\d)', 3)::INT END AS code FROM entry WHERE time_text IS NOT NULL")
def parse_km_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry").where("time_text is not null").select("time_text").distinct().select("time_text", parse.km_time(F.col("time_text")).alias("code"))


_PRIZE = """p AS (SELECT entry_id, coalesce(json_extract_string(source_data, '$.st.prize_txt'), json_extract_string(source_data, '$.atg.prize')) txt FROM (SELECT * FROM entry WHERE json_valid(source_data) QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY last_updated_at DESC) = 1))"""


@query(f"WITH {_PRIZE} SELECT txt, TRY_CAST(nullif(regexp_replace(regexp_extract(replace(replace(txt, chr(160), ' '), '.', ' '), '[\\d\\s]+'), '\\s', '', 'g'), '') AS BIGINT) kr, count(*) n FROM p WHERE txt IS NOT NULL GROUP BY ALL")
def parse_money(spark: SparkSession, d: str) -> DataFrame:
    """First amount in every prize text of the two sources that write one."""
    txt = F.coalesce(F.get_json_object("source_data", "$.st.prize_txt"), F.get_json_object("source_data", "$.atg.prize"))
    e = table(spark, d, "entry").where("source_data is not null").groupBy("entry_id").agg(F.max_by("source_data", "last_updated_at").alias("source_data"))
    return e.select(txt.alias("txt")).where("txt is not null").groupBy("txt", parse.money_kr(F.col("txt")).alias("kr")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, i::INT AS line, TRY_CAST(regexp_extract(x, '(\d+)/(\d+)', 1) AS INT) AS position, TRY_CAST(regexp_extract(x, '(\d+)/(\d+)', 2) AS INT) AS distance FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) i, unnest(l) x FROM (SELECT doc_id, regexp_extract_all(text, '\d+/\d{4}') l FROM documents))")
def parse_position(spark: SparkSession, d: str) -> DataFrame:
    """Every 'position/distance' in the texts of start lists."""
    found = F.expr("regexp_extract_all(text, '\\\\d+/\\\\d{4}', 0)")
    each = table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("i", "x"))
    p = parse.position_distance(F.col("x"))
    return each.select("doc_id", (F.col("i") + 1).alias("line"), p["position"].alias("position"), p["distance"].alias("distance"))


@query("SELECT DISTINCT sex_text, CASE WHEN lower(trim(sex_text)) IN ('mare', 'sto', 'femelle', 'f') THEN 'S' WHEN lower(trim(sex_text)) IN ('stallion', 'hingst', 'male', 'mâle', 'entier') THEN 'H' WHEN lower(trim(sex_text)) IN ('gelding', 'valack', 'hongre', 'g', 'v') THEN 'V' END sex FROM horse_raw")
def parse_sex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse_raw").select("sex_text").distinct().select("sex_text", parse.sex_hvs(F.col("sex_text")).alias("sex"))


@query("SELECT DISTINCT country_text, CASE WHEN regexp_matches(upper(trim(country_text)), '^[A-Z]{2}$') THEN upper(trim(country_text)) END country FROM horse_raw")
def parse_country(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse_raw").select("country_text").distinct().select("country_text", parse.country(F.col("country_text")).alias("country"))


@query(r"SELECT raw_id, CASE WHEN regexp_matches(date_of_birth, '(\d{2})\.(\d{2})\.(\d{4})') THEN TRY_CAST(regexp_extract(date_of_birth, '(\d{2})\.(\d{2})\.(\d{4})', 3) || '-' || regexp_extract(date_of_birth, '(\d{2})\.(\d{2})\.(\d{4})', 2) || '-' || regexp_extract(date_of_birth, '(\d{2})\.(\d{2})\.(\d{4})', 1) AS DATE) END born FROM horse_raw")
def parse_german_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse_raw").select("raw_id", parse.german_date(F.col("date_of_birth")).alias("born"))


@query("SELECT DISTINCT placement_text, coalesce(regexp_matches(upper(trim(placement_text)), '^(DA|DM|DAI|D[0-9]?)$'), false) galopp, coalesce(regexp_matches(upper(trim(placement_text)), '^(DA|DM|DAI|D[0-9]?)$') OR upper(trim(placement_text)) IN ('A', 'T'), false) disqualified, coalesce(upper(trim(placement_text)) = 'NP', false) withdrawn FROM entry")
def parse_rank_codes(spark: SparkSession, d: str) -> DataFrame:
    r = parse.french_rank(F.col("placement_text"))
    return table(spark, d, "entry").select("placement_text").distinct().select("placement_text", r["galopp"].alias("galopp"), r["disqualified"].alias("disqualified"), r["withdrawn"].alias("withdrawn"))


@query("WITH k AS (SELECT horse_id, unnest(json_keys(source_data)) src FROM horse WHERE json_valid(source_data)) SELECT src, count(*) n FROM k WHERE NOT starts_with(src, '_') GROUP BY src")
def json_explode(spark: SparkSession, d: str) -> DataFrame:
    """Sources named in the JSON of horses; texts cut off name none."""
    k = table(spark, d, "horse").select(F.explode(F.map_keys(F.from_json("source_data", "map<string,string>"))).alias("src"))
    return k.where(~F.col("src").startswith("_")).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT k.horse_id, unnest(list_distinct(list_concat(coalesce(json_keys(k.source_data), []), coalesce(json_keys(l.source_data), [])))) key FROM (SELECT DISTINCT loser, keeper FROM horse_merge_log WHERE NOT rolled_back AND loser <> keeper) g JOIN horse k ON k.horse_id = g.keeper JOIN horse l ON l.horse_id = g.loser WHERE (json_valid(k.source_data) OR k.source_data IS NULL) AND (json_valid(l.source_data) OR l.source_data IS NULL)) SELECT horse_id, \"key\" FROM m WHERE \"key\" <> 'st'")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the merged JSON of keeper and loser, the keeper's values first, one key removed."""
    g = table(spark, d, "horse_merge_log").where("not rolled_back and loser <> keeper").select("loser", "keeper").distinct()
    fields = F.from_json("source_data", "map<string,string>")
    h = table(spark, d, "horse").where(F.col("source_data").isNull() | fields.isNotNull()).select("horse_id", F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("m"))
    j = g.join(h.select(F.col("horse_id").alias("keeper"), F.col("m").alias("k")), "keeper").join(h.select(F.col("horse_id").alias("loser"), F.col("m").alias("l")), "loser")
    both = F.map_zip_with("k", "l", lambda _, a, b: F.coalesce(a, b))
    return j.select(F.col("keeper").alias("horse_id"), F.explode(F.map_keys(F.map_filter(both, lambda k, _: k != "st"))).alias("key"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) k, count(*) n, sum(value) total FROM events GROUP BY ALL".replace("sum(value) total", "round(sum(value), 4) total"))
def json_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {E} SELECT coalesce(prize_currency, '-') ccy, count(*) n, count(CASE WHEN prize_kr > 0 AND prize_fx_rate IS NULL AND prize_currency <> 'SEK' THEN 1 END) unconverted FROM e GROUP BY ALL")
def fx_completeness(spark: SparkSession, d: str) -> DataFrame:
    e = fact(spark, d, "prize_currency", "prize_kr", "prize_fx_rate")
    return e.groupBy(F.coalesce("prize_currency", F.lit("-")).alias("ccy")).agg(F.count(F.lit(1)).alias("n"), count_if((F.col("prize_kr") > 0) & F.col("prize_fx_rate").isNull() & (F.col("prize_currency") != "SEK")).alias("unconverted"))


@query("SELECT t, n FROM (SELECT 'entry' t, count(*) n FROM entry UNION ALL SELECT 'race', count(*) FROM race UNION ALL SELECT 'horse', count(*) FROM horse UNION ALL SELECT 'track', count(*) FROM track)")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).agg(F.lit(t).alias("t"), F.count(F.lit(1)).alias("n")) for t in ("entry", "race", "horse", "track")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT driver_id person_id FROM entry WHERE driver_id IS NOT NULL UNION SELECT trainer_id FROM entry WHERE trainer_id IS NOT NULL")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entry").select(F.explode(F.array("driver_id", "trainer_id")).alias("person_id"))
    return e.where("person_id is not null").distinct()


@query("SELECT horse_id FROM horse INTERSECT SELECT horse_id FROM entry", name="set_intersect")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse").select("horse_id").intersect(table(spark, d, "entry").select("horse_id"))


@query("SELECT horse_id FROM horse EXCEPT SELECT horse_id FROM entry", name="set_difference")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "horse").select("horse_id").subtract(table(spark, d, "entry").select("horse_id"))
