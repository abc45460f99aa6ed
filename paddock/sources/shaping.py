"""Documents of the sources as rows of races and starts, each source by its own rules.

Documents are parsed by schema inside the engine; a text cut off gives nulls and counts as empty.
People and horses keep the source's ids: resolving them is another step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions import parse

_TIME = "struct<minutes:int,seconds:int,tenths:int>"
BETTING = (
    "struct<sport:string,date:string,number:int,name:string,heading:string,distance:int,startMethod:string,prize:string,terms:array<string>,track:struct<id:int,name:string,countryCode:string>,"
    "result:struct<victoryMargin:string,scratchings:array<int>>,starts:array<struct<number:int,postPosition:int,distance:int,driver:struct<id:string>,"
    "horse:struct<id:string,name:string,age:int,sex:string,trainer:struct<id:string>,shoes:struct<reported:boolean,front:struct<hasShoe:boolean>,back:struct<hasShoe:boolean>>>,"
    f"result:struct<place:int,finishOrder:int,disqualified:boolean,galloped:boolean,scratched:boolean,finalOdds:double,prizeMoney:bigint,kmTime:{_TIME}>>>>"
)
RACEDAY = (
    "struct<raceDate:string,races:array<struct<raceId:int,raceNumber:int,results:array<struct<horse:struct<id:int,name:string>,programNumber:string,placementNumber:string,placementDisplay:string,time:string,"
    "startPositionAndDistance:string>>,prohibitedHorses:array<struct<id:int,name:string,programNumber:string,cause:string>>>>>"
)
COURSE = "struct<race_date:string,race_number:int,runners:array<struct<program_number:int,horse_id:string,distance:int,placement:int,placement_text:string,km_time_text:string,prize_eur:double,musique:string,sex:string>>>"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _km(t: Column, i: str) -> Column:
    return F.coalesce(t[i], F.lit(0))


def betting_races(raw: DataFrame) -> DataFrame:
    """``(race_key, skipped, x)``: parsed race documents of the betting operator and why one is not taken in.

    ``raw`` holds race_key and raw. Reasons, in this order: empty_raw, gallop, no_date_or_starts, no_track.
    """
    x = F.from_json("raw", BETTING)
    p = raw.select("race_key", x.alias("x"))
    day = F.coalesce(parse.iso_date(F.col("x.date")), parse.race_key(F.col("race_key"))["date"])
    why = (
        F.when(F.col("x").isNull() | F.coalesce("x.date", "x.sport", F.col("x.starts").cast("string")).isNull(), "empty_raw").when(F.col("x.sport") == "gallop", "gallop")
        .when(day.isNull() | (F.coalesce(F.size("x.starts"), F.lit(0)) <= 0), "no_date_or_starts").when(F.coalesce("x.track.name", F.col("x.track.id").cast("string")).isNull(), "no_track")
    )
    return p.select("race_key", why.alias("skipped"), day.alias("race_date"), "x")


def betting_starts(raw: DataFrame) -> DataFrame:
    """Starts of the races that :func:`betting_races` takes in; horses without a name are left out."""
    r = betting_races(raw).where("skipped is null").select("race_key", "race_date", "x", F.explode("x.starts").alias("s"))
    res, horse = F.col("s.result"), F.col("s.horse")
    scratched = _yes(F.array_contains("x.result.scratchings", F.col("s.number"))) | _yes(res["scratched"])
    t = res["kmTime"]
    seconds = _km(t, "minutes") * 60 + _km(t, "seconds") + _km(t, "tenths") / 10.0
    short = F.concat_ws(",", _km(t, "seconds").cast("string"), _km(t, "tenths").cast("string"))
    text = F.when(_km(t, "minutes") <= 1, short).otherwise(F.concat_ws(".", (_km(t, "minutes") - 1).cast("string"), short))
    shoes = horse["shoes"]
    return r.where(F.coalesce(horse["name"], F.lit("")) != "").select(
        "race_key", "race_date", F.col("s.number").alias("program_number"), F.col("s.postPosition").alias("post"), F.coalesce(F.when(F.col("s.distance") != 0, F.col("s.distance")), F.col("x.distance")).alias("distance"),
        F.when(res["place"] >= 1, res["place"]).alias("placement"), res["finishOrder"].alias("finish_order"), parse.placement_text(res["place"], res["finishOrder"], res["disqualified"], res["galloped"], scratched).alias("placement_text"),
        scratched.alias("withdrawn"), _yes(res["disqualified"]).alias("disqualified"), _yes(res["galloped"]).alias("galopp"), F.when(t.isNotNull() & (seconds > 0), seconds).alias("time_seconds"), F.when(t.isNotNull() & (seconds > 0), text).alias("time_text"),
        res["finalOdds"].alias("odds"), F.coalesce(res["prizeMoney"], F.lit(0)).alias("prize_kr"), horse["name"].alias("horse_name"), horse["age"].alias("age"), parse.sex_hvs(horse["sex"]).alias("sex"),
        parse.shoe_code(shoes["reported"], shoes["front"]["hasShoe"], shoes["back"]["hasShoe"]).alias("shoe_code"), F.make_date(F.year("race_date") - horse["age"], F.lit(1), F.lit(1)).alias("born_about"),
    )


def raceday_starts(raw: DataFrame) -> DataFrame:
    """Starts of the racedays of the studbook: those with a result, and prohibited horses that did not run as withdrawn.

    A start without a distance takes the most frequent one of its race, the smaller of equals.
    """
    races = raw.select(F.from_json("raw", RACEDAY).alias("x")).select(F.explode("x.races").alias("r"))
    ran = races.select(F.col("r.raceId").alias("race_id"), F.explode("r.results").alias("s")).where("s.horse.id is not null")
    placed, at = parse.classify_placement(F.col("s.placementNumber"), F.col("s.placementDisplay")), parse.position_distance(F.col("s.startPositionAndDistance"))
    broke = parse.broke_gait(F.col("s.time"))
    ran = ran.select(
        "race_id", F.col("s.horse.id").alias("horse_id"), F.col("s.programNumber").try_cast("int").alias("program_number"), at["position"].alias("post"), at["distance"].alias("distance"), placed["placement"].alias("placement"),
        parse.studbook_placement_text(placed["placement"], placed["disqualified"], broke, F.lit(False), F.col("s.placementDisplay")).alias("placement_text"), F.lit(False).alias("withdrawn"), placed["disqualified"].alias("disqualified"), broke.alias("galopp"),
        parse.km_seconds(F.col("s.time")).alias("time_seconds"),
    )
    usual = ran.where("distance is not null").groupBy("race_id", "distance").agg(F.count(F.lit(1)).alias("n")).groupBy("race_id").agg(F.max_by("distance", F.struct("n", -F.col("distance"))).alias("usual"))
    ran = ran.join(usual, "race_id", "left").withColumn("distance", F.coalesce("distance", "usual")).drop("usual")
    out = races.select(F.col("r.raceId").alias("race_id"), F.explode("r.prohibitedHorses").alias("h")).where("h.id is not null")
    out = out.select("race_id", F.col("h.id").alias("horse_id"), F.col("h.programNumber").try_cast("int").alias("program_number")).join(ran.select("race_id", "horse_id"), ["race_id", "horse_id"], "left_anti")
    return ran.unionByName(out.withColumns({"withdrawn": F.lit(True), "placement_text": F.lit("utg")}), allowMissingColumns=True)


def course_starts(raw: DataFrame) -> DataFrame:
    """Starts of French courses in the common form, each with the most frequent distance of its course.

    A runner without time, place, prize and record whose code is 0 never appeared and counts as
    withdrawn; breaking gait is a disqualification there.
    """
    r = raw.select("race_key", F.from_json("raw", COURSE).alias("x")).select("race_key", F.posexplode("x.runners").alias("i", "s"))
    flags = parse.french_rank(F.col("s.placement_text"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    silent = F.col("s.placement").isNull() & (F.col("s.placement_text") == "0") & empty("s.km_time_text") & F.col("s.prize_eur").isNull() & empty("s.musique")
    seconds = parse.french_seconds(F.col("s.km_time_text"))
    usual = r.where("s.distance is not null and s.distance <> 0").groupBy("race_key", F.col("s.distance").alias("d")).agg(F.count(F.lit(1)).alias("n")).groupBy("race_key").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("race_distance"))
    return r.join(usual, "race_key", "left").select(
        "race_key", "race_distance", F.col("s.program_number").alias("program_number"), F.col("s.placement").alias("placement"), parse.swedish_placement(F.col("s.placement_text")).alias("placement_text"), seconds.alias("time_seconds"),
        parse.swedish_time(seconds).alias("time_text"), parse.french_sex(F.col("s.sex")).alias("sex"), (_yes(silent) | flags["withdrawn"]).alias("withdrawn"), (flags["disqualified"] | F.coalesce(F.col("s.km_time_text").isin("DI", "DA"), F.lit(False))).alias("disqualified"), flags["galopp"].alias("galopp"),
    )


def discovered(days: DataFrame, known: DataFrame) -> DataFrame:
    """``(horse_id)``: horses named in racedays that are not known yet."""
    r = days.select(F.from_json("raw", RACEDAY).alias("x")).select(F.explode("x.races").alias("r"))
    named = r.select(F.explode(F.concat(F.coalesce(F.transform("r.results", lambda s: s["horse"]["id"]), F.array().cast("array<int>")), F.coalesce(F.transform("r.prohibitedHorses", lambda h: h["id"]), F.array().cast("array<int>")))).alias("horse_id"))
    return named.where("horse_id is not null").distinct().join(known.select("horse_id"), "horse_id", "left_anti")
