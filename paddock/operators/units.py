"""Quantities stated in other units and scales, or only in a text, in common units.

The prize of a row is what its text says, else its original amount and currency; the time is what
its text says, else the one scale in which the number is a plausible time. Texts are read by the
shape parser once per distinct shape; the arithmetic on rows is built-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.unitparse import read_shape
from paddock.operators import intervals
from paddock.operators.standing import standing
from paddock.runtime import cut, join_sized

# The keys under which sources state prizes and times.
PRIZE_KEYS = ["prize_txt", "prize", "gain", "gewinn", "purse", "money"]
TIME_KEYS = ["time_txt", "km", "red_km", "zeit", "mile", "km_time"]
#: Seconds a kilometre that a trotting time can be; the prior by which bare numbers are read.
PLAUSIBLE = (60.0, 100.0)
#: A number within this of the stated time is the same time, rounded.
SAME_TIME = 0.06
#: A dictionary of shapes up to this many rows is broadcast, a larger one is joined by salted keys.
BROADCAST_ROWS = 20_000

READING = "form string, groups int, decimals int, exponent int, currency string, per string"


def shape_of(text: Column) -> Column:
    """A text with every digit of its numbers as 9; digits of an exponent such as e-2 stay."""
    return F.regexp_replace(text, r"(?<!e-)(?<![eE])[0-9]", "9")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for field, shape in zip(b.field, b.shape_, strict=True):
            r = read_shape(shape, field)
            rows.append((field, shape, r.form, r.groups, r.decimals, r.exponent, r.currency, r.per) if r else (field, shape, None, None, None, None, None, None))
        yield pd.DataFrame(rows, columns=["field", "shape_", "form", "groups", "decimals", "exponent", "currency", "per"]).astype({"groups": "Int32", "decimals": "Int32", "exponent": "Int32"})


def read_texts(texts: DataFrame) -> DataFrame:
    """Adds the reading of ``text`` in ``field`` (money or time) to rows; unread ones are dropped.

    Each distinct shape is parsed once. Texts that are null, empty or state no quantity of the
    field's dimension give no row.
    """
    shaped = texts.where("length(trim(text)) > 0").withColumn("shape_", shape_of(F.col("text")))
    known = cut(shaped.select("field", "shape_").distinct().mapInPandas(_parse, "field string, shape_ string, " + READING), "shapes")
    return join_sized(shaped, known, ["field", "shape_"], F.col("entry_id"), BROADCAST_ROWS).where("form is not null").drop("shape_").withColumn("digits", F.expr("regexp_extract_all(text, '([0-9]+)', 1)"))


def amount_of() -> Column:
    """The number a money text states, in units of its currency."""
    whole = F.array_join(F.slice("digits", 1, F.col("groups")), "").try_cast("decimal(24,0)")
    power = F.col("exponent") - F.col("decimals")
    return F.when(power < 0, whole / F.expr("cast(pow(10, decimals - exponent) as decimal(8,0))")).otherwise(whole * F.expr("cast(pow(10, exponent - decimals) as decimal(8,0))")).cast("decimal(24,6)")


def seconds_per_km(distance: Column) -> Column:
    """Seconds a kilometre that a time text states, given the distance run where it needs it."""
    at = lambda i: F.try_element_at("digits", F.lit(i)).try_cast("double")
    part = lambda i: at(i) / F.pow(F.lit(10.0), F.length(F.try_element_at("digits", F.lit(i))))
    run = F.when(F.col("form") == "clock", at(1) * 60 + at(2) + part(3)).when(F.col("form") == "short", 60 + at(1) + part(2)).otherwise(at(1) + part(2))
    over = F.when(F.col("per") == "stated", at(-1)).when(F.col("per") == "whole", distance).when(F.col("per") == "mile", F.lit(1609.344)).otherwise(F.lit(1000.0))
    return run * 1000 / F.when(over > 0, over)


def plausible_time(number: Column) -> Column:
    """A bare number as seconds a km in the one scale that makes it plausible, else null.

    Scales: minutes, milliseconds, and minute, seconds and tenths written as one number.
    """
    fits = lambda c: c.between(*PLAUSIBLE)
    packed = F.floor(number / 1000) * 60 + F.pmod(number, F.lit(1000.0)) / 10
    return (
        F.when(F.isnan(number) | (number <= 0), None).when(fits(number), number).when(fits(number * 60) & (number < 2), F.round(number * 60, 1))
        .when(fits(number / 1000), number / 1000).when(number.between(1000, 1999) & (number == F.floor(number)) & fits(packed), packed)
    )


def in_kronor(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``kronor`` (rounded half up) to rows with ``amount``, ``ccy`` and ``race_date``.

    Foreign money takes the rate of the latest rate day not after the race day; without one, or
    without a race day, kronor is null. Crowns need no rate and are not shuffled.
    """
    home, foreign = amounts.where("ccy = 'SEK'"), amounts.where("ccy <> 'SEK'").withColumn("day", F.unix_date("race_date"))
    by_day = rates.where("ccy is not null and rate_date is not null and sek_per_unit is not null").groupBy("ccy", F.unix_date("rate_date").alias("start")).agg(F.max("sek_per_unit").alias("rate"))
    nxt = by_day.select("ccy", "rate", "start", F.lead("start").over(Window.partitionBy("ccy").orderBy("start")).alias("stop")).withColumns({"known": F.col("start"), "replaced": F.col("stop")})
    valid = intervals.as_known(foreign, nxt, ["ccy"], "day", "start", "stop", "known", "replaced", ["start"], ["rate"])
    foreign = foreign.join(valid, ["ccy", "day"], "left").withColumn("kronor", F.round(F.col("amount") * F.col("rate"), 0).cast("long")).drop("day", "rate")
    return home.withColumn("kronor", F.round("amount", 0).cast("long")).unionByName(foreign)


def stated(entry: DataFrame) -> DataFrame:
    """Standing rows with the text that states each field's quantity, where there is one."""
    e = standing(entry, "race_date", "distance", "prize_kr", "prize_currency", "prize_original", "prize_fx_rate", "time_seconds", "time_text", "source_data")
    blocks = F.map_values(F.from_json("source_data", "map<string,string>"))
    pairs = F.flatten(F.transform(blocks, lambda b: F.map_entries(F.from_json(b, "map<string,string>"))))
    e = e.withColumn("said", F.filter(pairs, lambda p: p.isNotNull()))
    # of several the one whose key comes first in the list of keys, then the least text
    rank = lambda keys, key: F.array_position(F.array(*map(F.lit, keys)), key)
    pick = lambda keys: F.array_min(F.transform(F.filter("said", lambda p: p["key"].isin(keys) & p["value"].isNotNull()), lambda p: F.struct(rank(keys, p["key"]).alias("at"), p["value"].alias("value"))))["value"]
    prize = pick(PRIZE_KEYS)
    record = F.from_json(prize, "amount string, unit string, ccy string, exp string")
    plain = F.concat_ws(" ", record["amount"], record["unit"], record["ccy"], F.concat(F.lit("e"), record["exp"]))
    prize = F.when(prize.startswith("{"), plain).otherwise(prize)
    has = F.coalesce(F.col("time_text").rlike("[0-9]"), F.lit(False))
    return e.select(
        "entry_id", "race_date", "distance", "prize_kr", F.upper(F.trim("prize_currency")).alias("prize_currency"), "prize_original", "prize_fx_rate", "time_seconds",
        prize.alias("prize_text"), F.when(has, F.col("time_text")).otherwise(pick(TIME_KEYS)).alias("time_text"),
    )


def restated(entry: DataFrame, rates: DataFrame) -> DataFrame:
    """Cases ``(entry_id, field_name, amount)`` where a row states another prize or time than its number.

    ``prize_kr``: whole kronor; ``time_seconds``: tenths of a second a kilometre. Rows that state
    nothing, whose text cannot be read, whose number is meaningless or already right give no row.
    Repeated deliveries count once. An empty table gives no rows.
    """
    rows = cut(stated(entry), "stated").df
    texts = rows.select("*", F.explode(F.array(F.struct(F.lit("money").alias("field"), F.col("prize_text").alias("text")), F.struct(F.lit("time").alias("field"), F.col("time_text").alias("text")))).alias("t")).select(*rows.columns, "t.*")
    read = read_texts(texts)
    money = read.where("field = 'money'")
    crowns = F.when(F.col("prize_currency").isin("NOK", "DKK"), F.col("prize_currency")).otherwise("SEK")
    by_text = money.select("entry_id", "race_date", "prize_kr", F.when(F.col("currency") == "kr", crowns).otherwise(F.col("currency")).alias("ccy"), amount_of().alias("amount"))
    # without a text, a foreign amount that was never converted
    raw = rows.where("prize_text is null and prize_currency <> 'SEK' and prize_fx_rate is null and prize_currency is not null")
    own = F.when(F.col("prize_original") > 0, F.col("prize_original")).otherwise(F.col("prize_kr")).cast("decimal(24,6)")
    by_column = raw.select("entry_id", "race_date", "prize_kr", F.col("prize_currency").alias("ccy"), own.alias("amount")).where("amount > 0")
    prizes = in_kronor(by_text.unionByName(by_column), rates).where("kronor is not null and not (kronor <=> prize_kr) and not (kronor = 0 and prize_kr is null)")
    # with one, the text; the number beside it only has to agree
    said = read.where("field = 'time'").select("entry_id", "time_seconds", seconds_per_km(F.col("distance").cast("double")).alias("time"))
    bare = rows.where("time_text is null and time_seconds is not null").select("entry_id", "time_seconds", plausible_time(F.col("time_seconds")).alias("time"))
    times = said.unionByName(bare).where(F.col("time").isNotNull() & F.coalesce(F.isnan("time_seconds") | (F.abs(F.col("time_seconds") - F.col("time")) > SAME_TIME), F.lit(True)))
    return prizes.select("entry_id", F.lit("prize_kr").alias("field_name"), F.col("kronor").alias("amount")).unionByName(
        times.select("entry_id", F.lit("time_seconds").alias("field_name"), F.round(F.col("time") * 10, 0).cast("long").alias("amount"))
    )
