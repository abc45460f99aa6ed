"""Readers of what sources publish: nested JSON, JSON inside scripts, HTML tables, wide CSV, databases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Shapes of the published documents.
CALENDAR = "tracks array<struct<id:int,name:string,countryCode:string,sport:string,races:array<struct<id:string,number:int,status:string,startTime:string>>>>"
RACE = (
    "id string, date string, number int, distance int, startMethod string, status string, track struct<id:int,name:string,countryCode:string>, "
    "starts array<struct<number:int,postPosition:int,distance:int,horse:struct<id:int,name:string,age:int,sex:string,nationality:string>,driver:struct<id:int,firstName:string,lastName:string>,"
    "result:struct<place:int,finishOrder:int,galloped:boolean,disqualified:boolean,kmTime:struct<minutes:int,seconds:int,tenths:int>,finalOdds:double,prizeMoney:bigint>>>"
)


def calendar(days: DataFrame, statuses: list[str]) -> DataFrame:
    """Races of calendar documents (column ``raw``): trotting only, of the given statuses."""
    t = days.select(F.explode(F.from_json("raw", CALENDAR)["tracks"]).alias("t")).where("coalesce(t.sport, 'trot') <> 'gallop'")
    r = t.select(F.col("t.id").alias("track_id"), F.col("t.name").alias("track"), F.explode("t.races").alias("r"))
    return r.where(F.col("r.status").isin(statuses)).select("track_id", "track", F.col("r.id").alias("race_id"), F.col("r.number").alias("number"), F.col("r.status").alias("status"))


def races(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Race rows, start rows and rejected rows with the reason, of race documents ``(race_id, raw)``.

    One bad document stops no other: it is rejected as unreadable, empty, or without date, starts
    or track.
    """
    d = raw.withColumn("x", F.from_json("raw", RACE))
    reason = (
        F.when(F.length(F.trim("raw")) > 0, None).otherwise("empty_raw")
    )
    reason = F.coalesce(reason, F.when(F.col("x").isNull() | F.col("x.id").isNull(), "unreadable"), F.when(F.col("x.date").isNull() | (F.coalesce(F.size("x.starts"), F.lit(0)) <= 0), "no_date_or_starts"), F.when(F.col("x.track.id").isNull(), "no_track"))
    d = d.withColumn("reason", reason)
    good = d.where("reason is null")
    head = good.select("race_id", F.col("x.date").try_cast("date").alias("race_date"), F.col("x.number").alias("race_number"), F.col("x.distance").alias("distance"), F.when(F.col("x.startMethod") == "auto", "A").when(F.col("x.startMethod") == "volte", "V").alias("start_method"), F.col("x.track.id").alias("track_id"))
    s = good.select("race_id", F.explode("x.starts").alias("s"))
    km = F.col("s.result.kmTime")
    starts = s.select(
        "race_id", F.col("s.number").alias("program_number"), F.col("s.postPosition").alias("post"), F.col("s.distance").alias("distance"), F.col("s.horse.id").alias("horse_id"), F.col("s.horse.name").alias("horse"), F.col("s.horse.age").alias("age"),
        F.col("s.driver.id").alias("driver_id"), F.col("s.result.place").alias("placement"), F.col("s.result.finishOrder").alias("finish_order"), F.col("s.result.galloped").alias("galopp"), F.col("s.result.disqualified").alias("disqualified"),
        (km["minutes"] * 60 + km["seconds"] + km["tenths"] / 10).alias("time_seconds"), F.col("s.result.finalOdds").alias("odds"), F.col("s.result.prizeMoney").alias("prize_kr"),
    )
    return head, starts, d.where("reason is not null").select("race_id", "reason")


def balanced(text: str, start: int) -> str | None:
    """The bracketed part that begins at ``start``, strings and escapes respected; None if it never closes."""
    pairs, stack, quoted, i = {"[": "]", "{": "}"}, [], "", start
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = "" if c == quoted else quoted
        elif c in "\"'":
            quoted = c
        elif c in pairs:
            stack.append(pairs[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return text[start : i + 1]
        i += 1
    return None


def scripted_json(pages: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``json``: the array or object assigned to ``name`` in a script, comments removed first."""
    begin, comment = re.compile(rf"\b{re.escape(name)}\s*[=:]\s*(?=[\[{{])"), re.compile(r"/\*.*?\*/", re.S)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for t in b:
                t = comment.sub("", t) if t else ""
                m = begin.search(t)
                out.append(balanced(t, m.end()) if m else None)
            yield pd.Series(out, dtype=object)

    return pages.withColumn("json", F.pandas_udf(find, "string")(text))


class _Cells(HTMLParser):
    """Tables of a page as rows of cell texts."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.inside = True

    def handle_endtag(self, tag: str) -> None:
        self.inside &= tag not in ("td", "th")

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.tables[-1][-1][-1] += data


def html_rows(pages: DataFrame, page_id: str, html: str, headers: list[str]) -> DataFrame:
    """``(page_id, row, cells)`` of the first table whose header holds all ``headers``."""
    kind = pages.schema[page_id].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b[page_id], b[html], strict=True):
                parser = _Cells()
                parser.feed(text or "")
                for t in parser.tables:
                    if t and set(headers) <= {c.strip() for c in t[0]}:
                        out += [(key, i, [" ".join(c.split()) for c in r]) for i, r in enumerate(t[1:])]
                        break
            yield pd.DataFrame(out, columns=[page_id, "row", "cells"])

    return pages.select(page_id, html).mapInPandas(rows, f"{page_id} {kind}, row int, cells array<string>")


def wide_rates(spark: SparkSession, path: str, home: str = "SEK") -> DataFrame:
    """Rates ``(ccy, rate_date, sek_per_unit)`` from a CSV with one column a currency, units per euro.

    The cross rate of a currency is the home rate over its own; the euro's is the home rate.
    """
    wide = spark.read.csv(path, header=True)
    ccy = [c for c in wide.columns if c.strip() not in ("Date", home, "")]
    long = wide.unpivot(["Date", home], ccy, "ccy", "per_euro") if ccy else wide.select("Date", home, F.lit("").alias("ccy"), F.lit(None).alias("per_euro"))
    rate = (F.col(home).try_cast("double") / F.col("per_euro").try_cast("double")).cast("decimal(12,6)")
    out = long.select(F.trim("ccy").alias("ccy"), F.col("Date").try_cast("date").alias("rate_date"), rate.alias("sek_per_unit"))
    euro = wide.select(F.lit("EUR").alias("ccy"), F.col("Date").try_cast("date").alias("rate_date"), F.col(home).try_cast("double").cast("decimal(12,6)").alias("sek_per_unit"))
    return out.unionByName(euro).where("sek_per_unit is not null and rate_date is not null")


def database(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32) -> DataFrame:
    """A query of a database by JDBC, in parts of a numeric key where its bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", 10_000)
    if key and bounds:
        return r.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts).load()
    return r.option("query", query).load()


def chain(links: DataFrame, seeds: list, node: str, following: str, steps: int | None = None) -> DataFrame:
    """Nodes reached from the seeds along ``following``, each once, with the step it was reached at.

    A frontier join a step; a circle ends the walk. A walk that is not over after ``steps``, where
    given, is an error, so that nothing is left out unseen.
    """
    from paddock.runtime import cut

    kind = links.schema[node].dataType.simpleString()
    front = cut(links.sparkSession.createDataFrame([(s,) for s in seeds], f"{node} {kind}").distinct().withColumn("step", F.lit(0)), "walk")
    seen = front.df
    for k in count(1):
        nxt = links.join(front.df.select(node), node).where(F.col(following).isNotNull()).select(F.col(following).alias(node)).distinct()
        front = cut(nxt.join(seen.select(node), node, "left_anti").withColumn("step", F.lit(k)), "walk")
        if not front.seen["rows"]:
            return seen
        if steps is not None and k > steps:
            raise ValueError(f"the walk goes on after {steps} steps")
        seen = seen.unionByName(front.df)
