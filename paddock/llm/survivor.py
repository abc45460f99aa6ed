"""The best representative of each duplicate group, built field by field.

Every real value a row states is a claim of that row's source. A latent model with two sides
judges the claims: a source's sensitivity is how often it states a value that is true, its
specificity how often it keeps from stating one that is false where another source does. Both and
the probability of each value are inferred by expectation-maximisation over value counts, never
over rows on the driver. Every source has its own quality, however many there are; rows that name
none speak as one. A single-valued field survives by the declared order of trust, or by
probability where none is declared; a multi-valued field keeps every value judged true.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.runtime import Cut, cut, join_sized

# What stands for unknown, by field, and how sources spell themselves.
UNKNOWN_NAMES = ["", "-", "?", "N.N.", "NN", "N N", "OKÄND", "OKAND", "UNKNOWN", "UNBEKANNT", "INCONNU", "UKENDT", "UKJENT", "NULL", "NONE"]
UNKNOWN_DATES = ["1900-01-01", "1910-11-12", "1970-01-01", "2099-12-31"]
UNKNOWN_CODES = ["", "-", "?", "--", "??", "XX", "X", "UNKNOWN", "NULL", "NONE"]
TRUST = ["usta", "st", "letrot", "hvt", "atg", "breedly", "kmtid"]
SOURCE_NAMES = {"travsport": "st", "svensktravsport": "st"}
EXTRACTED = "2025-01-31"

NAMES, DATES, CODES = ["name", "sire_name", "dam_name"], ["date_of_birth"], ["gender_code", "birth_country"]
FIELDS = ["name", "date_of_birth", "gender_code", "birth_country", "sire_name", "dam_name"]
#: Rounds of expectation-maximisation; the model has two numbers a source and settles quickly.
EM_ROUNDS = 8
#: Patterns and members of sets of sources up to which the model is fitted on the driver; beyond it executors fit the same.
DRIVER_FIT = 500_000


def real_name(c: Column) -> Column:
    return F.when(~F.upper(F.trim(c)).isin(UNKNOWN_NAMES) & c.rlike(r"\p{L}"), F.trim(c))


def real_date(c: Column) -> Column:
    return F.when(~c.cast("string").isin(UNKNOWN_DATES) & (c <= F.lit(EXTRACTED).cast("date")), c.cast("string"))


def real_code(c: Column) -> Column:
    return F.when(~F.upper(F.trim(c)).isin(UNKNOWN_CODES) & c.rlike(r"\p{L}"), F.upper(F.trim(c)))


def source_of(primary: Column, data: Column) -> Column:
    """A row's source in one spelling; where it is missing, the one source its data names."""
    letters = F.regexp_replace(F.lower(primary), "[^a-z]", "")
    spelled = F.create_map(*(F.lit(x) for kv in SOURCE_NAMES.items() for x in kv))
    keys = F.filter(F.regexp_extract_all(data, F.lit(r'"([a-z]+)"\s*:\s*\{'), F.lit(1)), lambda k: k.isin(TRUST))
    named = F.when(F.size(F.array_distinct(keys)) == 1, keys[0])
    return F.coalesce(F.when(letters != "", F.coalesce(F.try_element_at(spelled, letters), letters)), named)


def claims(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, row_id, field_name, value, key, source, seen)``: the real values of grouped rows.

    ``key`` is the value by which claims agree (names without case, accents kept). Times missing or
    after the extraction count as oldest (null). Rows of groups with fewer than two rows are left
    out. Any column may be null; a row id that occurs twice speaks twice with one voice.
    """
    seen = F.when(F.col("last_updated_at") < F.expr(f"cast(date'{EXTRACTED}' + 1 as timestamp_ntz)"), F.col("last_updated_at"))
    real = {**{c: real_name(F.col(c)) for c in NAMES}, **{c: real_date(F.col(c)) for c in DATES}, **{c: real_code(F.col(c)) for c in CODES}}
    own = rows.where("horse_id is not null").select(F.col("horse_id").alias("row_id"), source_of(F.col("primary_source"), F.col("source_data")).alias("source"), seen.alias("seen"), *(c.alias(k) for k, c in real.items()))
    met = own.join(groups.select(F.col("id").alias("row_id"), "group_id"), "row_id")
    several = met.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(several, "group_id", "left_semi")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS))).alias("x")
    said = met.select("group_id", "row_id", "source", "seen", each).select("group_id", "row_id", "source", "seen", "x.*").where("value is not null")
    return said.withColumn("key", F.upper(F.regexp_replace("value", r"[\s*]+", " ")))


def judge(said: DataFrame, rounds: int = EM_ROUNDS) -> tuple[DataFrame, dict[tuple[str, str | None], tuple[float, float]]]:
    """Probability that each claimed value of a group and field is true, and each source's quality.

    Returns ``(group_id, field_name, key, p)`` and, by field and source, sensitivity and
    specificity (source None: the rows that name none). A source that speaks of a field in a group
    but not for a value speaks against it.
    """
    beliefs, quality = _judged(said, rounds)
    return beliefs, {(r.field_name, r.source): (r.sens, r.spec) for r in quality.collect()}


def _judged(said: DataFrame, rounds: int = EM_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """:func:`judge` with the quality ``(field_name, source, sens, spec)`` as a table.

    Values with the same supporters in groups where the same sources speak are one pattern; the
    model is fitted on patterns and their counts. A pattern names its two sets of sources and a set
    is held once, so both together are never more than the claims.
    """
    ident = lambda: F.xxhash64(F.array_sort(F.collect_set(F.struct("source"))))  # noqa: E731  # structs keep the missing source
    pro = said.groupBy("group_id", "field_name", "key").agg(ident().alias("pro"), F.collect_set(F.struct("source")).alias("members"))
    votes = cut(pro, "votes").df
    spoke = cut(said.groupBy("group_id", "field_name").agg(ident().alias("spoke"), F.collect_set(F.struct("source")).alias("members")), "spoke").df
    values = cut(votes.drop("members").join(spoke.drop("members"), ["group_id", "field_name"]), "values").df
    patterns = cut(values.groupBy("field_name", "pro", "spoke").agg(F.count(F.lit(1)).cast("double").alias("n")), "patterns")
    sets = votes.select("field_name", F.col("pro").alias("set"), "members").unionByName(spoke.select("field_name", F.col("spoke").alias("set"), "members"))
    members = cut(sets.groupBy("field_name", "set").agg(F.any_value("members").alias("members")).select("field_name", "set", F.explode("members.source").alias("source")), "members")
    fit = _fitted if patterns.seen["rows"] + members.seen["rows"] <= DRIVER_FIT else _fitted_apart
    known, quality = fit(patterns, members, rounds)
    return join_sized(values, known, ["field_name", "pro", "spoke"], F.col("group_id")).select("group_id", "field_name", "key", "p"), quality


def _fitted(patterns: Cut, members: Cut, rounds: int) -> tuple[Cut, DataFrame]:
    """Probabilities ``(field_name, pro, spoke, p)`` of all patterns and the quality of the sources, fitted on the driver."""
    spark = patterns.df.sparkSession
    rows, held = patterns.df.toPandas().sort_values(["field_name", "pro", "spoke"]), members.df.toPandas()
    told, quality = [], []
    for field, own in rows.groupby("field_name"):
        of = held[held.field_name == field]
        sets, place = np.unique(of["set"].to_numpy(), return_inverse=True)
        names = sorted(of.source.unique(), key=lambda x: (x is None, x or ""))
        source = of.source.map({x: i for i, x in enumerate(names)}).to_numpy()
        pro, spoke, n = np.searchsorted(sets, own.pro), np.searchsorted(sets, own.spoke), own.n.to_numpy()
        said = lambda x, place=place, source=source, m=len(sets): np.bincount(place, x[source], m)  # noqa: E731  # sums over the sources of each set
        by = lambda at, x, place=place, source=source, m=len(sets), k=len(names): np.bincount(source, np.bincount(at, x, m)[place], k)
        sens, spec, prior = np.full(len(names), 0.9), np.full(len(names), 0.8), 0.6
        for left in range(rounds, -1, -1):
            a, b = np.clip(sens, 0.001, 0.999), np.clip(spec, 0.001, 0.999)
            against = np.log((1 - a) / b)
            odds = np.log(prior / (1 - prior)) + said(against)[spoke] + said(np.log(a / (1 - b)) - against)[pro]
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if not left:
                break
            true, false = n * p, n * (1 - p)
            lies = by(spoke, false)
            sens, spec = (by(pro, true) + 9) / (by(spoke, true) + 10), (lies - by(pro, false) + 8) / (lies + 10)
            prior = min(0.99, max(0.01, true.sum() / n.sum()))
        told += zip(own.field_name, own.pro.tolist(), own.spoke.tolist(), p.tolist(), strict=True)
        quality += [(field, x, float(y), float(z)) for x, y, z in zip(names, sens, spec, strict=True)]
    known = cut(spark.createDataFrame(told, "field_name string, pro bigint, spoke bigint, p double"), "known")
    return known, spark.createDataFrame(quality, "field_name string, source string, sens double, spec double")


def _fitted_apart(patterns: Cut, members: Cut, rounds: int) -> tuple[Cut, DataFrame]:
    """The same as :func:`_fitted` on the executors: sets, patterns and sources stay tables."""
    null = F.lit("\x00")  # a source that is not named joins as one
    held = members.df.withColumn("source", F.coalesce("source", null))
    quality = cut(held.select("field_name", "source").distinct().withColumns({"sens": F.lit(0.9), "spec": F.lit(0.8)}), "quality")
    prior = patterns.df.select("field_name").distinct().withColumn("prior", F.lit(0.6))
    a, b = (F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col(c))) for c in ("sens", "spec"))
    for left in range(rounds, -1, -1):
        against = F.sum(F.log((1 - a) / b))
        sums = cut(join_sized(held, quality, ["field_name", "source"], F.col("set")).groupBy("field_name", "set").agg(against.alias("against"), (F.sum(F.log(a / (1 - b))) - against).alias("more")), "sums")
        met = join_sized(patterns.df, Cut(sums.df.select("field_name", F.col("set").alias("spoke"), "against"), sums.path, sums.seen), ["field_name", "spoke"], F.col("pro"))
        met = join_sized(met, Cut(sums.df.select("field_name", F.col("set").alias("pro"), "more"), sums.path, sums.seen), ["field_name", "pro"], F.col("spoke"))
        odds = F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("against") + F.col("more")
        p = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), odds))))
        known = cut(met.join(F.broadcast(prior), "field_name").select("field_name", "pro", "spoke", "n", p.alias("p")), "known")  # a row a field
        if not left:
            break
        true, false, none = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p")), F.lit(0.0)
        sides = known.df.select("field_name", F.explode(F.array(F.struct(F.col("pro").alias("set"), true.alias("tp"), false.alias("fp"), none.alias("t"), none.alias("f")), F.struct(F.col("spoke").alias("set"), none.alias("tp"), none.alias("fp"), true.alias("t"), false.alias("f")))).alias("x"))
        weights = cut(sides.select("field_name", "x.*").groupBy("field_name", "set").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "t", "f"))), "weights")
        said = join_sized(held, weights, ["field_name", "set"], F.col("source")).groupBy("field_name", "source").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "t", "f")))
        quality = cut(said.select("field_name", "source", ((F.col("tp") + 9) / (F.col("t") + 10)).alias("sens"), ((F.col("f") - F.col("fp") + 8) / (F.col("f") + 10)).alias("spec")), "quality")
        prior = cut(known.df.groupBy("field_name").agg(F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.sum(true) / F.sum("n"))).alias("prior")), "prior").df
    return Cut(known.df.drop("n"), known.path, known.seen), quality.df.withColumn("source", F.when(F.col("source") != null, F.col("source")))


def survivors(said: DataFrame, trust: list[str] | None = TRUST, known: tuple | None = None) -> DataFrame:
    """The surviving claim of each group and field: ``group_id, field_name, row_id, value, source, p``.

    With a declared order of ``trust`` the most trusted source wins (others after it), then the
    latest time, then the smallest row id; without one the most probable value does, then the
    same. Every claim carries the probability the model gives its value.
    """
    beliefs, _ = known or _judged(said)
    met = said.join(beliefs, ["group_id", "field_name", "key"])
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, trust)), F.col("source")), F.lit(0)) if trust else F.lit(1)
    rank = F.when(rank > 0, rank).otherwise(len(trust or []) + 1)
    quiet = F.coalesce(F.col("seen"), F.expr("timestamp_ntz'0001-01-01 00:00:00'"))
    lead = [-rank] if trust else [F.round("p", 6)]
    best = F.max_by(F.struct("row_id", "value", "source", "p"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate([*lead, quiet, -F.col("row_id")]))))
    return met.groupBy("group_id", "field_name").agg(best.alias("x")).select("group_id", "field_name", "x.*")


def kept_values(said: DataFrame, known: tuple | None = None, least: float = 0.5) -> DataFrame:
    """All values judged true of each group and field, for fields that may hold several."""
    beliefs, _ = known or _judged(said)
    one = said.groupBy("group_id", "field_name", "key").agg(F.min("value").alias("value"), F.countDistinct("row_id").alias("rows"))
    return one.join(beliefs, ["group_id", "field_name", "key"]).where(F.col("p") >= least).select("group_id", "field_name", "value", "rows", "p")
