"""Mixing sources to target weights of tokens, with capped repeats.

Whole copies every text of a source certainly gets are allocated first; what is missing to its
share is drawn by Pareto order sampling: texts are ranked by random odds divided by inclusion odds
and a fixed number of the lowest is taken. Inclusion is proportional to size, within classes of
similar length, so that a fixed number of texts also fixes the tokens closely.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.runtime import cut

#: Length classes to a doubling of length, and parts of the ranking variable's range.
CLASSES, PARTS = 4, 4096
SEED = 42


def source_name(c: Column) -> Column:
    """A source in one spelling: lower case, words joined by underscores; blank is null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain != "", plain)


@dataclass
class Share:
    """What a source gives: whole copies of each text and tokens to be drawn."""

    target: float
    copies: int
    drawn: float


def allocate(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, Share]:
    """Copies and drawn tokens of each source for the largest mixture the repeats allow.

    Sources without tokens or target give nothing and the other targets are scaled up to 1.
    ``total`` asks for a smaller mixture.
    """
    able = {s: (w, r) for s, (w, r) in targets.items() if tokens.get(s, 0) > 0 and w > 0 and r > 0}
    weight = sum(w for w, _ in able.values())
    if not able:
        return {}
    most = min(r * tokens[s] * weight / w for s, (w, r) in able.items())
    size = min(most, total) if total is not None else most
    out = {}
    for s, (w, r) in able.items():
        need = size * w / weight
        copies = min(r, floor(need / tokens[s] + 1e-9))
        out[s] = Share(w / weight, copies, max(0.0, need - copies * tokens[s]) if copies < r else 0.0)
    return out


def draw_numbers(classes: list[tuple[int, int, int]], wanted: float) -> dict[int, tuple[int, float]]:
    """How many texts each length class gives, and the rate of inclusion a token.

    ``classes``: ``(class, texts, tokens)``. A class's texts are included with the rate times
    their size, at most certainly; what rounding leaves over is carried to the next class.
    """
    total = sum(t for _, _, t in classes)
    if wanted <= 0 or not total:
        return {k: (0, 0.0) for k, _, _ in classes}
    low, high = 0.0, 1.0
    for _ in range(60):  # the rate at which the expected tokens are those wanted
        rate = (low + high) / 2
        got = sum(t * min(1.0, rate * t / n) for _, n, t in classes)
        low, high = (rate, high) if got < wanted else (low, rate)
    out, missing = {}, 0.0
    for k, n, t in sorted(classes, reverse=True):
        mean = t / n
        missing += t * min(1.0, high * mean)
        take = max(0, min(n, round(missing / mean)))
        missing -= take * mean
        out[k] = (take, high)
    return out


def mixed(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """``(source, doc_id, tokens, uses)`` for each text of the mixture.

    ``sizes`` holds ``doc_id, source, text_id, tokens``; ``targets`` ``source, target_share,
    max_repeats``. Equal texts count as one text, that of the smallest id and its source, so none
    is used more often than allowed. Texts without tokens and of other sources are not used.
    """
    spark: SparkSession = sizes.sparkSession
    wish = {r.name: (r.w, r.r) for r in targets.withColumn("name", source_name(F.col("source"))).where("name is not null").groupBy("name").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r")).collect()}
    own = sizes.withColumn("source", source_name(F.col("source"))).where(F.col("source").isin(list(wish)) & (F.col("tokens") > 0) & F.col("text_id").isNotNull())
    texts = own.groupBy("text_id").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x")).select("x.*")
    level = F.floor(F.log2(F.col("tokens").cast("double")) * CLASSES).cast("int")
    texts = cut(texts.withColumn("class", level), "texts").df
    held = texts.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()  # sources x classes
    tokens: dict[str, int] = {}
    for r in held:
        tokens[r.source] = tokens.get(r.source, 0) + r.t
    shares = allocate(tokens, wish, total)
    rows = []
    for s, share in shares.items():
        numbers = draw_numbers([(r["class"], r.n, r.t) for r in held if r.source == s], share.drawn)
        rows += [(s, k, share.copies, take, rate) for k, (take, rate) in numbers.items()]
    strata = cut(spark.createDataFrame(rows, "source string, class int, copies int, take bigint, rate double"), "strata").df
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    p = F.least(F.col("rate") * F.col("tokens"), F.lit(1 - 1e-9))
    odds = (u / (1 - u)) / (F.greatest(p, F.lit(1e-12)) / (1 - p))
    ranked = texts.join(F.broadcast(strata), ["source", "class"]).withColumn("q", odds / (1 + odds)).withColumn("part", F.least(F.floor(F.col("q") * PARTS), F.lit(PARTS - 1)).cast("int"))
    ranked = cut(ranked, "ranked").df
    upto = Window.partitionBy("source", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.where("take > 0").groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    met = ranked.join(filled, ["source", "class", "part"], "left").withColumn("left_over", F.col("take") - F.col("before"))
    sure = met.withColumn("in", (F.coalesce("left_over", F.lit(0)) >= F.coalesce("n", F.lit(1))).cast("int"))
    edge = (F.col("left_over") > 0) & (F.col("left_over") < F.col("n"))
    tie = Window.partitionBy("source", "class", "part").orderBy("q", "doc_id")
    last = sure.where(edge).withColumn("in", (F.row_number().over(tie) <= F.col("left_over")).cast("int"))
    whole = sure.where(~F.coalesce(edge, F.lit(False)))
    return whole.unionByName(last).select("source", "doc_id", "tokens", (F.col("copies") + F.col("in")).alias("uses")).where("uses > 0")


def reached(mix: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share, texts, uses and tokens of each target source."""
    used = mix.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens_used"))
    wish = targets.withColumn("source", source_name(F.col("source"))).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    all_used = mix.agg(F.sum(F.col("uses") * F.col("tokens")).alias("t")).first()["t"] or 0
    zero = F.lit(0).cast("bigint")
    out = wish.join(used, "source", "left")
    return out.select("source", "target_share", *(F.coalesce(c, zero).alias(c) for c in ("texts", "uses", "most_uses", "tokens_used")), F.round(F.coalesce("tokens_used", zero) / F.lit(max(all_used, 1)), 6).alias("actual_share"))
