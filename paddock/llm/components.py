"""Consolidating pairwise matches into groups: connected components of any size and shape.

The component of the busiest vertex is peeled off by breadth-first joins and anti-joined away, so
that the hubs are gone before the rest is labelled by propagating minima. The rest alternates two
star steps, each of which ties every vertex to the smallest id it sees; chains shrink by a factor
in every round, so long ones take a logarithmic number of rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.runtime import Cut, cut

#: Rounds after which a component that is still growing (a long chain) is contracted instead.
FRONTIER_ROUNDS = 12


def links(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs ``(a, b)`` with ``a < b``; rows with a null id or equal ids link nothing."""
    return pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null and a < b").select("a", "b").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The component of the vertex with most links (ties: smallest id), by frontier joins.

    Returns its vertices ``(v)`` with their smallest id ``giant``, the edges outside it, and
    whether the frontier ran dry. If it did not within the rounds allowed, the reached vertices
    are contracted to their smallest id and the edges that lead out of them are kept.
    """
    ways = _both_ways(edges)
    start = ways.groupBy("u").count().orderBy(F.desc("count"), "u").select(F.col("u").alias("v")).limit(1)
    front = cut(start, "front")
    reached, last = [front.df], front.df
    for _ in range(FRONTIER_ROUNDS):
        if not front.seen["rows"]:
            break
        near = ways.join(front.df.withColumnRenamed("v", "u"), "u").select("v").distinct()
        fresh = near.join(front.df, "v", "left_anti").join(last, "v", "left_anti")
        last, front = front.df, cut(fresh, "front")
        reached.append(front.df)
    held = reduce(DataFrame.unionByName, reached)
    giant = held.agg(F.min("v")).first()[0]
    dry = not front.seen["rows"]
    if dry:
        rest = edges.join(held.withColumnRenamed("v", "a"), "a", "left_anti")
    else:
        flag = held.withColumn("in", F.lit(giant))
        moved = edges.join(flag.withColumnRenamed("v", "a").withColumnRenamed("in", "ia"), "a", "left").join(flag.withColumnRenamed("v", "b").withColumnRenamed("in", "ib"), "b", "left")
        rest = links(moved.select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b")), "a", "b")
    return held.withColumn("giant", F.lit(giant)), rest, dry


def _smallest(ways: DataFrame) -> DataFrame:
    return ways.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a vertex to the smallest id around the vertex."""
    ways = _both_ways(edges)
    least = _smallest(ways).select("u", F.least("u", "m").alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties a vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    met = down.join(_smallest(down), "u")
    tied = met.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return tied.where("a < b").distinct()


def _label(edges: DataFrame) -> Cut:
    """Pairs ``(a, b)`` where ``a`` is the smallest id of the component of ``b``."""
    sign = {"sign": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now = cut(edges, "stars", **sign)
    while True:
        after = cut(_small_star(_large_star(now.df)), "stars", **sign)
        before, now = now, after
        same = (before.seen["rows"], before.seen["sign"]) == (now.seen["rows"], now.seen["sign"])
        before.drop()
        if same:
            return now


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``(group_id, id)`` for every id linked with another one; the group's id is its smallest.

    Pairs may come repeated, in any order and direction; pairs with a null or with itself link
    nothing, and an id that occurs only in those has no group. Further columns are ignored. An
    empty table gives an empty result.
    """
    edges = cut(links(pairs, left, right), "links")
    kind = edges.df.schema["a"].dataType
    if not edges.seen["rows"]:
        return edges.df.select(F.col("a").alias("group_id"), F.col("b").alias("id"))
    held, rest, dry = peel(edges.df)
    stars = _label(rest).df
    labels = stars.select(F.col("a").alias("group_id"), F.col("b").alias("id"))
    roots = stars.select(F.col("a").alias("group_id"), F.col("a").alias("id")).distinct()
    found = labels.unionByName(roots)
    if dry:
        giant = held.select(F.col("giant").alias("group_id"), F.col("v").alias("id"))
    else:  # the contracted part takes the label its smallest id was given
        given = held.select(F.col("v").alias("id"), F.col("giant").alias("g")).join(found.select(F.col("id").alias("g"), "group_id"), "g", "left")
        giant = given.select(F.coalesce("group_id", "g").alias("group_id"), "id")
        found = found.join(held.select(F.col("v").alias("id")), "id", "left_anti")
    return found.unionByName(giant).select(F.col("group_id").cast(kind), F.col("id").cast(kind))
