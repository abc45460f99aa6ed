"""Filling fixed-capacity containers with texts, planned over the histogram of lengths.

Best fit decreasing runs on counts: all items of one length are placed together, groups of equal
containers at a time, so the plan depends on the distinct lengths (at most the capacity) and not on
the number of texts. Each text then finds its planned slot by its rank among texts of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.runtime import cut

#: Ranks are counted in this many parts of each length, so that a common length is no single task.
RANK_PARTS = 512
#: Slots of the plan are found by length and blocks of so many ranks.
BLOCK = 1024


@dataclass
class Slot:
    """Ranks ``[start, stop)`` of one length go to containers from ``first`` on, ``each`` to a container."""

    length: int
    start: int
    stop: int
    each: int
    first: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Best-fit-decreasing plan for ``counts`` items of each length; slots and number of containers.

    Lengths lie in 1..capacity. Groups of equal containers are kept by the room left in them.
    """
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room left -> (containers, contents)
    rooms: list[int] = []

    def put(left: int, n: int, contents: tuple) -> None:
        if not room[left]:
            insort(rooms, left)
        room[left].append((n, contents))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                n, contents = room[left].pop()
                if not room[left]:
                    rooms.pop(i)
            else:
                left, n, contents = capacity, None, ()
            fit = left // length
            whole = todo // fit if n is None else min(n, todo // fit)
            if whole:
                put(left - fit * length, whole, (*contents, (length, fit)))
                todo -= whole * fit
            used = whole
            if todo and (n is None or used < n) and todo < fit:
                put(left - todo * length, 1, (*contents, (length, todo)))
                used, todo = used + 1, 0
            if n is not None and used < n:
                put(left, n - used, contents)
    slots, taken, first = [], defaultdict(int), 0
    for left in sorted(room):
        for n, contents in room[left]:
            for length, each in contents:
                slots.append(Slot(length, taken[length], taken[length] + n * each, each, first))
                taken[length] += n * each
            first += n
    return slots, first


def pieces(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_name, capacity, doc_id, piece, length)``: texts, split only where one alone is too long.

    A text longer than the capacity gives whole containers and one rest. Specs without a name or
    a positive capacity are left out; of a repeated name the largest capacity counts.
    """
    known = specs.where("spec_name is not null and capacity_tokens > 0").groupBy("spec_name").agg(F.max("capacity_tokens").cast("bigint").alias("capacity")).collect()
    kinds = F.array(*(F.struct(F.lit(r.spec_name).alias("spec_name"), F.lit(r.capacity).cast("bigint").alias("capacity")) for r in known)) if known else F.array().cast("array<struct<spec_name:string,capacity:bigint>>")
    each = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.explode(kinds).alias("s")).select("doc_id", "tokens", "s.*")
    piece = F.explode(F.when(F.col("tokens") > 0, F.sequence(F.lit(0), F.expr("cast((tokens - 1) div capacity as int)"))).otherwise(F.array(F.lit(0))))
    return each.withColumn("piece", piece).select("spec_name", "capacity", "doc_id", "piece", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).alias("length"))


def packed(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_name, doc_id, piece, tokens, container_id)`` for every text and container size.

    ``sizes`` holds ``doc_id`` and ``tokens``; ``specs`` ``spec_name`` and ``capacity_tokens``.
    Texts without tokens need no room: their container is null. Repeated and null ids are texts
    of their own. Containers of a spec are numbered from 0.
    """
    spark: SparkSession = sizes.sparkSession
    items = pieces(sizes, specs).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)))
    items = cut(items, "pieces").df
    some = items.where("length > 0")
    parts = cut(some.groupBy("spec_name", "capacity", "length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths").df
    histogram: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for r in parts.groupBy("spec_name", "capacity", "length").agg(F.sum("n").alias("n")).collect():  # at most the capacities' sum of rows
        histogram[r.spec_name, r.capacity][r.length] = r.n
    rows = []
    for (name, capacity), counts in histogram.items():
        rows += [(name, s.length, s.start, s.stop, s.each, s.first) for s in plan(counts, capacity)[0]]
    slots = spark.createDataFrame(rows, "spec_name string, length bigint, start bigint, stop bigint, each bigint, first bigint")
    slots = slots.withColumn("block", F.explode(F.sequence(F.expr("start div %d" % BLOCK), F.expr("(stop - 1) div %d" % BLOCK))))

    before = Window.partitionBy("spec_name", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("spec_name", "length", "part", "offset")
    within = Window.partitionBy("spec_name", "length", "part").orderBy("doc_id", "piece")
    ranked = some.withColumn("rn", F.row_number().over(within) - 1).join(offset, ["spec_name", "length", "part"])
    ranked = ranked.withColumn("rank", F.col("rn") + F.col("offset")).withColumn("block", F.expr("rank div %d" % BLOCK))
    met = ranked.join(slots, ["spec_name", "length", "block"]).where("rank >= start and rank < stop")
    placed = met.select("spec_name", "doc_id", "piece", F.col("length").alias("tokens"), F.expr("first + (rank - start) div each").alias("container_id"))
    return placed.unionByName(items.where("length = 0 or length is null").select("spec_name", "doc_id", "piece", F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("container_id")))


def fills(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Texts, tokens and room left of each container."""
    known = specs.where("spec_name is not null").groupBy("spec_name").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    used = placed.where("container_id is not null").groupBy("spec_name", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    return used.join(known, "spec_name").withColumn("room", F.col("capacity") - F.col("tokens")).drop("capacity")
