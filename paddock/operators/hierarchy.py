"""Parent-child links as nested-set forests, and the cycles that are no forest.

Sizes of subtrees are summed upward, sibling ranges are allocated downward by prefix sums, and a
node's range then holds exactly its descendants; roots and depths come down with the ranges. Nodes
whose climb the upward pass never finishes hang on cycles. Both passes double the distance they span
in each round, so their number is the logarithm of the height, and they touch only inner nodes:
leaves take theirs from the parent.

Links of several kinds mixed give nodes more than one parent. There the upward pass is a peeling:
what no order of work reaches holds the cycles, which are split by the least ids leading to and from
each node; and descendants are gathered downward, a generation a round, once cycles are one node each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.intervals import stab
from paddock.runtime import Cut, cut, keep_until_exit, shared_dir

#: Siblings are split into this many buckets, so that no parent's children meet in one task.
SIBLING_BUCKETS = 1024
#: Steps of peeling planned together before their result is written.
STEPS = 2
#: Links that one task settles colours among.
LINKS_A_TASK = 200_000
#: Peeling goes on while a round leaves no larger share of the links than this.
WORTH_PEELING = 0.8
#: Parts that the children of one parent are spread over where its ancestors are sent to them.
SENDING_SALTS = 32


def valid_links(nodes: DataFrame, node: str, parents: dict[str, str]) -> DataFrame:
    """Rows ``(tree, node, parent)``: one link of each kind and node whose parent is a node.

    ``parents`` maps a tree's name to the column holding its parent id. Rows without a node id
    are left out; of repeated node ids the smallest parent counts; a parent id without a row is
    no link. Other columns of ``nodes`` are ignored, whatever their names.
    """
    base = nodes.select(F.col(node).alias("node"), *(F.col(c).alias(f"p_{t}") for t, c in parents.items()))
    base = base.where("node is not null").groupBy("node").agg(*(F.min(f"p_{t}").alias(f"p_{t}") for t in parents))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.col(f"p_{t}").alias("parent")) for t in parents)))
    links = base.select("node", each.alias("e")).select("e.tree", "node", "e.parent").where("parent is not null")
    return links.join(base.select(F.col("node").alias("parent")), "parent", "left_semi").select("tree", "node", "parent")


def nested_sets(links: DataFrame, with_path: bool = False) -> DataFrame:
    """The forest of ``links`` (from :func:`valid_links`) as nested sets.

    Returns ``(tree, node, parent, root, depth, start, size[, path])`` for every node that takes
    part in a link and whose climb ends. ``[start, start + size)`` holds the starts of the node
    and its descendants; ``path`` runs from the root to the node. Nodes on or below a cycle have
    no climb that ends and are absent. No links give an empty result.
    """
    links = cut(links, "links").df
    kids = links.groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    leaves = links.join(kids, ["tree", "node"], "left_anti")
    own = leaves.groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    inner = kids.join(links.withColumnRenamed("parent", "up"), ["tree", "node"], "left").join(own, ["tree", "node"], "left")
    state = inner.select(
        "tree", "node", "up", F.col("up").alias("parent"), (F.coalesce("n", F.lit(0)) + 1).alias("size"),
    )
    climbing = F.count("up")
    now, open_before = cut(state, "up", climbing=climbing), None
    while now.seen["climbing"] not in (0, open_before):
        at, above = now.df.alias("a"), now.df.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2")).alias("b")
        below = now.df.where("up is not null").groupBy(F.col("tree").alias("t"), F.col("up").alias("n")).agg(F.sum("size").alias("more")).alias("m")
        met = at.join(below, (F.col("a.tree") == F.col("m.t")) & (F.col("a.node") == F.col("m.n")), "left").drop("t", "n")
        gained = met.select("tree", "node", "up", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        rising = gained.where("up is not null").join(above, (F.col("tree") == F.col("b.t")) & (F.col("up") == F.col("b.n")))
        rising = rising.select("tree", "node", F.col("up2").alias("up"), "parent", "size")
        open_before, before = now.seen["climbing"], now
        now = cut(rising.unionByName(gained.where("up is null")), "up", climbing=climbing)
        before.drop()
    # what still climbs goes round in a cycle; the rest is the forest
    ended = now.df.where("up is null").drop("up")
    leaf = leaves.select("tree", "node", "parent", F.lit(1).cast("long").alias("size"))

    placed = ended.select("tree", "node", "parent", "size").unionByName(leaf).withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)))
    before = Window.partitionBy("tree", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("tree", "parent", "bucket").agg(F.sum("size").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    within = Window.partitionBy("tree", "parent", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("off", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("c")
    same = (F.col("c.tree") == F.col("b.tree")) & F.col("c.parent").eqNullSafe(F.col("b.parent")) & (F.col("c.bucket") == F.col("b.bucket"))
    placed = placed.join(base.alias("b"), same).select("c.tree", "c.node", "c.parent", "c.size", (F.col("off") + F.col("base")).alias("off"))
    placed = cut(placed, "placed").df

    # a node starts after all that its ancestors and their earlier siblings hold
    offsets = placed.select("tree", "node", "off")
    first = ended.join(offsets, ["tree", "node"]).select(
        "tree", "node", F.col("parent").alias("up"), "parent", F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("int").alias("depth"), "size",
        (F.col("off") + F.col("parent").isNotNull().cast("int")).alias("start"), *([F.array("node").alias("path")] if with_path else []),
    )
    down = cut(first, "down", climbing=climbing)
    while down.seen["climbing"]:
        above = down.df.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("start").alias("start2"), *([F.col("path").alias("path2")] if with_path else [])).alias("b")
        rising = down.df.where("up is not null").alias("a").join(above, (F.col("a.tree") == F.col("b.t")) & (F.col("a.up") == F.col("b.n"))).select(
            "tree", "node", F.col("up2").alias("up"), "parent", F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), "size", (F.col("start") + F.col("start2")).alias("start"),
            *([F.concat("path2", "path").alias("path")] if with_path else []),
        )
        before, down = down, cut(rising.unionByName(down.df.where("up is null")), "down", climbing=climbing)
        before.drop()
    upper = down.df.drop("up")
    over = upper.select("tree", F.col("node").alias("parent"), "root", (F.col("depth") + 1).alias("depth"), (F.col("start") + 1).alias("after"), *(["path"] if with_path else []))
    lowest = placed.join(leaf.select("tree", "node"), ["tree", "node"], "left_semi").join(over, ["tree", "parent"])
    lowest = lowest.select("tree", "node", "parent", "root", "depth", "size", (F.col("after") + F.col("off")).alias("start"), *([F.concat("path", F.array("node")).alias("path")] if with_path else []))
    return upper.unionByName(lowest)


def descendants(forest: DataFrame) -> DataFrame:
    """All pairs ``(tree, ancestor, node, steps)`` of a forest, from its ranges alone.

    A node lies below every other range that holds its start; the ranges are intervals, so the
    dyadic stabbing join finds them by equality.
    """
    held = forest.where("size > 1").select("tree", F.col("node").alias("ancestor"), F.col("depth").alias("top"), (F.col("start") + 1).alias("from"), (F.col("start") + F.col("size")).alias("to"))
    found = stab(forest.select("tree", "node", "depth", "start"), held, keys=["tree"], point="start", lower="from", upper="to")
    return found.select("tree", "ancestor", "node", (F.col("depth") - F.col("top")).alias("steps"))


def all_descendants(links: DataFrame) -> DataFrame:
    """All distinct pairs ``(ancestor, node)`` over any mix of ``links`` ``(node, parent)``.

    Cycles are no hindrance: a node on one is its own descendant, and what hangs below it is found.
    Each group of :func:`cyclic_groups` is one node while the ancestors come down: a node's are its
    parents and theirs, sent to it once a link and made distinct there. There is a round for every
    generation of the longest line; the work is the number of pairs, once a link.
    """
    links = cut(links.select("node", "parent").distinct(), "links").df
    groups = cut(cyclic_groups(links).where("node is not null").select("node", "root"), "groups").df
    single = lambda df, c: df.join(groups.select(F.col("node").alias(c), F.col("root").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    acyclic = cut(single(single(links, "node"), "parent").where("node <> parent").distinct(), "acyclic").df
    level = _generations(acyclic)
    # links know the generation of both ends, so that every round reads only its own
    at = lambda c, name: level.select(F.col("node").alias(c), F.col("level").alias(name))
    placed = cut(acyclic.join(at("node", "level"), "node").join(at("parent", "above"), "parent"), "placed").df
    top = placed.agg(F.max("level")).first()[0] or 0
    spark, box = links.sparkSession, f"{shared_dir(links.sparkSession).rstrip('/')}/paddock/sent-{uuid.uuid4().hex[:12]}"
    keep_until_exit(spark, box)
    salt, salts = F.pmod(F.xxhash64("node"), F.lit(SENDING_SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SENDING_SALTS - 1)))
    kind = links.schema["node"].dataType.simpleString()
    found = []
    for now in range(top + 1):
        if now:  # what was sent to this generation
            got = spark.read.schema(f"node {kind}, parent {kind}, over array<{kind}>").parquet(*(f"{box}/{i}/level={now}" for i in range(now) if _is_there(spark, f"{box}/{i}/level={now}")))
            whole = cut(got.groupBy("node").agg(F.array_distinct(F.concat(F.collect_list("parent"), F.flatten(F.collect_list("over")))).alias("over")), "over").df
            found.append(whole)
        else:
            whole = placed.where("above = 0").select(F.col("parent").alias("node")).distinct().withColumn("over", F.array().cast(f"array<{kind}>"))
        if now < top:
            down = placed.where(F.col("above") == now).select("node", "parent", "level").withColumn("salt", salt)
            spread = whole.select(F.col("node").alias("parent"), "over").withColumn("salt", salts)
            down.join(spread, ["parent", "salt"]).select("node", "parent", "over", "level").write.partitionBy("level").parquet(f"{box}/{now}")
    pairs = [w.select(F.explode("over").alias("ancestor"), "node") for w in found]
    inside = groups.select("root", F.col("node").alias("ancestor")).join(groups, "root").select("ancestor", "node")
    if not pairs:
        return inside
    # members of a group have what it has, and one another
    members = lambda df, c: df.join(groups.select(F.col("root").alias(c), F.col("node").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return members(members(reduce(DataFrame.unionByName, pairs), "ancestor"), "node").select("ancestor", "node").unionByName(inside)


def _is_there(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _generations(links: DataFrame) -> DataFrame:
    """``(node, level)`` of acyclic links: the length of the longest line that ends at a node."""
    rest = cut(links, "unplaced")
    done = [links.select(F.col("parent").alias("node")).join(links.select("node"), "node", "left_anti").distinct().select("node", F.lit(0).alias("level"))]
    now = cut(done[0], "level")
    done = [now.df]
    while rest.seen["rows"]:
        ready = now.df.select(F.col("node").alias("parent"))
        kept = cut(rest.df.join(ready, "parent", "left_anti"), "unplaced")
        reached = rest.df.join(ready, "parent", "left_semi").select("node").distinct().join(kept.df.select("node"), "node", "left_anti")
        now = cut(reached.select("node", F.lit(len(done)).alias("level")), "level")
        rest.drop()
        rest = kept
        done.append(now.df)
    return reduce(DataFrame.unionByName, done)


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Colours of the ends of a share of the links, passed on among these links until none changes."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    whole = pd.concat(parts)
    ids, at = np.unique(np.concatenate([whole.node.to_numpy(), whole.parent.to_numpy()]), return_inverse=True)
    child, parent = at[: len(whole)], at[len(whole) :]
    down, up = ids.copy(), ids.copy()
    for end, d, u in ((child, "n_down", "n_up"), (parent, "p_down", "p_up")):
        np.minimum.at(down, end, whole[d].to_numpy())
        np.minimum.at(up, end, whole[u].to_numpy())
    while True:
        before = down.sum(), up.sum()
        np.minimum.at(down, parent, down[child])
        np.minimum.at(up, child, up[parent])
        for colour in (down, up):  # what a colour that is here has become
            place = np.minimum(np.searchsorted(ids, colour), len(ids) - 1)
            np.minimum(colour, np.where(ids[place] == colour, colour[place], colour), out=colour)
        if before == (down.sum(), up.sum()):
            break
    yield pd.DataFrame({"node": ids, "down": down, "up": up})


def _least_both_ways(links: DataFrame, n: int) -> DataFrame:
    """``(node, down, up)``: the least id that leads to each node along the ``n`` ``links`` and the least it leads to.

    Every task passes colours on among its share of the links until they settle there, then the
    shares tell each other; a round in which nothing changes is the last. The number of shares
    follows the number of links, so a task never holds more than ``LINKS_A_TASK`` of them or so.
    """
    kind = links.schema["node"].dataType.simpleString()
    total = lambda: F.sum("down") + F.sum("up")
    shares = -(-n // LINKS_A_TASK)
    ends = {f"{p}_{way}": F.col(c) for c, p in (("node", "n"), ("parent", "p")) for way in ("down", "up")}

    def settled(held: DataFrame) -> Cut:
        told = held.repartition(shares, "node").mapInPandas(_settle, f"node {kind}, down {kind}, up {kind}")
        return cut(told.groupBy("node").agg(F.min("down").alias("down"), F.min("up").alias("up")), "colours", total=total())

    now, before = settled(links.withColumns(ends)), None
    while shares > 1 and (before is None or now.seen["total"] != before.seen["total"]):  # one share has nobody to tell
        end = lambda c, p: now.df.select(F.col("node").alias(c), F.col("down").alias(f"{p}_down"), F.col("up").alias(f"{p}_up"))
        if before:
            before.drop()
        before, now = now, settled(links.join(end("node", "n"), "node").join(end("parent", "p"), "parent"))
    return now.df


def cyclic_groups(links: DataFrame) -> DataFrame:
    """Nodes that are their own ancestors over any mix of ``links`` ``(node, parent)``.

    Returns ``(node, root, members)``: the smallest id and the number of nodes that are at once
    ancestors and descendants of the node, itself included. Links at the ends of all lines cannot
    lie on a cycle and are peeled first, while that removes many. What stays unprocessed is split by
    the least id that leads to each node and the least it leads to: where both are the same id the
    nodes are that id's group, elsewhere the links between nodes of equal ids go on. Each part
    gives off the group of its least id, so the splitting ends. A node between two cycles is no
    group, a node linked to itself is. The steps are the same whatever the number of links.
    """
    alive = cut(links.select("node", "parent").distinct(), "links")
    groups = []
    while alive.seen["rows"]:
        while True:  # peel
            had, kept = alive.seen["rows"], alive.df
            for _ in range(STEPS):
                below = kept.join(kept.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
                kept = below.join(kept.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent")
            before, alive = alive, cut(kept, "peeled")
            before.drop()
            if alive.seen["rows"] > had * WORTH_PEELING or not alive.seen["rows"]:
                break
        if not alive.seen["rows"]:
            break
        colours = _least_both_ways(alive.df, alive.seen["rows"])
        groups.append(colours.where("down = up").select("node", F.col("down").alias("colour")))
        mixed = colours.where("down <> up")
        ends = mixed.select(F.col("node").alias("parent"), "down", "up")
        before, alive = alive, cut(alive.df.join(mixed, "node").join(ends, ["parent", "down", "up"]).select("node", "parent"), "rest")
        before.drop()
    if not groups:
        return alive.df.where("false").select("node", F.col("node").alias("root"), F.lit(0).alias("members"))
    found = reduce(DataFrame.unionByName, groups)
    size = found.groupBy("colour").agg(F.count(F.lit(1)).cast("int").alias("members"))
    selves = links.where("node = parent").select(F.col("node").alias("colour"), F.lit(True).alias("self")).distinct()
    size = size.join(selves, "colour", "left").where("members > 1 or self")
    return found.join(size, "colour").select("node", F.col("colour").alias("root"), "members")
