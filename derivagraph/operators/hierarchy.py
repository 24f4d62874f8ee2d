"""Parent-child rows to full hierarchies by nested-set ranges.

Upward: after round k a node knows its ancestor 2^k levels up, and every node has
been given the sizes of what lies below it within 2^k levels, so a chain of
length d takes log2(d) rounds; only nodes deeper than 2^k take part in round k.
Siblings get preorder ranges by prefix sums of their sizes, and downward nodes add
up their offsets, by doubling too, until an ancestor has its place already. Places run over all trees, so root and depth of every node follow
from the ranges alone: the depth is the number of ranges open at its place, the
root the last root before it. Nodes that never reach a root lie on a ring or below
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, bounded_broadcast
from .orphans import order_ids
from .ranks import running_sums


def _one_parent(links: DataFrame) -> DataFrame:
    """Each child's parent: the smallest, where data name several."""
    return links.filter(F.col("parent").isNotNull() & F.col("child").isNotNull()).groupBy("child").agg(F.min("parent").alias("parent"))


def _numbered(up: DataFrame, sc: Scratch) -> tuple[DataFrame, DataFrame]:
    """((word, id), (v, p)): integers in word order, and the links in them."""
    ids = order_ids(up.select(F.col("child").alias("word")).union(up.select("parent")).distinct(), sc)
    e = up.join(ids.select(F.col("word").alias("child"), F.col("id").alias("v")), "child").join(ids.select(F.col("word").alias("parent"), F.col("id").alias("p")), "parent")
    return ids, sc.cut(e.select("v", "p"))


def _climb(up: DataFrame, sc: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """((v, more), (v) or None): the sizes found below each node, to be summed; the nodes that reach no root.

    One table a round: nodes of depth 2^k or more with their ancestor 2^k levels
    up and their size within 2^k levels.
    """
    t = up.select("v", F.col("p").alias("anc"), F.lit(1).cast("long").alias("size"))
    n, found = up.count(), None
    while True:
        more = t.groupBy(F.col("anc").alias("v")).agg(F.sum("size").alias("more"))
        found = more if found is None else found.unionByName(more)
        step = t.join(t.select(F.col("v").alias("anc"), F.col("anc").alias("anc2")), "anc").join(more, "v", "left")
        t = sc.cut(step.select("v", F.col("anc2").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        m = t.count()
        if m == 0:
            return found, None
        if m == n:  # levels have no gaps: what all goes on for ever never reaches a root
            return found, t.select("v")
        n = m


def build_hierarchy(links: DataFrame, with_path: bool = False, scratch: Scratch | None = None, with_parent: bool = True) -> DataFrame:
    """(parent, child) rows to one row per word: parent, root, node_depth, size, pre, post, on_ring[, path].

    ``pre`` and ``post`` are the nested-set range of the word over all trees; the
    descendants of x are the words with pre in (x.pre, x.post]. ``path`` runs from
    the root to the word.

    Rows with a null end are ignored, repeated rows count once, a child with
    several parents keeps the smallest, a word that is its own parent is a ring.
    For words on or below a ring root is '', node_depth -1 and the rest null.
    An empty table gives an empty result; further columns are ignored.
    """
    sc = scratch or Scratch(links.sparkSession)
    ids, up = _numbered(sc.cut(_one_parent(links)), sc)
    below, lost = _climb(up, sc)
    tree = up if lost is None else sc.cut(up.join(lost, "v", "left_anti"))
    roots = sc.cut(up.select(F.col("p").alias("v")).distinct().join(up.select("v"), "v", "left_anti"))

    # sizes of all nodes of trees; a node's offset is 1 + the sizes of its siblings before it, from running sums over (parent, node)
    nodes = tree.select("v", "p").unionByName(roots.select("v", F.lit(None).cast("long").alias("p")))
    sized = nodes.join(below.groupBy("v").agg(F.sum("more").alias("more")), "v", "left").select("v", "p", (1 + F.coalesce("more", F.lit(0))).alias("size"))
    order = F.struct("p", "v")  # roots, whose parent is null, come first: their running sums are their places
    sized = sc.cut(running_sums(sized, order, {"upto": "size"}).select("v", "p", "size", (F.col("upto") - F.col("size")).alias("before")))
    first = sized.filter(F.col("p").isNotNull()).groupBy("p").agg(F.min("before").alias("first"))
    # downward: after round k a node has the offsets of 2^k levels summed, or its place if a root is among them
    no_path = F.lit(None).cast("array<long>").alias("path")
    own_path = F.array("v").alias("path") if with_path else no_path
    joined = F.concat("path2", "path").alias("path") if with_path else no_path
    tops = sized.filter(F.col("p").isNull()).select("v", F.lit(None).cast("long").alias("anc"), F.col("before").alias("sum"), own_path)
    going = sc.cut(sized.filter(F.col("p").isNotNull()).join(first, "p").select("v", F.col("p").alias("anc"), (1 + F.col("before") - F.col("first")).alias("sum"), own_path))
    placed = tops
    while going.limit(1).count():
        high = placed.unionByName(going).select(F.col("v").alias("anc"), F.col("anc").alias("anc2"), F.col("sum").alias("sum2"), F.col("path").alias("path2"))
        step = sc.cut(going.join(high, "anc").select("v", F.col("anc2").alias("anc"), (F.col("sum") + F.col("sum2")).alias("sum"), joined))
        placed, going = placed.unionByName(step.filter(F.col("anc").isNull())), step.filter(F.col("anc").isNotNull())
    placed = placed.select("v", F.col("sum").alias("pre"), "path")

    # root and depth from the ranges
    word = ids.select(F.col("id").alias("v"), "word")
    out = _from_ranges(placed.select("v", "pre").join(sized.select("v", "p", "size"), "v").join(word, "v"))
    if lost is not None:
        none = F.lit(None).cast("long")
        out = out.unionByName(up.join(lost, "v").join(word, "v").select("word", "v", "p", F.lit("").alias("root"), F.lit(-1).alias("node_depth"), none.alias("size"), none.alias("pre"), none.alias("post"), F.lit(True).alias("on_ring")))
    keep = ["word", "root", "node_depth", "size", "pre", "post", "on_ring"]
    if with_path:
        x = placed.select("v", F.posexplode("path").alias("at", "x")).join(word.select(F.col("v").alias("x"), "word"), "x")
        named = x.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("path"))
        out = out.join(named.select("v", F.transform("path", lambda y: y["word"]).alias("path")), "v", "left")
        keep.append("path")
    if with_parent:
        out = out.join(word.select(F.col("v").alias("p"), F.col("word").alias("parent")), "p", "left")
        keep.append("parent")
    return out.select(*keep)


#: Places of one block when ranges are read; the number of blocks grows with the table.
BLOCK = 1 << 16


def _from_ranges(at: DataFrame) -> DataFrame:
    """(word, v, p, pre, size) with ``root``, ``node_depth``, ``post``: from the ranges alone.

    Places run 0, 1, ... without gaps, so of the ranges begun up to place x there
    are x + 1; those ended before it are counted, the rest are open there. The
    last root begun holds the place. Counted in blocks of places; each block
    passes on one row.
    """
    none = F.lit(None)
    begin = at.select(F.col("pre").alias("pos"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ended"), F.when(F.col("p").isNull(), F.col("word")).alias("top"), "word", "v", "p", "size")
    end = at.groupBy((F.col("pre") + F.col("size")).alias("pos")).agg(F.count(F.lit(1)).alias("ended"))
    end = end.select("pos", F.lit(0).alias("kind"), "ended", none.cast("string").alias("top"), none.cast("string").alias("word"), none.cast("long").alias("v"), none.cast("long").alias("p"), none.cast("long").alias("size"))
    rows = begin.unionByName(end).withColumn("block", F.floor(F.col("pos") / BLOCK))
    last = F.max(F.when(F.col("top").isNotNull(), F.struct("pos", "top")))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    per = rows.groupBy("block").agg(F.sum("ended").alias("e"), last.alias("r")).select("block", F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"), F.max("r").over(before).alias("r0"))
    w = Window.partitionBy("block").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("e1", F.sum("ended").over(w)).withColumn("r1", F.last("top", ignorenulls=True).over(w)).filter("kind = 1").join(bounded_broadcast(per), "block")
    return x.select(
        "word", "v", "p", F.coalesce("r1", F.col("r0.top")).alias("root"), (F.col("pos") - F.col("e0") - F.col("e1")).cast("int").alias("node_depth"), "size", F.col("pos").alias("pre"), (F.col("pos") + F.col("size") - 1).alias("post"), F.lit(False).alias("on_ring")
    )


def ring_members(links: DataFrame, hierarchy: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(ring_first, word) of each word that lies on a ring itself; ``ring_first`` is the ring's smallest word.

    2^r steps up from any word below a ring end on the ring, so the images of all
    words after enough doublings are the words on rings; then labels are doubled
    around each ring.
    """
    sc = scratch or Scratch(links.sparkSession)
    cur = sc.cut(hierarchy.filter("on_ring").select(F.col("word").alias("child"), "parent"), "peel")
    n = cur.count()
    jump = cur.select("child", F.col("parent").alias("anc"))
    images = None
    while n:
        jump = sc.cut(jump.join(jump.select(F.col("child").alias("anc"), F.col("anc").alias("anc2")), "anc").select("child", F.col("anc2").alias("anc")), "jump")
        now = jump.select("anc").distinct().count()
        if images == now:
            break
        images = now
    on = sc.cut(jump.select(F.col("anc").alias("child")).distinct())
    ring = sc.cut(cur.join(on, "child").select("child", F.col("parent").alias("anc"), F.least("child", "parent").alias("low")), "ring")
    before = None
    while n:
        ring = sc.cut(ring.join(ring.select(F.col("child").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2")), "anc").select("child", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low")), "ring")
        now = ring.select("low").distinct().count()
        if now == before:
            break
        before = now
    return ring.select(F.col("low").alias("ring_first"), F.col("child").alias("word"))


def descendants(hierarchy: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(ancestor, descendant, distance) for every pair on one path, by the nested-set ranges.

    Words are sorted by their place over range partitions and swept with a stack
    of the ranges open there. A partition starts with the ranges that hold its
    first place: each range looks up the borders inside it, one row a partition.
    """
    sc = scratch or Scratch(hierarchy.sparkSession)
    n = int(hierarchy.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = hierarchy.filter("NOT on_ring").select("word", "pre", "post", "node_depth")
    h = sc.cut(h.repartitionByRange(n, "pre").withColumn("part", F.spark_partition_id()))
    borders = sc.cut(h.groupBy("part").agg(F.min("pre").alias("start")))  # one row a partition
    following = borders.select("part", F.lead("start").over(Window.orderBy("part")).alias("next"))
    long = h.join(F.broadcast(following), "part").filter(F.col("post") >= F.col("next")).select("word", "pre", "post", "node_depth")  # ranges that leave their partition
    over = long.join(F.broadcast(borders), (F.col("pre") < F.col("start")) & (F.col("post") >= F.col("start")))
    rows = h.withColumn("carried", F.lit(False)).unionByName(over.select("word", "pre", "post", "node_depth", "part", F.lit(True).alias("carried")))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, names, posts, depths = None, [], [], []
        for b in batches:
            anc, who, dist = [], [], []
            for p, word, post, depth, pre, carried in zip(b["part"], b["word"], b["post"], b["node_depth"], b["pre"], b["carried"], strict=True):
                if p != part:
                    part, names, posts, depths = p, [], [], []
                while posts and posts[-1] < pre:
                    names.pop(), posts.pop(), depths.pop()
                if not carried:
                    anc += names
                    who += [word] * len(names)
                    dist += [depth - x for x in depths]
                names.append(word), posts.append(post), depths.append(depth)
                if len(anc) > 100_000:
                    yield pd.DataFrame({"ancestor": anc, "descendant": who, "distance": np.array(dist, np.int32)})
                    anc, who, dist = [], [], []
            yield pd.DataFrame({"ancestor": anc, "descendant": who, "distance": np.array(dist, np.int32)})

    return rows.repartition(n, "part").sortWithinPartitions("part", "pre").mapInPandas(sweep, "ancestor string, descendant string, distance int")


def subtree(hierarchy: DataFrame, word: str) -> DataFrame:
    """The words below ``word``, by its nested-set range alone."""
    top = hierarchy.filter((F.col("word") == word) & ~F.col("on_ring")).select(F.col("pre").alias("_a"), F.col("post").alias("_b"))
    return hierarchy.join(F.broadcast(top.limit(1)), (F.col("pre") > F.col("_a")) & (F.col("pre") <= F.col("_b"))).drop("_a", "_b")
