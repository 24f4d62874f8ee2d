"""Topology of the derivation graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, unit
from ..scratch import Scratch
from .components import connected_components


def word_ids(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, id): integers in word order, for the loops below."""
    from .orphans import order_ids

    return order_ids(words.select("word").distinct(), scratch)


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (source, target): parallel relations merged."""
    return edges.select("source", "target").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree over distinct pairs; nodes without edges have 0."""
    p = simple_pairs(edges)
    out = p.groupBy(F.col("source").alias("word")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = p.groupBy(F.col("target").alias("word")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("word").join(out, "word", "left").join(into, "word", "left").na.fill(0, ["out_degree", "in_degree"])


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges)
    return d.agg(*[F.round(f(c), 6).alias(f"{n}_{c}") if n == "avg" else f(c).alias(f"{n}_{c}") for c in ("in_degree", "out_degree") for n, f in (("avg", F.avg), ("max", F.max))])


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = nodes.agg(F.countDistinct("word").alias("n_nodes")), simple_pairs(edges).agg(F.count(F.lit(1)).alias("n_edges"))
    d = n.crossJoin(m)  # one row each
    return d.withColumn("density", F.round(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), 9))


def top_roots(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` words with the most distinct targets, ties by word."""
    return simple_pairs(edges).groupBy(F.col("source").alias("word")).agg(F.count(F.lit(1)).alias("out_degree")).orderBy(F.desc("out_degree"), "word").limit(k)


def weak_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, component): the component named by its first word; words without edges stand alone."""
    ids = word_ids(nodes.select("word").union(edges.select("source")).union(edges.select("target")), scratch)
    e = simple_pairs(edges).join(ids.select(F.col("word").alias("source"), F.col("id").alias("a")), "source").join(ids.select(F.col("word").alias("target"), F.col("id").alias("b")), "target").select("a", "b")
    c = connected_components(e, scratch)
    name = ids.select(F.col("id").alias("component"), F.col("word").alias("_name"))
    return ids.join(c.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(name, "component").select("word", F.col("_name").alias("component"))


def component_stats(components: DataFrame) -> DataFrame:
    s = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest_size"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


def strong_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(word, component) of every word on an edge, ``component`` its strong component's smallest word.

    Words that point at each other are one first, as connected components of the
    mutual pairs. Of the contracted graph, nodes without an edge in or out are
    trimmed off, several levels to a round; of what stays, every node takes the
    smallest node that reaches it (colouring), and of each colour what reaches its
    first node backwards is one component; repeated until nothing stays.
    """
    pairs = simple_pairs(edges)
    ids = word_ids(pairs.select(F.col("source").alias("word")).union(pairs.select("target")), scratch)
    e = pairs.join(ids.select(F.col("word").alias("source"), F.col("id").alias("a")), "source").join(ids.select(F.col("word").alias("target"), F.col("id").alias("b")), "target")
    e = scratch.cut(e.select("a", "b"))
    mutual = e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).filter("a < b")
    first = scratch.cut(connected_components(mutual, scratch))
    name = scratch.cut(ids.join(first.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "word", F.coalesce("component", "id").alias("node")))
    at = name.select("id", "node")
    left = e.join(at.select(F.col("id").alias("a"), F.col("node").alias("x")), "a").join(at.select(F.col("id").alias("b"), F.col("node").alias("y")), "b")
    left = scratch.cut(left.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "left")
    done = None
    for _ in range(max_rounds):
        n = left.count()
        while n:  # trim
            t = left
            for _ in range(4):
                t = t.join(t.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(t.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
            left = scratch.cut(t, "left")
            m = left.count()
            if m == n:
                break
            n = m
        if not n:
            break
        colour = scratch.cut(left.select(F.col("a").alias("v")).union(left.select("b")).distinct().withColumn("c", F.col("v")), "colour")
        while True:  # forward: the smallest node upstream
            best = left.join(colour.select(F.col("v").alias("a"), "c"), "a").groupBy(F.col("b").alias("v")).agg(F.min("c").alias("c2"))
            nxt = scratch.cut(colour.join(best, "v", "left").select("v", F.least("c", F.coalesce("c2", "c")).alias("c"), (F.coalesce("c2", "c") < F.col("c")).alias("moved")), "next")
            moved = nxt.filter("moved").limit(1).count()
            colour = scratch.cut(nxt.select("v", "c"), "colour")
            if not moved:
                break
        same = left.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b", F.col("ca").alias("c"))
        same = scratch.cut(same, "same")
        back = scratch.cut(colour.filter("v = c"), "back")
        while True:  # backward within the colour
            more = scratch.cut(same.join(back.select(F.col("v").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("v"), "c").distinct().join(back, ["v", "c"], "left_anti"), "more")
            if more.limit(1).count() == 0:
                break
            back = scratch.cut(back.unionByName(more), "back")
        found = scratch.cut(back.select(F.col("v").alias("node"), F.col("c").alias("top")))
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        left = scratch.cut(left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "left")
    else:
        raise RuntimeError("strong components did not settle")
    if done is not None:
        name = name.join(done, "node", "left").select("word", F.coalesce("top", "node").alias("node"))
    low = name.groupBy("node").agg(F.min("word").alias("component"))
    return name.join(low, "node").select("word", "component")


def bfs(edges: DataFrame, roots: DataFrame, scratch: Scratch, max_depth: int | None = None) -> DataFrame:
    """(root, word, distance): directed distances from every root (column ``root``), the root itself 0."""
    e = scratch.cut(simple_pairs(edges))
    seen = scratch.cut(roots.select("root", F.col("root").alias("word"), F.lit(0).alias("distance")).distinct(), "seen")
    depth = 0
    while max_depth is None or depth < max_depth:
        front = seen.filter(F.col("distance") == depth)
        new = front.join(e, F.col("word") == F.col("source")).select("root", F.col("target").alias("word")).distinct().join(seen.select("root", "word"), ["root", "word"], "left_anti")
        new = scratch.cut(new.withColumn("distance", F.lit(depth + 1)), "new")
        if new.limit(1).count() == 0:
            break
        seen = scratch.cut(seen.unionByName(new), "seen")
        depth += 1
    return seen


def family_members(distances: DataFrame, max_members: int) -> DataFrame:
    """The ``max_members`` nearest words of each root, ties by word."""
    w = Window.partitionBy("root").orderBy("distance", "word")
    return distances.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= max_members)


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(root, source, relation, target): edges between members of one family."""
    m = members.select("root", "word")
    return edges.join(m.withColumnRenamed("word", "source"), "source").join(m.withColumnRenamed("word", "target"), ["root", "target"]).select("root", "source", "relation", "target")


def radial_layout(members: DataFrame, step: float = 1.0) -> DataFrame:
    """x and y of each member: the root in the middle, distance d on a circle of radius d * step, from the top, in word order."""
    w = Window.partitionBy("root", "distance")
    m = members.withColumn("i", F.row_number().over(w.orderBy("word")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    angle = 2 * math.pi * F.col("i") / F.col("n") - math.pi / 2
    r = F.col("distance") * step
    return m.select("root", "word", "distance", F.round(r * F.cos(angle), 4).alias("x"), F.round(r * F.sin(angle), 4).alias("y"))


def random_walks(edges: DataFrame, starts: DataFrame, walks: int, length: int, seed: int, scratch: Scratch, p: float = 1.0, q: float = 1.0, block: int = 2_000_000) -> DataFrame:
    """(word, walk, path): walks over distinct pairs, ending early at a word without targets.

    Walks go in blocks of start words, each of ``block`` walks or as many as there
    are links, so what is shuffled at a time is a share of the result. The
    neighbour of a step is a hash of (seed, start, walk, step) modulo the degree,
    looked up in an indexed adjacency table. With a return weight 1 / ``p``
    and an in-out weight 1 / ``q`` other than 1 (weight 1 for words that the word
    before links to as well) a drawn neighbour is accepted in proportion to its
    weight and drawn again otherwise, so no neighbourhood is ever spread out.
    """
    w = Window.partitionBy("source").orderBy("target")
    biased = p != 1 or q != 1
    name = lambda x: None if biased else x
    pairs = scratch.cut(simple_pairs(edges), name("pairs"))
    adj = scratch.cut(pairs.withColumn("i", F.row_number().over(w) - 1), name("adj"))
    deg = scratch.cut(adj.groupBy("source").agg(F.count(F.lit(1)).alias("deg")), name("deg"))
    first = starts.select("word").distinct()
    if biased:
        cur = first.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).withColumn("path", F.array("word"))
        return _biased_walks(cur, pairs, adj, deg, length, seed, scratch, p, q)
    first = scratch.cut(first.join(deg.withColumnRenamed("source", "word"), "word", "left"))
    links = adj.select(F.col("source").alias("at"), "i", "target").join(deg.select(F.col("source").alias("target"), F.col("deg").alias("next")), "target", "left")
    links = scratch.cut(links.select("at", F.col("i").cast("long").alias("i"), "target", "next"))
    scratch.drop("pairs", "adj", "deg")
    n, m = first.count(), links.count()
    blocks = max(1, math.ceil(n * walks / max(m, block)))
    links, done = links.hint("shuffle_hash"), None  # its parts are even: a hub's links have an ``i`` each
    for b in range(blocks):
        mine = first.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b) if blocks > 1 else first
        names: list[str] = []
        paths = _block_of_walks(mine.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))), links, length, seed, scratch, names)
        pieces = math.ceil(n * walks / blocks / (block / 8))
        whole = blocks * pieces <= 1
        for j in range(max(1, pieces)):  # what puts the parts together shuffles whole paths
            piece = paths if whole else scratch.cut(paths.filter(F.pmod(F.xxhash64("word", "walk"), F.lit(pieces)) == j), codec="zstd")
            done = piece if done is None else done.unionByName(piece)
        if not whole:
            scratch.drop(*names)
    return done


def _block_of_walks(cur: DataFrame, links: DataFrame, length: int, seed: int, scratch: Scratch, names: list[str]) -> DataFrame:
    """(word, walk, path) from (word, deg, walk): written in parts of a few steps (to ``names``), each begun at the last word of the one before, and put together once."""
    cur, parts = cur.withColumn("path", F.array("word")), []
    for step in range(1, length):
        i = F.when(F.col("deg").isNotNull(), F.pmod(draw(seed, "word", "walk", F.lit(step)), F.col("deg")))
        at = cur.withColumn("at", F.element_at("path", -1)).withColumn("i", i).drop("deg")
        cur = at.join(links, ["at", "i"], "left").select("word", F.col("next").alias("deg"), "walk", F.when(F.col("target").isNotNull(), F.concat("path", F.array("target"))).otherwise(F.col("path")).alias("path"))
        if step == 2 or step % 4 == 0 or step == length - 1:
            names.append(f"walks{scratch.made}")
            part = scratch.cut(cur, names[-1])
            parts.append(part)
            if step == length - 1 or part.filter("deg IS NOT NULL").limit(1).count() == 0:
                break
            cur = part.filter("deg IS NOT NULL").withColumn("path", F.array(F.element_at("path", -1)))
    if len(parts) < 2:
        return (parts[0] if parts else cur).select("word", "walk", "path")
    rest = parts[0].filter("deg IS NOT NULL").withColumn("k", F.lit(0))
    for k, x in enumerate(parts[1:], 1):
        rest = rest.unionByName(x.withColumn("k", F.lit(k)).withColumn("path", F.slice("path", 2, length)))
    rest = rest.groupBy("word", "walk").agg(F.sort_array(F.collect_list(F.struct("k", "path"))).alias("all"))  # a row a part
    return parts[0].filter("deg IS NULL").select("word", "walk", "path").unionByName(rest.select("word", "walk", F.flatten("all.path").alias("path")))


def _biased_walks(cur: DataFrame, pairs: DataFrame, adj: DataFrame, deg: DataFrame, length: int, seed: int, scratch: Scratch, p: float, q: float) -> DataFrame:
    top = max(1 / p, 1.0, 1 / q)
    known = pairs.select(F.col("source").alias("prev"), "target", F.lit(True).alias("near"))
    done = None
    for step in range(1, length):
        at = cur.select("word", "walk", "path").withColumn("source", F.element_at("path", -1)).withColumn("prev", F.get("path", F.size("path") - 2)).join(deg, "source", "left")
        at = scratch.cut(at, "at")
        ended = scratch.cut(at.filter(F.col("deg").isNull()).select("word", "walk", "path"))
        done = ended if done is None else done.unionByName(ended)
        open_, moved, turn = at.filter(F.col("deg").isNotNull()), None, 0
        while open_.limit(1).count():
            key = ("word", "walk", F.lit(step), F.lit(turn))
            c = open_.withColumn("i", F.pmod(draw(seed, *key), F.col("deg"))).join(adj, ["source", "i"]).join(known, ["prev", "target"], "left")
            weight = F.when(F.col("target") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
            c = c.withColumn("taken", F.col("prev").isNull() | (unit(f"{seed}|accept", *key) < weight / top))
            c = scratch.cut(c.select("word", "walk", "path", "source", "prev", "deg", "target", "taken"))
            new = c.filter("taken").select("word", "walk", F.concat("path", F.array("target")).alias("path"))
            moved = new if moved is None else moved.unionByName(new)
            open_, turn = c.filter("NOT taken").drop("target", "taken"), turn + 1
        if moved is None:
            return done
        cur = scratch.cut(moved, "walks")
    return cur.select("word", "walk", "path").unionByName(done)
