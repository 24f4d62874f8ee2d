"""Similarity clusters by Markov clustering, level by level until no link leaves a cluster.

The similarity graph holds every link that the projection forest finds. Flow on it
is squared, inflated and pruned; the row that takes most of a column's flow is its
attractor. The first level runs where the links are: flow never leaves a linked
set, so the matrix of a leaf is block-diagonal, and its blocks are squared densely.
Columns are then contracted to their attractors, links between attractors add up,
and the next level squares the contracted graph as a distributed sparse matrix of
(col, entries). Contraction keeps linked sets linked, so when no link is left the
attractors name the largest sets held together by links, and nothing but the flow
has decided who joins whom first. The members with the strongest flow into them
represent a cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .neighbours import MIN_COS, SLACK, Index, matrix

INFLATION, PRUNE = 2.0, 1e-3
#: Squarings of a level of the distributed matrix, and at most of a dense block; what has not settled by then goes on in the next level.
EXPANSIONS, DENSE_ROUNDS, SETTLED = 2, 8, 0.95
#: Rows of a dense block at most; a longer linked run of a leaf is cut to several, whose attractors meet in the next level.
BLOCK = 256


def dense_flow(w: np.ndarray, inflation: float = INFLATION, prune: float = PRUNE, rounds: int = DENSE_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (B, n, n), symmetric with an empty diagonal, to the attractor of each column (B, n) and the flow into each row after one squaring."""
    n = w.shape[1]
    at = np.arange(n)
    m = w.astype(np.float32)
    top = m.max(1)
    m[:, at, at] = np.where(top > 0, top, 1)  # a loop as strong as the column's strongest link
    m /= m.sum(1, keepdims=True)
    flow = None
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m /= m.sum(1, keepdims=True)
        m[m < np.minimum(prune, m.max(1, keepdims=True))] = 0
        m /= m.sum(1, keepdims=True)
        if flow is None:
            flow = m.sum(2)
        if m.max(1).min() >= SETTLED:
            break
    hub = np.round(m, 5).argmax(1)  # ties go to the first row
    back = np.take_along_axis(hub, hub, 1)
    return np.where(back == at, np.minimum(hub, at), hub), flow


def linked_runs(adj: np.ndarray) -> list[np.ndarray]:
    """Rows with a link by linked set, each in the order fronts reach them: the diagonal blocks of the flow matrix."""
    open_ = adj.any(1)
    out = []
    for i in range(len(adj)):
        if not open_[i]:
            continue
        open_[i] = False
        front, run = np.array([i]), [np.array([i])]
        while len(front):
            front = np.flatnonzero(adj[front].any(0) & open_)
            open_[front] = False
            run.append(front)
        out.append(np.concatenate(run))
    return out


def leaf_attractors(m: np.ndarray, adj: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """(attractor of each row, flow into it, links between attractors with their weight) of one leaf; a row without a link is its own."""
    hub, flow = np.arange(len(m)), np.ones(len(m))
    runs = linked_runs(adj)
    pieces = [np.sort(r[k : k + block]) for r in runs for k in range(0, len(r), block)]
    by_size: dict[int, list[np.ndarray]] = {}
    for p in pieces:
        by_size.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
    crossing = []
    for size, ps in by_size.items():
        step = max(1, (1 << 22) // (size * size))
        for k in range(0, len(ps), step):
            part = ps[k : k + step]
            idx, real = np.zeros((len(part), size), np.int64), np.zeros((len(part), size), bool)
            for b, p in enumerate(part):
                idx[b, : len(p)], real[b, : len(p)] = p, True
            v = m[idx].astype(np.float32)
            w = np.where(adj[idx[:, :, None], idx[:, None, :]] & real[:, :, None] & real[:, None, :], v @ v.transpose(0, 2, 1), 0)
            h, f = dense_flow(w)
            hub[idx[real]], flow[idx[real]] = np.take_along_axis(idx, h, 1)[real], f[real]
            b, i, j = np.nonzero((w > 0) & (h[:, :, None] < h[:, None, :]))
            crossing.append(np.stack([idx[b, h[b, i]], idx[b, h[b, j]]], 1))
    for r in runs:
        if len(r) > block:  # between the pieces of a cut run, counted by attractors
            o = r[np.argsort(hub[r], kind="stable")]
            names, starts = np.unique(hub[o], return_index=True)
            c = np.add.reduceat(np.add.reduceat(adj[np.ix_(o, o)].astype(np.int32), starts, 0), starts, 1)
            a, b = np.nonzero(np.triu(c, 1))
            crossing.append(np.stack([names[a], names[b]], 1))
    if not crossing:
        return hub, flow, []
    pairs, n = np.unique(np.concatenate(crossing), axis=0, return_counts=True)
    return hub, flow, [(int(a), int(b), float(k)) for (a, b), k in zip(pairs, n, strict=True)]


def _links_of(q: np.ndarray, m: np.ndarray, min_cos: float) -> np.ndarray:
    """Which rows of ``q`` and ``m`` are linked: in single precision, and exactly where its error could decide."""
    s = q.astype(np.float32) @ m.astype(np.float32).T
    out = s >= min_cos
    i, j = np.nonzero(np.abs(s - min_cos) <= SLACK)
    out[i, j] = np.round((q[i] * m[j]).sum(1), 6) >= min_cos
    return out


#: Rows of the first level: an index row's attractor in the first tree; a link between rows; a link between attractors of the first tree.
OWN, LINK, BETWEEN = 0, 1, 2


def first_level(index: Index, min_cos: float = MIN_COS) -> DataFrame:
    """(kind, a, b, w): the flow of every leaf, and links of rows from elsewhere to the attractors they meet there."""
    trees = len(index.planes)

    def flow(rows: pd.DataFrame) -> pd.DataFrame:
        left, guests = rows[rows["role"] != 1].sort_values("id", kind="stable"), rows[rows["role"] == 1]
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        ids, m = left["id"].to_numpy(), matrix(left["v"])
        n = len(ids)
        if n:
            adj = np.concatenate([_links_of(m[k : k + 512], m, min_cos) for k in range(0, n, 512)])
            adj[np.arange(n), np.arange(n)] = False
            hub, f, between = leaf_attractors(m, adj)
            first = int(rows["bin"].iloc[0]) % trees == 0
            has = adj.any(1)
            if not first:
                has &= hub != np.arange(n)
            out.append((OWN if first else LINK, ids[has], ids[hub[has]], f[has] if first else np.ones(has.sum())))
            if between:
                a, b, w = (np.array(x) for x in zip(*between, strict=True))
                out.append((BETWEEN if first else LINK, ids[a], ids[b], w))
            for k in range(0, len(guests), 512):
                g = guests.iloc[k : k + 512]
                i, j = np.nonzero(_links_of(matrix(g["v"]), m, min_cos))
                met, w = np.unique(i * n + hub[j], return_counts=True)
                out.append((LINK, g["id"].to_numpy()[met // n], ids[met % n], w))
        kind = np.concatenate([np.full(len(a), k, np.int8) for k, a, _, _ in out] or [np.zeros(0, np.int8)])
        a, b, w = (np.concatenate([np.asarray(o[x]) for o in out] or [np.zeros(0)]) for x in (1, 2, 3))
        return pd.DataFrame({"kind": kind, "a": a.astype(np.int64), "b": b.astype(np.int64), "w": w.astype(np.float64)})

    return index.by_bin(index.blocks()).applyInPandas(flow, "kind byte, a long, b long, w double")


def contract(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (a, b, w) with their ends renamed by (node, name); loops go, parallel links add up."""
    x = links.join(names.select(F.col("node").alias("a"), F.col("name").alias("na")), "a", "left").join(names.select(F.col("node").alias("b"), F.col("name").alias("nb")), "b", "left")
    x = x.select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "w")
    return _simple(x)


def _simple(links: DataFrame) -> DataFrame:
    x = links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    return x.groupBy("a", "b").agg(F.sum("w").alias("w"))


def _inflated(inflation: float, prune: float) -> Column:
    """A column's entries to power ``inflation``, scaled, small ones dropped (at most 1 / prune stay), scaled again; an empty column flows to itself."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x["p"])
    scaled = lambda e: F.transform(e, lambda x: F.struct((x["p"] / total(e)).alias("p"), x["row"].alias("row")))
    grown = F.transform("entries", lambda x: F.struct(F.pow(x["p"], F.lit(inflation)).alias("p"), x["row"].alias("row")))
    kept = F.filter(scaled(grown), lambda x: x["p"] >= prune)
    return F.when(F.size(kept) == 0, F.array(F.struct(F.lit(1.0).alias("p"), F.col("col").alias("row")))).otherwise(scaled(kept))


def attractors(links: DataFrame, scratch: Scratch, inflation: float = INFLATION, prune: float = PRUNE, expansions: int = EXPANSIONS, salt: int = 0) -> DataFrame:
    """(node, name, alone, near) of every node on a link (a < b, w > 0).

    ``name`` is the row that takes most of the node's flow after ``expansions``
    squarings, ties to the smaller; of two that attract each other, the smaller.
    ``alone``: the node attracts itself and nothing else. ``near``: the row of its
    column that comes first in an order drawn with ``salt``.
    """
    both = links.select(F.col("a").alias("col"), F.col("b").alias("row"), "w").union(links.select("b", "a", "w"))
    sums = both.groupBy("col").agg(F.sum("w").alias("s"), F.max("w").alias("top"))
    share = both.join(sums, "col").select("col", "row", (F.col("w") / (F.col("s") + F.col("top"))).alias("p")).filter(F.col("p") >= prune)
    loops = sums.select("col", F.col("col").alias("row"), (F.col("top") / (F.col("s") + F.col("top"))).alias("p"))
    entries = F.collect_list(F.struct("p", "row")).alias("entries")
    m = scratch.cut(share.union(loops).repartition("col").groupBy("col").agg(entries), "flow")
    for _ in range(expansions):
        # column col of M x M: the columns of its rows, each times the flow into that row
        one = m.select("col", F.explode("entries").alias("e")).select("col", F.col("e.row").alias("k"), F.col("e.p").alias("p1"))
        two = one.join(m.select(F.col("col").alias("k"), F.col("entries").alias("of_k")), "k").select("col", "p1", F.explode("of_k").alias("e"))
        sq = two.select("col", F.col("e.row").alias("row"), (F.col("p1") * F.col("e.p")).alias("p")).repartition("col").groupBy("col", "row").agg(F.sum("p").alias("p"))
        m = scratch.cut(sq.groupBy("col").agg(entries).select("col", _inflated(inflation, prune).alias("entries")), "flow")
    best = F.array_max(F.transform("entries", lambda x: F.struct(F.round(x["p"], 9).alias("p"), (-x["row"]).alias("r"))))
    near = F.array_min(F.transform("entries", lambda x: F.struct(F.xxhash64(F.lit(salt), x["row"]).alias("h"), x["row"].alias("row"))))
    hub = scratch.cut(m.select(F.col("col").alias("node"), (-best["r"]).alias("name"), near["row"].alias("near")), "hub")
    drawn = hub.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("name", "node")
    back = hub.select(F.col("node").alias("name"), F.col("name").alias("back"))
    x = hub.join(back, "name").join(drawn, "node", "left")
    mutual = (F.col("back") == F.col("node")) & (F.col("name") > F.col("node"))
    return x.select("node", F.when(mutual, F.col("node")).otherwise(F.col("name")).alias("name"), ((F.col("name") == F.col("node")) & (F.col("n") == 1)).alias("alone"), "near")


def linked_clusters(links: DataFrame, scratch: Scratch, inflation: float = INFLATION, prune: float = PRUNE, max_levels: int = 60) -> DataFrame:
    """(a, b, w) undirected links to (node, name): Markov clustering level by level until no link leaves a cluster.

    Rows with a null end or weight, or a weight of 0 or less, are ignored, loops
    too; repeated links add up; an empty table gives an empty result. A node that
    would stay alone although it has links (the middle of a chain, say) joins the
    first of its column in a drawn order instead, so every level shrinks the graph.
    """
    sc = scratch
    g = sc.cut(_simple(links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("w") > 0))), "links")
    names = sc.cut(g.select(F.col("a").alias("node")).union(g.select("b")).distinct().withColumn("name", F.col("node")), "names")
    for level in range(max_levels):
        if g.limit(1).count() == 0:
            return names
        f = sc.cut(attractors(g, sc, inflation, prune, salt=level), "attractors")
        to = F.when(F.col("alone"), F.col("near")).otherwise(F.col("name"))
        size = f.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(to).alias("to"), F.countDistinct("near").alias("near")).first()
        if size["to"] < size["n"]:
            step = f.select("node", to.alias("name"))
        elif size["near"] < size["n"]:  # only cycles of attractors are left
            step = f.select("node", F.col("near").alias("name"))
        else:  # every column has more equal links than it keeps
            both = g.select(F.col("a").alias("node"), F.col("b").alias("name")).union(g.select("b", "a"))
            step = both.groupBy("node").agg(F.least("node", F.min("name")).alias("name"))
        names = sc.cut(names.join(step.select(F.col("node").alias("name"), F.col("name").alias("to")), "name", "left").select("node", F.coalesce("to", "name").alias("name")), "names")
        g = sc.cut(contract(g, step), "links")
    raise RuntimeError("clusters did not settle")


class Clustering:
    """Markov clusters over a vector index, expanded to all vectors."""

    def __init__(self, index: Index, min_cos: float = MIN_COS):
        sc = self.sc = index.sc
        self.index = index
        found = sc.cut(first_level(index, min_cos))
        self.own = found.filter(F.col("kind") == OWN).select(F.col("a").alias("node"), F.col("b").alias("name"), F.col("w").alias("flow"))
        links = contract(found.filter(F.col("kind") == LINK).select("a", "b", "w"), self.own).union(found.filter(F.col("kind") == BETWEEN).select("a", "b", "w"))
        self.names = linked_clusters(links, sc)

    def members(self, least: int = 3) -> DataFrame:
        """(cluster, vec_id, flow) of every vector in a cluster of at least ``least`` vectors; ``cluster`` is the smallest vec_id of its members."""
        rep = self.index.members.join(self.own.select(F.col("node").alias("rep"), "name", "flow"), "rep", "left").select("vec_id", F.coalesce("name", "rep").alias("name"), F.coalesce("flow", F.lit(1.0)).alias("flow"))
        m = rep.join(self.names.select(F.col("node").alias("name"), F.col("name").alias("last")), "name", "left").select("vec_id", "flow", F.coalesce("last", "name").alias("name"))
        m = self.sc.cut(m)
        big = m.groupBy("name").agg(F.min("vec_id").alias("cluster"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        return m.join(big.select("name", "cluster"), "name").select("cluster", "vec_id", "flow")

    def sets(self, least: int = 3) -> DataFrame:
        """(cluster_first, vec_id)."""
        return self.members(least).select(F.col("cluster").alias("cluster_first"), "vec_id")


def describe_clusters(members: DataFrame, words: DataFrame, pos_of: DataFrame, typical: int = 3) -> DataFrame:
    """Size, most typical words with their part of speech, and most frequent part of speech of each cluster.

    ``members``: vec_id, cluster, flow; ``words``: vec_id, word; ``pos_of``:
    word, pos (unique). Typical are the members with the strongest flow, ties to
    the smaller vec_id; a word without a node has pos 'unknown'. Spark cuts the
    ranking off at ``typical`` before the shuffle, so a cluster of any size stays cheap.
    """
    m = members.join(words, "vec_id", "left").join(pos_of, "word", "left").withColumn("pos", F.coalesce("pos", F.lit("unknown")))
    by_pos = m.groupBy("cluster", "pos").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.sum("c").alias("n_members"), F.max_by("pos", F.struct("c", "pos")).alias("main_pos"))
    w = Window.partitionBy("cluster").orderBy(F.desc("flow"), "vec_id")
    first = m.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= typical)
    heads = first.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("at", "word", "pos"))).alias("h"))
    shown = F.concat_ws(", ", F.transform("h", lambda x: F.concat_ws("/", x["word"], x["pos"])))
    return heads.join(by_pos, "cluster").select("cluster", "n_members", shown.alias("typical_words"), "main_pos")
