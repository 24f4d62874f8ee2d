"""Connected components by iterative minimum-label propagation with pointer doubling.

Each round every node of the remaining graph takes the smallest label among
itself and its neighbours, labels are doubled (label of the label), and the
edges are rewritten to labels; loops and repeats vanish, so the graph shrinks
geometrically even on long chains. The maps of the rounds are put together once,
from the last to the first, so no round touches nodes that have settled. What a
single task can hold without doubt (``LOCAL`` links) is finished in one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

LOCAL = 50_000


def _local(batches):
    """All links in one task: (v, g) with ``g`` the smallest node of v's component."""
    parts = list(batches)
    if not parts or not sum(map(len, parts)):
        return
    e = pd.concat(parts)
    names, at = np.unique(np.concatenate([e["a"].to_numpy(), e["b"].to_numpy()]), return_inverse=True)
    a, b = at[: len(e)], at[len(e) :]
    lab = np.arange(len(names))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    yield pd.DataFrame({"v": names, "g": names[lab]})


def connected_components(links: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(a BIGINT, b BIGINT) to (node, component): one row per node on a link, ``component`` its smallest node.

    Rows with a null end are ignored; loops give a component of one node;
    repeated links count once; an empty table gives an empty result.
    """
    sc = scratch or Scratch(links.sparkSession)
    links = links.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = sc.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    alone = edges.filter("a = b").select(F.col("a").alias("v"), F.col("a").alias("g"))
    alone = sc.cut(alone)
    edges = sc.cut(edges.filter("a <> b"), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        n = edges.count()
        if n <= local:
            if n:
                maps.append(sc.cut(edges.coalesce(1).mapInPandas(_local, "v long, g long")))
            break
        both = edges.union(edges.select("b", "a"))
        near = sc.cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("f")), "near")
        two = near.join(near.select(F.col("v").alias("f"), F.col("f").alias("g")), "f").select("v", "g")  # v -> f(f(v))
        two = sc.cut(two)
        maps.append(two)
        e = edges.join(two.select(F.col("v").alias("a"), F.col("g").alias("ga")), "a").join(two.select(F.col("v").alias("b"), F.col("g").alias("gb")), "b")
        edges = sc.cut(e.filter("ga <> gb").select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return alone.select(F.col("v").alias("node"), F.col("g").alias("component"))
    out = maps[-1]
    for m in maps[-2::-1]:
        out = m.join(out.select(F.col("v").alias("g"), F.col("g").alias("g2")), "g", "left").select("v", F.coalesce("g2", "g").alias("g"))
    out = out.unionByName(alone.join(out.select("v"), "v", "left_anti").select("v", "g"))
    return sc.cut(out.select(F.col("v").alias("node"), F.col("g").alias("component")))
