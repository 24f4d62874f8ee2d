"""Train, validation and test splits that keep related records together.

Records (edges) and entities (plain words) form a bipartite graph. Minimum-label
propagation names each connected set of entities; every record belongs to the
set (family) of its target. Families are then placed whole: the few large ones
one by one where they leave the label distribution of the splits closest to the
targets, all others by their place in a running total per stratum, which needs
no list of families anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spelling import filled, plain_spelling
from ..operators.components import connected_components
from ..operators.orphans import order_ids
from ..operators.ranks import running_sums
from ..operators.relations import with_relation
from ..scratch import Scratch

SHARES = (("train", 0.8), ("val", 0.1), ("test", 0.1))
#: Families of at least 1 / LARGE of all records are placed one by one; there are at most LARGE of them.
LARGE = 1_000


def families(edges: DataFrame, names: DataFrame, scratch: Scratch, excluded_class: str = "compounding") -> DataFrame:
    """(edge_id, label, group_first) for every edge without an empty source, target or relation.

    ``label`` is the canonical relation (the bare label where it is not listed;
    such an edge ties nothing together). ``group_first`` is the smallest edge_id
    of the family's edges. Repeated rows stay rows; a word on no tying edge is a
    family alone; an empty table gives an empty result.
    """
    e = with_relation(edges.filter(filled("source", "target", "relation") & F.col("edge_id").isNotNull()).select("edge_id", "source", "target", "relation"), names)
    tie = F.col("_class").isNotNull() & (F.col("_class") != excluded_class)
    e = scratch.cut(e.select("edge_id", F.coalesce("_canonical", "_label").alias("label"), tie.alias("tie"), plain_spelling("source").alias("s"), plain_spelling("target").alias("t")))
    firsts = e.groupBy(F.col("t").alias("word")).agg(F.min("edge_id").alias("first"))  # before the families are known: one row a word from here on
    pairs = e.filter("tie").select("s", "t").distinct()
    words = scratch.cut(firsts.unionByName(pairs.select(F.col("s").alias("word"), F.lit(None).cast("long").alias("first"))).groupBy("word").agg(F.min("first").alias("first")))
    ids = order_ids(words, scratch)
    # record - entity links, written as pairs of entities of one record
    key = ids.select("word", "id")
    pairs = pairs.join(key.select(F.col("word").alias("s"), F.col("id").alias("a")), "s").join(key.select(F.col("word").alias("t"), F.col("id").alias("b")), "t").select("a", "b")
    parts = connected_components(pairs, scratch)
    fam = scratch.cut(ids.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("word", "first", F.coalesce("component", "id").alias("family")))
    head = fam.groupBy("family").agg(F.min("first").alias("group_first"))
    fam = fam.filter(F.col("first").isNotNull()).join(head, "family").select(F.col("word").alias("t"), "group_first")
    return e.select("edge_id", "label", "t").join(fam, "t").select("edge_id", "label", "group_first")


def _place_large(large: list[tuple[int, int, dict[str, int]]], labels: dict[str, int], shares) -> dict[int, str]:
    """Large families first to last by size, each where the squared deviation of the splits' label counts grows least."""
    total = sum(labels.values())
    have = {s: dict.fromkeys(labels, 0.0) for s, _ in shares}
    out = {}
    for first, _size, dist in sorted(large, key=lambda x: (-x[1], x[0])):
        best = None
        for s, share in shares:
            cost = 0.0
            for lab, n in dist.items():
                want = share * labels[lab]
                cost += ((have[s][lab] + n - want) ** 2 - (have[s][lab] - want) ** 2) / max(want, 1.0)
            got = sum(have[s].values())
            size = sum(dist.values())
            cost += ((got + size - share * total) ** 2 - (got - share * total) ** 2) / max(share * total, 1.0)
            if best is None or cost < best[0]:
                best = (cost, s)
        out[first] = best[1]
        for lab, n in dist.items():
            have[best[1]][lab] += n
    return out


def assign_splits(fams: DataFrame, scratch: Scratch, shares=SHARES) -> DataFrame:
    """(group_first, n, split) of every family.

    A family's stratum is its most frequent label. Within a stratum the small
    families lie one after another in hashed order, and each goes to the split in
    whose range its middle falls; the ranges are the shares less what the large
    families hold already. Running totals go over range partitions, so that a
    stratum with most of the rows is no single task.
    """
    spark = fams.sparkSession
    fams = scratch.cut(fams)
    per = fams.groupBy("group_first", "label").agg(F.count(F.lit(1)).alias("c"))
    g = scratch.cut(per.groupBy("group_first").agg(F.sum("c").alias("n"), F.max_by("label", F.struct("c", "label")).alias("stratum")))
    labels = {r["label"]: r["c"] for r in per.groupBy("label").agg(F.sum("c").alias("c")).collect()}  # one row a relation label
    total = sum(labels.values())
    bar = max(2, total // LARGE)
    big = g.filter(F.col("n") >= bar)
    rows = per.join(F.broadcast(big.select("group_first", "n")), "group_first").collect()  # at most LARGE families
    large: dict[int, tuple[int, int, dict]] = {}
    for r in rows:
        large.setdefault(r["group_first"], (r["group_first"], r["n"], {}))[2][r["label"]] = r["c"]
    placed = _place_large(list(large.values()), labels, shares)
    held = {s: sum(large[f][1] for f, t in placed.items() if t == s) for s, _ in shares}
    rest = {s: max(0.0, share * total - held[s]) for s, share in shares}
    whole = sum(rest.values()) or 1.0

    small = g.filter(F.col("n") < bar).withColumn("h", F.xxhash64(F.lit("split"), "group_first"))
    small = running_sums(small, F.struct("stratum", "h", "group_first"), {"upto": "n"})
    strata = scratch.cut(small.groupBy("stratum").agg(F.sum("n").alias("all")))  # one row a label
    before = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("stratum", "all", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    small = small.join(F.broadcast(strata), "stratum")
    x = (F.col("upto") - F.col("base") - F.col("n") / 2) / F.col("all")
    split, upto = F.lit(shares[-1][0]), 1.0
    for s, _ in shares[::-1][1:]:
        upto = sum(rest[t] for t, _ in shares[: [t for t, _ in shares].index(s) + 1]) / whole
        split = F.when(x < upto, s).otherwise(split)
    small = small.select("group_first", "n", split.alias("split"))
    where = spark.createDataFrame(list(placed.items()), "group_first long, split string")
    return small.unionByName(big.select("group_first", "n").join(F.broadcast(where), "group_first").select("group_first", "n", "split"))


def split_edges(fams: DataFrame, splits: DataFrame) -> DataFrame:
    """(edge_id, group_first, label, split)."""
    return fams.join(splits.select("group_first", "split"), "group_first").select("edge_id", "group_first", "label", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """Per split and label: rows and the label's share in the split; label '' is the split as a whole with its share of all rows."""
    by = assigned.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))
    each = by.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("split")))
    tot = by.groupBy("split").agg(F.sum("n_rows").alias("n_rows"))
    tot = tot.join(F.broadcast(tot.agg(F.sum("n_rows").alias("_all")))).select("split", F.lit("").alias("label"), "n_rows", (F.col("n_rows") / F.col("_all")).alias("share"))
    return each.unionByName(tot).withColumn("share", F.round("share", 6))
