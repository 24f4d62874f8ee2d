"""Curation of node and edge tables: every step is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import is_affix, is_proper_or_invalid, suffix_pos

NODE = ["word", "pos", "definition_hy", "animacy", "declension_class", "verb_transitivity", "aktionsart", "scraped_at"]
KEY = ["source", "relation", "target"]


def empty_to_blank(df: DataFrame) -> DataFrame:
    """Null strings to ''."""
    return df.na.fill("", [c for c, t in df.dtypes if t == "string"])


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order`` (a total order makes it reproducible); one aggregation, no window."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in by else F.col(f"_r.{c}") for c in df.columns])


def keep_last(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in by else F.col(f"_r.{c}") for c in df.columns])


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("word")).union(edges.select("target")).distinct()


def either_end_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end among the nodes; two hash joins against the distinct words, never a disjunctive join."""
    v = nodes.select("word").distinct()
    e = edges.join(v.select(F.col("word").alias("source"), F.lit(True).alias("_s")), "source", "left").join(v.select(F.col("word").alias("target"), F.lit(True).alias("_t")), "target", "left")
    return e.filter(F.coalesce("_s", "_t", F.lit(False))).select(*edges.columns)


def both_ends_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    v = nodes.select("word").distinct()
    return edges.join(v.withColumnRenamed("word", "source"), "source", "left_semi").join(v.withColumnRenamed("word", "target"), "target", "left_semi").select(*edges.columns)


def drop_shadowed(edges: DataFrame, weak: str = "derives_noun", strong: str = "nominalization") -> DataFrame:
    """Without the ``weak`` edges of pairs that have a ``strong`` one."""
    have = edges.filter(F.col("relation") == strong).select("source", "target").distinct()
    return edges.filter(F.col("relation") != weak).unionByName(edges.filter(F.col("relation") == weak).join(have, ["source", "target"], "left_anti").select(*edges.columns)).unionByName(edges.filter(F.col("relation").isNull()))


def missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placeholders (pos unknown, all else '') for ends without a node."""
    m = endpoints(edges).filter(F.col("word").isNotNull()).join(nodes.select("word"), "word", "left_anti")
    return m.select("word", *[F.lit("unknown" if c == "pos" else "").alias(c) for c in NODE[1:]])


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "word", "left_semi")


def curated_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph for analysis, in the fixed order of steps: first node per word, edges with a known end, first per key, no shadowed edges, placeholders, connected nodes only."""
    n = keep_first(empty_to_blank(nodes.select(*NODE)).filter("word <> ''"), ["word"], NODE[1:])
    e = keep_first(either_end_known(edges, n), KEY, [c for c in edges.columns if c not in KEY])
    e = drop_shadowed(e)
    return connected_only(n.unionByName(missing_nodes(n, e)), e), e


def fill_pos(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unknown endpoint parts of speech from the dictionary; known ones stay."""
    p = nodes.filter("pos <> '' AND pos <> 'unknown'").groupBy("word").agg(F.min("pos").alias("_p"))
    e = edges
    for end in ("source", "target"):
        e = e.join(p.select(F.col("word").alias(end), F.col("_p").alias(f"_{end}")), end, "left")
        c = f"{end}_pos"
        e = e.withColumn(c, F.when(F.coalesce(c, F.lit("")).isin("", "unknown"), F.coalesce(f"_{end}", F.lit("unknown"))).otherwise(F.col(c)))
    return e.select(*edges.columns)


def relabel(edges: DataFrame) -> DataFrame:
    """Old labels to present ones, and the class of each ('other' for labels that are not known)."""
    spark = edges.sparkSession
    new = F.broadcast(spark.createDataFrame(rules.RENAME_TABLE, "relation string, _new string"))
    cls = F.broadcast(spark.createDataFrame(rules.canonical_classes(), "relation string, _class string"))
    e = edges.join(new, "relation", "left").withColumn("relation", F.coalesce("_new", "relation")).join(cls, "relation", "left")
    return e.withColumn("relation_class", F.coalesce("_class", F.lit("other"))).select(*edges.columns)


def unknown_labels(edges: DataFrame) -> DataFrame:
    """(relation, n): labels that have no class after renaming, and how often each occurs."""
    cls = F.broadcast(edges.sparkSession.createDataFrame(rules.canonical_classes(), "relation string, _class string"))
    return relabel(edges).join(cls, "relation", "left_anti").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def fill_class(edges: DataFrame) -> DataFrame:
    """Empty classes from the builder's table, else 'other'."""
    t = F.broadcast(edges.sparkSession.createDataFrame(rules.BUILDER_CLASS, "relation string, _class string"))
    e = edges.join(t, "relation", "left")
    return e.withColumn("relation_class", F.when(F.coalesce("relation_class", F.lit("")) == "", F.coalesce("_class", F.lit("other"))).otherwise(F.col("relation_class"))).select(*edges.columns)


def appendable(edges: DataFrame) -> DataFrame:
    """Edges ready to be appended: a valid source, a class, the target's part of speech guessed from its ending where unknown."""
    e = fill_class(edges.filter(~is_proper_or_invalid("source") & ~is_affix("source")))
    e = suffix_pos(e, "target")
    return e.withColumn("target_pos", F.when(F.coalesce("target_pos", F.lit("")).isin("", "unknown"), F.col("guess")).otherwise(F.col("target_pos"))).select(*edges.columns)


def clean_outputs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Existing outputs without affixes and invalid words, classes filled, one edge per key."""
    n = nodes.filter(~is_proper_or_invalid("word") & ~is_affix("word"))
    e = edges
    for end in ("source", "target"):
        e = e.filter(~is_proper_or_invalid(end) & ~is_affix(end))
    e = fill_class(e)
    return n, keep_first(e, KEY, [c for c in e.columns if c not in KEY])


def dense_ids(words: DataFrame, out: str = "id") -> DataFrame:
    """0, 1, 2, ... in word order, without one task over all rows: a range-partitioned sort, a count per partition, and offsets."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = words.select("word").distinct().repartitionByRange(n, "word").sortWithinPartitions("word")
    s = s.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    from ..scratch import Scratch

    s = Scratch(words.sparkSession).cut(s)  # range borders are sampled: the table is written once
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    off = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))  # one row a partition
    return s.join(F.broadcast(off), "_part").select("word", (F.col("_off") + F.col("_m") - F.shiftleft("_part", 33)).cast("long").alias(out))


def label_ids(df: DataFrame, col: str, unknown: str = "<UNK>") -> DataFrame:
    """(label, label_id): dense ids of the sorted distinct labels and ``unknown``."""
    labels = df.select(F.coalesce(F.col(col), F.lit("")).alias("label")).union(df.sparkSession.createDataFrame([(unknown,)], "label string")).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"))  # a label dimension: few rows


def reversed_edges(edges: DataFrame, shift: int) -> DataFrame:
    """Typed integer edges (src, dst, etype) with their reverses, whose types are shifted."""
    return edges.select("src", "dst", "etype").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("etype") + shift).alias("etype")))


def content_hash(df: DataFrame) -> DataFrame:
    """n_rows and a hash of the rows that depends on no order: the sum of 32-bit row hashes."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")).alias("hash_sum"))
