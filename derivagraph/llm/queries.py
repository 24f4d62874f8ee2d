"""Queries of the training-data problems, with oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spelling import filled, plain_spelling
from ..operators.orphans import parse_instant
from ..plans.spelling_sql import REL, plain_ctes
from ..scratch import Scratch
from . import clusters, family_split, leakage, lookalike, mixture, neighbours, overlap, reading

VECTOR = [f"c{i}" for i in range(64)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _overlaps(spark, d):
    return overlap.overlaps(overlap.records(_t(spark, d, "negative_samples"), _t(spark, d, "relation_names")), Scratch(spark))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(*_overlaps(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_overlaps(spark, d))


def _strings(spark, d):
    e = _t(spark, d, "edges")
    return lookalike.field_strings((_t(spark, d, "nodes"), "word"), (e, "source"), (e, "target"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.not_plain(_strings(spark, d))


def p4_variants(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.variant_groups(_strings(spark, d))


def _index(spark, d):
    return neighbours.Index(neighbours.vector_table(_t(spark, d, "embeddings_gcn"), VECTOR), Scratch(spark))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.Clustering(_index(spark, d)).sets()


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.Clustering(_index(spark, d))
    words = _t(spark, d, "embeddings_gcn").select("vec_id", plain_spelling("word").alias("word"))
    n = _t(spark, d, "nodes").filter(filled("word", "pos") & (F.col("pos") != "unknown"))
    pos = n.select(plain_spelling("word").alias("word"), "pos", parse_instant("scraped_at").alias("at"), "node_id").groupBy("word").agg(F.max_by("pos", F.struct("at", "node_id")).alias("pos"))
    return clusters.describe_clusters(c.members(), words, pos)


def _families(spark, d, sc):
    return sc.cut(family_split.families(_t(spark, d, "edges"), _t(spark, d, "relation_names"), sc))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d, Scratch(spark)).select("group_first", "edge_id")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    sc = Scratch(spark)
    f = _families(spark, d, sc)
    return family_split.split_edges(f, family_split.assign_splits(f, sc))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return family_split.split_report(p6_splits(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(_index(spark, d)))


def p7_word_lists(spark: SparkSession, d: str) -> DataFrame:
    """The reported neighbour lists of results_ensemble against the nearest vectors: hits per reported list."""
    near = neighbours.nearest(_index(spark, d))
    words = _t(spark, d, "embeddings_gcn").filter(filled("word")).select("vec_id", plain_spelling("word").alias("word"))
    pairs = near.join(words, "vec_id").join(words.select(F.col("vec_id").alias("neighbour"), F.col("word").alias("near_word")), "neighbour").select("word", "near_word").distinct()
    r = _t(spark, d, "results_ensemble").select("seed", "model", "mode", F.explode("nn_results").alias("word", "listed")).filter(F.col("listed").isNotNull())
    r = r.select("seed", "model", "mode", "word", F.explode_outer(F.array_distinct("listed")).alias("near_word"))
    hit = r.join(pairs.withColumn("hit", F.lit(1)), ["word", "near_word"], "left")
    return hit.groupBy("seed", "model", "mode", "word").agg(F.count("near_word").alias("n_listed"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_confirmed"))


def _leaks(spark, d):
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d), _t(spark, d, "eval_items"))


def _mixture(spark, d):
    return mixture.Mixture(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), Scratch(spark))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).rows()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def _levels(spark, d, *keep):
    return reading.reading_levels(_t(spark, d, "documents"), _t(spark, d, "level_labels"), Scratch(spark), keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter("reading_level = 'advanced'").select("doc_id")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    f = _levels(spark, d, "source").withColumn("source", F.lower(F.trim("source")))
    return reading.profile(f, "source")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_report, p4_found, p4_variants, p5_found, p5_clusters, p6_found, p6_splits, p6_shares, p7_found, p7_word_lists, p8_found, p8_report, p9_mixture, p9_shares, p10_found, p10_profile)
}

_P1 = f"""{plain_ctes("SELECT source AS w FROM negative_samples UNION ALL SELECT target FROM negative_samples")},
recs AS (SELECT sample_id, split, a.p AS s, r.canonical AS rel, b.p AS t FROM negative_samples n JOIN relation_names r ON r.label_name = {REL} JOIN plain a ON a.w = source JOIN plain b ON b.w = target WHERE source <> '' AND target <> '')"""
_FAMILIES = f"""{plain_ctes("SELECT source AS w FROM edges UNION ALL SELECT target FROM edges")},
_e AS (SELECT edge_id, a.p AS s, b.p AS t, r.canonical AS label, r.relation_class <> 'compounding' AS tie FROM edges e JOIN relation_names r ON r.label_name = {REL}
  JOIN plain a ON a.w = e.source JOIN plain b ON b.w = e.target WHERE e.source <> '' AND e.target <> '' AND e.relation <> ''),
_l AS (SELECT DISTINCT s AS a, t AS b FROM _e WHERE tie UNION SELECT DISTINCT t, s FROM _e WHERE tie),
_r AS (SELECT DISTINCT t AS a, t AS b FROM _e UNION SELECT r.a, l.b FROM _r r JOIN _l l ON l.a = r.b),
_f AS (SELECT a AS t, min(b) AS family FROM _r GROUP BY a),
fam AS (SELECT edge_id, label, min(edge_id) OVER (PARTITION BY family) AS group_first FROM _e JOIN _f USING (t))"""
_STRINGS = "SELECT word AS w FROM nodes WHERE word <> '' UNION ALL SELECT source FROM edges WHERE source <> '' UNION ALL SELECT target FROM edges WHERE target <> ''"
_V = ", ".join(f"c{i}" for i in range(64))
_VECTORS = f"""_v AS (SELECT vec_id, list_transform([{_V}], lambda x: x::DOUBLE) AS v FROM embeddings_gcn),
_u AS (SELECT vec_id, v FROM _v WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
_c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM _u a JOIN _u b ON a.vec_id <> b.vec_id),
sim AS (SELECT * FROM _c WHERE s >= 0.87)"""


def _one_edit(a: str, b: str) -> str:
    """At most one letter replaced, missing or added (DuckDB's levenshtein counts bytes)."""

    def cut(x):
        return f"(left({x}, i) || substr({x}, i + 2))"

    return f"({a} = {b} OR len(list_filter(range(0, length({a}) + 1), lambda i: {cut(a)} = {cut(b)} OR {cut(a)} = {b} OR {cut(b)} = {a})) > 0)"


ORACLES = {
    "p1_found": f"""WITH {_P1} SELECT least(a.sample_id, b.sample_id) AS sample_a, greatest(a.sample_id, b.sample_id) AS sample_b
        FROM recs a JOIN recs b ON a.rel = b.rel AND a.s = b.s AND {_one_edit('a.t', 'b.t')} WHERE a.split = 'train' AND b.split <> 'train'
        UNION SELECT least(a.sample_id, b.sample_id), greatest(a.sample_id, b.sample_id)
        FROM recs a JOIN recs b ON a.rel = b.rel AND a.t = b.t AND {_one_edit('a.s', 'b.s')} WHERE a.split = 'train' AND b.split <> 'train'""",
    "p1_report": f"""WITH {_P1}, hit AS (SELECT b.sample_id, max(length(a.s) + length(a.t) > length(b.s) + length(b.t) OR (a.s = b.s AND a.t = b.t)) AS whole, max(a.s = b.s AND a.t = b.t) AS same
        FROM recs a JOIN recs b ON a.rel = b.rel AND ((a.s = b.s AND {_one_edit('a.t', 'b.t')}) OR (a.t = b.t AND {_one_edit('a.s', 'b.s')})) WHERE a.split = 'train' AND b.split <> 'train' GROUP BY b.sample_id)
        SELECT split, s AS source, count(*) AS n_rows, count(h.sample_id) AS n_overlapping, coalesce(sum(same::INT), 0)::BIGINT AS n_same,
        round(coalesce(avg(CASE WHEN whole THEN 1.0 WHEN h.sample_id IS NOT NULL THEN (length(s) + length(t) - 1)::DOUBLE / (length(s) + length(t)) END), 0), 6) AS mean_coverage
        FROM recs r LEFT JOIN hit h USING (sample_id) WHERE split <> 'train' GROUP BY split, s""",
    "p4_found": f"WITH {plain_ctes(_STRINGS)} SELECT w AS written, p AS plain FROM plain WHERE w <> p",
    "p4_variants": f"WITH {plain_ctes(_STRINGS)}, n AS (SELECT w, count(*) AS n FROM ({_STRINGS}) GROUP BY w) SELECT p AS plain, count(*) AS n_forms, sum(n)::BIGINT AS n_rows FROM n JOIN plain USING (w) GROUP BY p HAVING count(*) > 1",
    "p5_found": f"""WITH RECURSIVE {_VECTORS}, _r AS (SELECT a, a AS b FROM sim UNION SELECT r.a, s.b FROM _r r JOIN sim s ON s.a = r.b),
        _m AS (SELECT a AS vec_id, min(b) AS cluster_first FROM _r GROUP BY a)
        SELECT cluster_first, vec_id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_first) AS n FROM _m) WHERE n >= 3""",
    "p6_found": f"WITH RECURSIVE {_FAMILIES} SELECT group_first, edge_id FROM fam",
    "p7_found": f"""WITH {_VECTORS} SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM sim) WHERE rn <= 5""",
}
