"""Queries of the general graph problems: hierarchies and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import build_hierarchy, descendants, ring_members
from ..operators.orphans import edge_orphans, orphans_by_period
from ..operators.relations import parent_child_links
from .spelling_sql import REL, plain_ctes


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _links(spark, d):
    return parent_child_links(_t(spark, d, "edges"), _t(spark, d, "relation_names"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return build_hierarchy(_links(spark, d), with_parent=False).select("word", "root", "node_depth")


def p2_nested_sets(spark: SparkSession, d: str) -> DataFrame:
    h = build_hierarchy(_links(spark, d), with_path=True, with_parent=False)
    return h.select("word", "root", "node_depth", F.array_join("path", "/").alias("full_path"), F.col("size").alias("n_subtree"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(build_hierarchy(_links(spark, d), with_parent=False))


def p2_rings(spark: SparkSession, d: str) -> DataFrame:
    from ..scratch import Scratch

    sc = Scratch(spark)
    links = sc.cut(_links(spark, d))
    return ring_members(links, sc.cut(build_hierarchy(links, scratch=sc)), sc)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return edge_orphans(_t(spark, d, "edges"), _t(spark, d, "nodes"), _t(spark, d, "crawl_log")).select("edge_id", "side")


def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(edge_orphans(_t(spark, d, "edges"), _t(spark, d, "nodes"), _t(spark, d, "crawl_log")))


QUERIES = {f.__name__: f for f in (p2_found, p2_nested_sets, p2_descendants, p2_rings, p3_found, p3_by_period)}

_LINKS = f"""{plain_ctes("SELECT source AS w FROM edges UNION ALL SELECT target FROM edges")},
_e AS (SELECT a.p AS s, b.p AS t, r.inverse_of IS NOT NULL AS inv FROM edges e JOIN relation_names r ON r.label_name = {REL}
  JOIN plain a ON a.w = e.source JOIN plain b ON b.w = e.target
  WHERE e.source <> '' AND e.target <> '' AND e.relation <> '' AND r.relation_class <> 'compounding'),
links AS (SELECT child, min(parent) AS parent FROM (SELECT CASE WHEN inv THEN t ELSE s END AS parent, CASE WHEN inv THEN s ELSE t END AS child FROM _e) GROUP BY child),
tree AS (SELECT DISTINCT parent AS word, parent AS root, 0 AS node_depth, parent AS full_path FROM links WHERE parent NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, t.root, t.node_depth + 1, t.full_path || '/' || l.child FROM tree t JOIN links l ON l.parent = t.word)"""
_ORPHANS = f"""{plain_ctes("SELECT source AS w FROM edges UNION ALL SELECT target FROM edges UNION ALL SELECT word FROM nodes UNION ALL SELECT word FROM crawl_log")},
refs AS (SELECT edge_id, 'source' AS side, p AS word, added_at FROM edges JOIN plain ON w = source WHERE source <> ''
  UNION ALL SELECT edge_id, 'target', p, added_at FROM edges JOIN plain ON w = target WHERE target <> ''),
there AS (SELECT p AS word, CASE WHEN bool_or(scraped_at IS NULL) THEN NULL ELSE min(scraped_at::TIMESTAMPTZ AT TIME ZONE 'UTC') END AS since FROM nodes JOIN plain ON w = word WHERE word <> '' GROUP BY p),
dead AS (SELECT p AS word FROM (SELECT word AS lw, arg_max(status, (ts::TIMESTAMPTZ, ingested_at, status)) AS status FROM crawl_log GROUP BY word) JOIN plain ON w = lw WHERE status = 'deleted'),
orphans AS (SELECT r.*, CASE WHEN t.word IS NULL THEN 'missing' WHEN d.word IS NOT NULL THEN 'deleted' ELSE 'early' END AS reason FROM refs r
  LEFT JOIN there t ON t.word = r.word LEFT JOIN dead d ON d.word = r.word WHERE t.word IS NULL OR d.word IS NOT NULL OR r.added_at < t.since)"""

ORACLES = {
    "p2_found": f"WITH RECURSIVE {_LINKS} SELECT word, root, node_depth FROM tree UNION ALL SELECT child, '', -1 FROM links WHERE child NOT IN (SELECT word FROM tree)",
    "p2_nested_sets": f"""WITH RECURSIVE {_LINKS}, up AS (SELECT word AS a, word AS w FROM tree UNION ALL SELECT l.parent, u.w FROM up u JOIN links l ON l.child = u.a),
        sizes AS (SELECT a AS word, count(*) AS n FROM up GROUP BY a)
        SELECT word, root, node_depth, full_path, n AS n_subtree FROM tree JOIN sizes USING (word) UNION ALL SELECT child, '', -1, NULL, NULL FROM links WHERE child NOT IN (SELECT word FROM tree)""",
    "p2_descendants": f"""WITH RECURSIVE {_LINKS}, up AS (SELECT l.parent AS a, t.word AS w, 1 AS n FROM tree t JOIN links l ON l.child = t.word UNION ALL SELECT l.parent, u.w, u.n + 1 FROM up u JOIN links l ON l.child = u.a)
        SELECT a AS ancestor, w AS descendant, n AS distance FROM up""",
    "p2_rings": f"""WITH RECURSIVE {_LINKS}, lost AS (SELECT child, parent FROM links WHERE child NOT IN (SELECT word FROM tree)),
        up AS (SELECT child AS w, parent AS a FROM lost UNION SELECT u.w, l.parent FROM up u JOIN lost l ON l.child = u.a)
        SELECT min(a) AS ring_first, w AS word FROM up WHERE w IN (SELECT v.a FROM up v WHERE v.w = up.w) GROUP BY w""",
    "p3_found": f"WITH {_ORPHANS} SELECT edge_id, side FROM orphans",
    "p3_by_period": f"WITH {_ORPHANS} SELECT side, date_trunc('month', added_at) AS period, reason, count(*) AS n_refs, count(DISTINCT word) AS n_words FROM orphans GROUP BY ALL",
}
