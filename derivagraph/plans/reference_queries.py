"""Queries of the graph pipeline's own operators, each beside an oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.hashing import draw
from ..operators import curate, derive, graph, layers, metrics, sampling, search
from ..operators.components import connected_components
from ..scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EMB = [f"c{i}" for i in range(64)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# The common inputs: tables with blanks for nulls, labels trimmed and lowered, rows without a key field left out.
def _nodes(spark, d):
    return curate.empty_to_blank(_t(spark, d, "nodes")).filter("word <> ''")


def _edges(spark, d):
    e = curate.empty_to_blank(_t(spark, d, "edges")).withColumn("relation", F.lower(F.trim("relation")))
    return e.filter("source <> '' AND target <> '' AND relation <> ''")


def _graph(spark, d):
    """One row per (source, relation, target)."""
    return curate.keep_first(_edges(spark, d), curate.KEY, ["edge_id"])


def _small(spark, d):
    """Derivation links without compounds: what recursion in SQL can follow; the oracles of the queries named _small (and i9_random_walks) run on it."""
    return _graph(spark, d).filter("relation_class <> 'compounding' AND relation NOT LIKE '%compound%'")


def _vectors(spark, d):
    """(word, vec): the usable vector with the smallest id of each word."""
    v = _t(spark, d, "embeddings_gcn")
    bad = F.exists(F.array(*EMB), lambda x: x.isNull() | F.isnan(x))
    zero = F.forall(F.array(*EMB), lambda x: x == 0)
    v = v.filter(~bad & ~zero & F.col("word").isNotNull() & (F.col("word") != ""))
    vec = F.array(*[F.col(c).cast("double") for c in EMB])
    return v.groupBy("word").agg(F.min_by(vec, "vec_id").alias("vec"))


def _scored(spark, d):
    """Orders as scored pairs: the label is the status, the score a price in hundreds (with ties)."""
    o = _t(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    return o.select((F.col("o_orderstatus") == "F").cast("int").alias("label"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("score"))


def _seeds(spark, d):
    r = _t(spark, d, "results_ensemble").withColumn("mode", F.coalesce("mode", F.lit("")))
    return metrics.long_metrics(r.select("seed", "model", "mode", "ari", "nmi", "silhouette"), ["ari", "nmi", "silhouette"], ["seed", "model", "mode"])


_N = "n AS (SELECT * REPLACE (coalesce(pos, '') AS pos, coalesce(definition_hy, '') AS definition_hy, coalesce(animacy, '') AS animacy, coalesce(declension_class, '') AS declension_class, coalesce(verb_transitivity, '') AS verb_transitivity, coalesce(aktionsart, '') AS aktionsart, coalesce(scraped_at, '') AS scraped_at) FROM nodes WHERE word <> '')"
_E = "e AS (SELECT edge_id, source, coalesce(source_pos, '') AS source_pos, lower(trim(relation)) AS relation, coalesce(relation_class, '') AS relation_class, target, coalesce(target_pos, '') AS target_pos, added_at FROM edges WHERE source <> '' AND target <> '' AND lower(trim(relation)) <> '')"
_G = f"{_E}, g AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY edge_id) = 1)"
_S = f"{_G}, s AS (SELECT * FROM g WHERE relation_class <> 'compounding' AND relation NOT LIKE '%compound%')"
_P = "p AS (SELECT DISTINCT source, target FROM g)"
_V = f"""v AS (SELECT word, arg_min(vec, vec_id) AS vec FROM (SELECT word, vec_id, list_transform([{', '.join(EMB)}], lambda x: x::DOUBLE) AS vec FROM embeddings_gcn WHERE word <> '')
  WHERE len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY word)"""
_SCORED = "sc AS (SELECT (o_orderstatus = 'F')::INT AS label, floor(o_totalprice / 100)::DOUBLE AS score FROM orders WHERE o_orderstatus IN ('F', 'O'))"
_LONG = "lm AS (SELECT seed, model, coalesce(mode, '') AS mode, u.metric, u.value FROM results_ensemble, LATERAL (VALUES ('ari', ari), ('nmi', nmi), ('silhouette', silhouette)) u(metric, value))"


def _draw(seed, *cols):
    return f"('0x' || substr(md5('{seed}|' || {' || chr(124) || '.join(cols)}), 1, 15))::BIGINT"


def _values(rows, cols):
    esc = lambda x: str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(esc(x) for x in r) + ')' for r in rows)}) t({cols})"


_RENAMES = f"ren AS (SELECT * FROM {_values(rules.RENAME_TABLE, 'old, new')})"
_CLASSES = f"cls AS (SELECT * FROM {_values(rules.canonical_classes(), 'relation, class')})"
_BCLASS = f"bcls AS (SELECT * FROM {_values(rules.BUILDER_CLASS, 'relation, class')})"
_SUFPOS = f"sufpos AS (SELECT * FROM {_values(rules.SUFFIX_POS, 'suffix, pos, rank')})"
_AFF = ", ".join(f"'{x}'" for x in rules.AFFIXES)


def _invalid(w):
    return rf"(length({w}) < 2 OR regexp_matches({w}, '\p{{Nd}}') OR regexp_matches({w}, '^[\x{{0531}}-\x{{0556}}]'))"


# ---- A: scans, sinks, runs -------------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT word FROM nodes WHERE word <> '' AND NOT {_invalid('word')} AND word NOT IN ({_AFF})")
def a3_dictionary_words(spark, d):
    n = _t(spark, d, "nodes").filter("word <> ''").select(F.split_part("word", F.lit("/"), F.lit(1)).alias("word"))
    return n.filter(~text.is_proper_or_invalid("word") & ~text.is_affix("word") & ~F.col("word").isin(rules.BORROWINGS.split())).distinct()


@query(f"WITH {_N} SELECT node_id, word, pos, definition_hy, animacy, declension_class, verb_transitivity, aktionsart, scraped_at FROM n")
def a4_read_blank(spark, d):
    return _nodes(spark, d)


@query("SELECT to_json({'word': word, 'status': status, 'n_edges': n_edges}) AS line, count(*) AS n FROM crawl_log WHERE word IS NOT NULL AND status IS NOT NULL AND n_edges IS NOT NULL GROUP BY 1")
def a6_log_lines(spark, d):
    c = _t(spark, d, "crawl_log").filter("word IS NOT NULL AND status IS NOT NULL AND n_edges IS NOT NULL")
    return c.select(F.to_json(F.struct("word", "status", "n_edges")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (row_number() OVER (ORDER BY word) - 1) // 50 AS batch, word FROM (SELECT DISTINCT word FROM crawl_log WHERE word IS NOT NULL)")
def a2_fetch_batches(spark, d):
    ids = curate.dense_ids(_t(spark, d, "crawl_log").filter("word IS NOT NULL"))
    return ids.select(F.floor(F.col("id") / 50).alias("batch"), "word")


@query("SELECT DISTINCT seed, model FROM results_ensemble a WHERE NOT EXISTS (SELECT 1 FROM results_ensemble b WHERE b.seed = a.seed AND b.mode = 'gate' AND b.ari > 0.05)")
def a9_seeds_to_do(spark, d):
    r = _t(spark, d, "results_ensemble")
    return r.select("seed", "model").distinct().join(r.filter("mode = 'gate' AND ari > 0.05").select("seed"), "seed", "left_anti")


@query(f"WITH {_N}, {_V} SELECT w.word, round(coalesce(list_sum(v.vec), 0), 4) AS total, coalesce(len(v.vec), 0) AS dim FROM (SELECT DISTINCT word FROM n) w LEFT JOIN v USING (word)")
def a10_embedding_reindex(spark, d):
    j = _nodes(spark, d).select("word").distinct().join(_vectors(spark, d), "word", "left")
    return j.select("word", F.round(F.coalesce(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), 4).alias("total"), F.coalesce(F.size("vec"), F.lit(0)).alias("dim"))


@query(f"WITH {_LONG} SELECT seed, model, mode, metric, value FROM lm")
def a11_results_long(spark, d):
    return _seeds(spark, d)


@query("SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', coalesce(relation, ''), coalesce(source, ''), coalesce(target, ''))), 1, 8))::BIGINT)::BIGINT AS hash_sum FROM edges")
def a12_content_hash(spark, d):
    return curate.content_hash(_t(spark, d, "edges").select("source", "relation", "target"))


@query(f"WITH {_G}, v AS (SELECT DISTINCT word FROM nodes WHERE word <> '') SELECT DISTINCT source, target FROM negative_samples x WHERE split = 'val' AND label = 0 AND source IN (SELECT word FROM v) AND target IN (SELECT word FROM v) AND NOT EXISTS (SELECT 1 FROM g WHERE g.source = x.source AND g.target = x.target)")
def a14_custom_negatives(spark, d):
    return sampling.custom_negatives(_t(spark, d, "negative_samples"), _graph(spark, d), _nodes(spark, d), "val")


@query(f"""WITH {_E}, {_BCLASS} SELECT source, relation, target, arg_min(CASE WHEN relation_class = '' THEN coalesce(class, 'other') ELSE relation_class END, edge_id) AS relation_class
  FROM e LEFT JOIN bcls USING (relation) WHERE NOT {_invalid('source')} AND NOT {_invalid('target')} AND source NOT IN ({_AFF}) AND target NOT IN ({_AFF}) GROUP BY source, relation, target""")
def a15_clean_outputs(spark, d):
    _, e = curate.clean_outputs(_nodes(spark, d), _edges(spark, d).select("edge_id", *derive.EDGE))
    return e.select("source", "relation", "target", "relation_class")


# ---- B: projections, filters, predicates -----------------------------------------------------------------------------
@query(f"SELECT node_id, word FROM nodes WHERE word IS NULL OR {_invalid('word')}")
def b1_proper_or_invalid(spark, d):
    return _t(spark, d, "nodes").filter(text.is_proper_or_invalid("word")).select("node_id", "word")


@query(f"SELECT DISTINCT word FROM nodes WHERE word IS NOT NULL AND NOT {_invalid('word')} AND word NOT IN ({_AFF})")
def b2_valid_nodes(spark, d):
    return _t(spark, d, "nodes").filter(~text.is_proper_or_invalid("word") & ~text.is_affix("word")).select("word").distinct()


_KNOWN = f"""lex AS (SELECT word, coalesce(min(CASE WHEN pos <> 'unknown' THEN pos END), 'unknown') AS pos FROM (SELECT word, CASE WHEN coalesce(pos, '') = '' THEN 'unknown' ELSE pos END AS pos FROM nodes WHERE word <> '') GROUP BY word),
lexr AS (SELECT * FROM lex UNION ALL SELECT r, 'unknown' FROM (SELECT DISTINCT unnest([{', '.join(f"'{x}'" for x in rules.ROOTS)}]) AS r) WHERE r NOT IN (SELECT word FROM lex)),
known AS (SELECT * FROM lexr WHERE length(word) >= 2 AND word NOT IN ({_AFF}) AND word NOT IN ({', '.join(f"'{x}'" for x in rules.BORROWINGS.split())})),
knownc AS (SELECT * FROM known WHERE pos <> 'unknown' OR word IN ({', '.join(f"'{x}'" for x in rules.ROOTS)}))"""


def _lexicon(spark, d):
    n = _t(spark, d, "nodes").filter("word <> ''").select("word", F.when(F.coalesce("pos", F.lit("")) == "", "unknown").otherwise(F.col("pos")).alias("pos"))
    return derive.Lexicon(n)


@query(f"WITH {_KNOWN} SELECT word, pos FROM known")
def b3_known_words(spark, d):
    return _lexicon(spark, d).known.select("word", "pos")


@query(f"WITH {_KNOWN} SELECT word, pos FROM knownc")
def b4_known_for_compounds(spark, d):
    return _lexicon(spark, d).known_compound.select("word", "pos")


@query(f"WITH {_E}, {_N} SELECT edge_id FROM e WHERE source IN (SELECT word FROM n) OR target IN (SELECT word FROM n)")
def b5_either_end_known(spark, d):
    return curate.either_end_known(_edges(spark, d), _nodes(spark, d)).select("edge_id")


@query(f"WITH {_E}, {_N} SELECT node_id FROM n WHERE word IN (SELECT source FROM e UNION SELECT target FROM e)")
def b6_connected_nodes(spark, d):
    return curate.connected_only(_nodes(spark, d), _edges(spark, d)).select("node_id")


@query("SELECT edge_id, regexp_extract(source, '([\\x{0531}-\\x{0556}\\x{0561}-\\x{0587}-]+)', 1) AS clean FROM edges WHERE regexp_extract(source, '([\\x{0531}-\\x{0556}\\x{0561}-\\x{0587}-]+)', 1) <> ''")
def b7_nonempty_keys(spark, d):
    e = _t(spark, d, "edges").select("edge_id", F.regexp_extract(F.coalesce("source", F.lit("")), "([Ա-Ֆա-և-]+)", 1).alias("clean"))
    return e.filter(F.length("clean") > 0)


@query(f"WITH {_E}, {_CLASSES} SELECT relation, count(*) AS n FROM e WHERE relation IN (SELECT relation FROM cls) GROUP BY relation")
def b8_relations_in_vocabulary(spark, d):
    known = F.broadcast(spark.createDataFrame(rules.canonical_classes(), "relation string, class string"))
    return _edges(spark, d).join(known, "relation", "left_semi").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_E}, {_N}, p AS (SELECT word, min(pos) AS pos FROM n WHERE pos NOT IN ('', 'unknown') GROUP BY word)
  SELECT edge_id, CASE WHEN source_pos IN ('', 'unknown') THEN coalesce(a.pos, 'unknown') ELSE source_pos END AS source_pos, CASE WHEN target_pos IN ('', 'unknown') THEN coalesce(b.pos, 'unknown') ELSE target_pos END AS target_pos
  FROM e LEFT JOIN p a ON a.word = source LEFT JOIN p b ON b.word = target""")
def b9_pos_backfill(spark, d):
    return curate.fill_pos(_edges(spark, d), _nodes(spark, d)).select("edge_id", "source_pos", "target_pos")


@query(f"WITH {_E}, {_BCLASS} SELECT edge_id, CASE WHEN relation_class = '' THEN coalesce(class, 'other') ELSE relation_class END AS relation_class FROM e LEFT JOIN bcls USING (relation)")
def b10_class_backfill(spark, d):
    return curate.fill_class(_edges(spark, d)).select("edge_id", "relation_class")


@query(f"WITH {_E}, {_RENAMES}, {_CLASSES}, x AS (SELECT edge_id, coalesce(new, relation) AS relation FROM e LEFT JOIN ren ON old = relation) SELECT edge_id, relation, coalesce(class, 'other') AS relation_class FROM x LEFT JOIN cls USING (relation)")
def b11_relabel(spark, d):
    return curate.relabel(_edges(spark, d)).select("edge_id", "relation", "relation_class")


@query(f"WITH {_E}, {_RENAMES}, {_CLASSES}, x AS (SELECT coalesce(new, relation) AS relation FROM e LEFT JOIN ren ON old = relation) SELECT relation, count(*) AS n FROM x WHERE relation NOT IN (SELECT relation FROM cls) GROUP BY relation")
def b11_unknown_labels(spark, d):
    return curate.unknown_labels(_edges(spark, d))


@query(f"WITH {_E}, {_BCLASS} SELECT edge_id, trim(source, ' ') AS source, relation, coalesce(class, 'other') AS relation_class, trim(target, ' ') AS target FROM e LEFT JOIN bcls USING (relation)")
def b12_edge_rows(spark, d):
    e = curate.fill_class(_edges(spark, d).withColumn("relation_class", F.lit("")))
    return e.select("edge_id", F.trim("source").alias("source"), "relation", "relation_class", F.trim("target").alias("target"))


@query(f"WITH {_N} SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM n)")
def b13_dense_ids(spark, d):
    return curate.dense_ids(_nodes(spark, d))


@query("SELECT avg(c_acctbal)::DECIMAL(18, 4)::DOUBLE AS c_acctbal, avg(c_custkey)::DECIMAL(18, 4)::DOUBLE AS c_custkey, avg(c_nationkey)::DECIMAL(18, 4)::DOUBLE AS c_nationkey FROM customer")
def b14_numeric_columns(spark, d):
    c = _t(spark, d, "customer")
    numeric = [n for n, t in c.dtypes if t in ("int", "bigint", "float", "double")]
    return c.agg(*[F.round(F.avg(n), 4).alias(n) for n in numeric])


# ---- C: joins --------------------------------------------------------------------------------------------------------
@query(f"WITH {_G}, {_N}, i AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM n)) SELECT edge_id, a.id AS src, b.id AS dst FROM g JOIN i a ON a.word = source JOIN i b ON b.word = target")
def c2_edge_ids(spark, d):
    i = curate.dense_ids(_nodes(spark, d))
    return _graph(spark, d).join(i.select(F.col("word").alias("source"), F.col("id").alias("src")), "source").join(i.select(F.col("word").alias("target"), F.col("id").alias("dst")), "target").select("edge_id", "src", "dst")


@query(f"WITH {_E}, {_N} SELECT edge_id FROM e WHERE source IN (SELECT word FROM n) AND target IN (SELECT word FROM n)")
def c3_both_ends_known(spark, d):
    return curate.both_ends_known(_edges(spark, d), _nodes(spark, d)).select("edge_id")


@query(f"WITH {_G} SELECT DISTINCT source, target FROM negative_samples x WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM g WHERE g.source = x.source AND g.target = x.target)")
def c4_not_an_edge(spark, d):
    s = _t(spark, d, "negative_samples").filter("label = 0").select("source", "target").distinct()
    return s.join(_graph(spark, d).select("source", "target"), ["source", "target"], "left_anti")


@query(f"WITH {_E} SELECT edge_id FROM e WHERE NOT (relation = 'derives_noun' AND EXISTS (SELECT 1 FROM e x WHERE x.relation = 'nominalization' AND x.source = e.source AND x.target = e.target))")
def c5_drop_shadowed(spark, d):
    return curate.drop_shadowed(_edges(spark, d)).select("edge_id")


@query(f"WITH {_KNOWN}, {_SUFPOS}, suf AS (SELECT DISTINCT suffix FROM sufpos) SELECT suffix, count(*) AS n FROM known k JOIN suf ON ends_with(k.word, suf.suffix) AND length(k.word) > length(suf.suffix) + 2 GROUP BY suffix")
def c6_affix_join(spark, d):
    t = F.broadcast(spark.createDataFrame([(s,) for s in rules.SUFFIXES], "suffix string"))
    w = _lexicon(spark, d).known.select("word", "pos")
    return derive.with_endings(w, t).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


_BACK = f"""forms AS (SELECT * FROM {_values(rules.root_variants(), 'stem, form, ord')})"""


@query(f"WITH {_KNOWN}, {_BACK} SELECT f.stem AS variant, min(k.word) AS noun FROM known k JOIN (SELECT stem, form FROM forms UNION SELECT word, word FROM known) f ON f.form = k.word WHERE k.pos = 'noun' AND length(f.stem) <= 4 GROUP BY f.stem")
def c9_reverse_lookup_short(spark, d):
    """The rows of c9_reverse_lookup that its SQL is written for."""
    return c9_reverse_lookup(spark, d).filter(F.length("variant") <= 4)


@query()
def c9_reverse_lookup(spark, d):
    lex = _lexicon(spark, d)
    k = lex.known.filter("pos = 'noun'").select(F.col("word").alias("noun"))
    v = lex.variants(lex.known.select("word").union(spark.createDataFrame([(s,) for s in dict.fromkeys(r[0] for r in rules.root_variants())], "word string")).distinct(), "word", "noun")
    return v.join(k, "noun").groupBy(F.col("word").alias("variant")).agg(F.min("noun").alias("noun"))


@query(f"WITH {_N}, {_E}, {_V} SELECT word FROM n INTERSECT SELECT source FROM e INTERSECT SELECT word FROM v")
def c10_common_words(spark, d):
    return _nodes(spark, d).select("word").intersect(_edges(spark, d).select(F.col("source").alias("word"))).intersect(_vectors(spark, d).select("word"))


@query(f"WITH {_G} SELECT a.relation, count(*) AS n_pairs FROM g a JOIN g b ON a.relation = b.relation AND a.edge_id <> b.edge_id GROUP BY a.relation")
def c12_relation_pairs(spark, d):
    g = _graph(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return g.filter("n > 1").select("relation", (F.col("n") * (F.col("n") - 1)).alias("n_pairs"))  # counted, not emitted


@query(f"WITH {_G}, {_N} SELECT word, 'unknown' AS pos FROM (SELECT source AS word FROM g UNION SELECT target FROM g) WHERE word NOT IN (SELECT word FROM n)")
def c13_placeholders(spark, d):
    return curate.missing_nodes(_nodes(spark, d), _graph(spark, d)).select("word", "pos")


# ---- D: aggregations -------------------------------------------------------------------------------------------------
@query(f"WITH {_G} SELECT relation, count(*) AS n FROM g GROUP BY relation")
def d1_relation_counts(spark, d):
    return _graph(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_N} SELECT pos, count(DISTINCT word) AS n FROM n GROUP BY pos")
def d1_pos_counts(spark, d):
    return _nodes(spark, d).groupBy("pos").agg(F.countDistinct("word").alias("n"))


_DEG = f"{_G}, {_P}, w AS (SELECT source AS word FROM p UNION SELECT target FROM p UNION SELECT word FROM nodes WHERE word <> ''), deg AS (SELECT word, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM w LEFT JOIN (SELECT target AS word, count(*) AS i FROM p GROUP BY 1) USING (word) LEFT JOIN (SELECT source AS word, count(*) AS o FROM p GROUP BY 1) USING (word))"


def _all_words(spark, d):
    return _nodes(spark, d).select("word").union(curate.endpoints(_graph(spark, d))).distinct()


@query(f"WITH {_DEG} SELECT word, in_degree, out_degree FROM deg")
def d2_degrees(spark, d):
    return graph.degrees(_all_words(spark, d), _graph(spark, d))


@query(f"WITH {_DEG} SELECT round(avg(in_degree), 6) AS avg_in_degree, max(in_degree) AS max_in_degree, round(avg(out_degree), 6) AS avg_out_degree, max(out_degree) AS max_out_degree FROM deg")
def d2_degree_stats(spark, d):
    return graph.degree_stats(_all_words(spark, d), _graph(spark, d))


@query(f"WITH {_DEG}, a AS (SELECT count(*) AS n FROM w), b AS (SELECT count(*) AS m FROM p) SELECT n AS n_nodes, m AS n_edges, round(m / (n * (n - 1.0)), 9) AS density FROM a, b")
def d3_density(spark, d):
    return graph.density(_all_words(spark, d), _graph(spark, d))


@query("SELECT count(DISTINCT pos) AS n_labels FROM nodes WHERE pos <> ''")
def d4_distinct_labels(spark, d):
    return _nodes(spark, d).filter("pos <> ''").agg(F.countDistinct("pos").alias("n_labels"))


@query(f"WITH {_G} SELECT relation, source, count(DISTINCT target) AS n_targets, min(target) AS first_target FROM g GROUP BY relation, source")
def d5_valid_targets(spark, d):
    return _graph(spark, d).groupBy("relation", "source").agg(F.countDistinct("target").alias("n_targets"), F.min("target").alias("first_target"))


@query(f"WITH {_N}, x AS (SELECT word, coalesce(min(CASE WHEN pos NOT IN ('', 'unknown') THEN pos END), 'unknown') AS pos FROM n GROUP BY word) SELECT pos, word, row_number() OVER (PARTITION BY pos ORDER BY word) - 1 AS i FROM x UNION ALL SELECT '*', word, row_number() OVER (ORDER BY word) - 1 FROM x")
def d6_pools(spark, d):
    return sampling.pools(_nodes(spark, d))[0].select("pos", "word", "i")


_TRI = r"tri AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr('#' || word || '#', i, 3))) AS t FROM (SELECT DISTINCT word FROM nodes WHERE word <> ''))"


@query(f"WITH {_TRI} SELECT t AS trigram, count(*) AS n FROM tri GROUP BY t ORDER BY n DESC, t LIMIT 6000")
def d7_top_trigrams(spark, d):
    w = _nodes(spark, d).select("word").distinct()
    return w.select(F.explode(text.trigrams("word")).alias("trigram")).groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "trigram").limit(6000)


@query(f"WITH {_LONG} SELECT model, mode, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n_seeds FROM lm WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL")
def d8_mean_and_std(spark, d):
    return metrics.summary(_seeds(spark, d), ["model", "mode"])


@query(f"WITH {_LONG} SELECT model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n_seeds FROM lm WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL")
def d9_by_model(spark, d):
    return metrics.summary(_seeds(spark, d), ["model"])


@query(f"WITH {_LONG} SELECT metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM lm WHERE NOT isnan(value) GROUP BY metric")
def d10_percentiles(spark, d):
    s = _seeds(spark, d).filter(~F.isnan("value"))
    return s.groupBy("metric").agg(F.round(F.percentile("value", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("value", F.lit(0.975)), 6).alias("high"))


_AGREE = """WITH x AS (SELECT event_type AS label, (event_id % 7) * 3 // 4 AS cluster FROM events), c AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
a AS (SELECT sum(n) AS a FROM c GROUP BY label), b AS (SELECT sum(n) AS b FROM c GROUP BY cluster),
z AS (SELECT (SELECT sum(n) FROM c) AS N, (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * ln(n)) FROM c) AS hij, (SELECT sum(a * (a - 1) / 2) FROM a) AS ai, (SELECT sum(a * ln(a)) FROM a) AS ha, (SELECT sum(b * (b - 1) / 2) FROM b) AS bj, (SELECT sum(b * ln(b)) FROM b) AS hb)
SELECT round((ij - ai * bj / (N * (N - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (N * (N - 1) / 2)), 6) AS ari, round(((hij - ha - hb) / N + ln(N)) / ((ln(N) - ha / N + ln(N) - hb / N) / 2), 6) AS nmi FROM z"""


@query(_AGREE)
def d11_ari_nmi(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("label"), F.floor((F.col("event_id") % 7) * 3 / 4).alias("cluster"))
    return metrics.clustering_agreement(e)


# ---- E: windows, ranking, dedupe -------------------------------------------------------------------------------------
@query(f"WITH {_N} SELECT word, pos, node_id FROM n QUALIFY row_number() OVER (PARTITION BY word ORDER BY node_id) = 1")
def e1_keep_first(spark, d):
    return curate.keep_first(_nodes(spark, d).select("word", "pos", "node_id"), ["word"], ["node_id"])


@query(f"WITH {_N} SELECT word, pos, node_id FROM n QUALIFY row_number() OVER (PARTITION BY word ORDER BY node_id DESC) = 1")
def e2_keep_last(spark, d):
    return curate.keep_last(_nodes(spark, d).select("word", "pos", "node_id"), ["word"], ["node_id"])


@query(f"WITH {_G} SELECT edge_id, source, relation, target FROM g")
def e3_unique_edges(spark, d):
    return _graph(spark, d).select("edge_id", "source", "relation", "target")


@query(f"WITH {_G} SELECT source, relation, target, edge_id FROM g ORDER BY source, relation, target")
def e4_canonical_order(spark, d):
    return _graph(spark, d).select("source", "relation", "target", "edge_id").orderBy("source", "relation", "target")


@query(f"WITH {_KNOWN}, suf AS (SELECT * FROM {_values([(s,) for s in rules.SUFFIXES], 'suffix')}) SELECT word, arg_max(suffix, length(suffix)) AS suffix FROM known JOIN suf ON ends_with(word, suffix) AND length(word) > length(suffix) + 2 GROUP BY word")
def e5_longest_affix(spark, d):
    t = F.broadcast(spark.createDataFrame([(s,) for s in rules.SUFFIXES], "suffix string"))
    return derive.with_endings(_lexicon(spark, d).known.select("word", "pos"), t).groupBy("word").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))


@query(f"WITH {_G}, {_P} SELECT source AS word, count(*) AS out_degree FROM p GROUP BY source ORDER BY out_degree DESC, word LIMIT 20")
def e6_top_roots(spark, d):
    return graph.top_roots(_graph(spark, d), 20)


_KNN = f"{_V}, qs AS (SELECT word AS q, vec AS qv FROM v WHERE word IN ('գիր', 'տելար', 'բորակ', 'վիսակ', 'կոթան', 'շոլան', 'մարիթ', 'լիսար', 'դերոն')), kn AS (SELECT q, word, round(list_cosine_similarity(qv, vec), 6) AS sim FROM qs JOIN v ON word <> q)"
SPOT_WORDS = ["գիր", "տելար", "բորակ", "վիսակ", "կոթան", "շոլան", "մարիթ", "լիսար", "դերոն"]


@query(f"WITH {_KNN} SELECT q AS word, word AS neighbour, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, word) AS rank FROM kn QUALIFY rank <= 5")
def e7_spot_check_neighbours(spark, d):
    return search.nearest_words(_vectors(spark, d), SPOT_WORDS, 5)


@query(f"WITH {_G}, x AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY {_draw(42, 'source', 'relation', 'target')}, source, target) - 1 AS i, count(*) OVER (PARTITION BY relation) AS n FROM g) SELECT edge_id, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM x")
def e9_stratified_split(spark, d):
    return sampling.stratified_split(_graph(spark, d)).select("edge_id", "split")


@query(f"WITH {_G}, x AS (SELECT edge_id, row_number() OVER (ORDER BY {_draw(42, 'source', 'relation', 'target')}) AS i, greatest(1, floor(0.1::DOUBLE * count(*) OVER ())) AS k FROM g) SELECT edge_id, CASE WHEN i <= k THEN 'test' WHEN i <= 2 * k THEN 'val' ELSE 'train' END AS split FROM x")
def e10_global_split(spark, d):
    return sampling.global_split(_graph(spark, d)).select("edge_id", "split")


@query(f"WITH {_SCORED}, x AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM sc GROUP BY score) SELECT score, (sum(p) OVER (ORDER BY score DESC))::BIGINT AS tp, (sum(n) OVER (ORDER BY score DESC))::BIGINT AS fp FROM x")
def e11_running_counts(spark, d):
    return metrics.threshold_table(_scored(spark, d)).select("score", "tp", "fp")


@query(f"WITH {_G} SELECT relation, source, target FROM g QUALIFY row_number() OVER (PARTITION BY relation ORDER BY source, target) <= 24")
def e12_first_pairs(spark, d):
    return layers.top_k_by(_graph(spark, d).select("relation", "source", "target"), ["relation"], ["source", "target"], 24).drop("rank")


# ---- F: set operations -----------------------------------------------------------------------------------------------
@query(f"WITH {_G} SELECT source, relation, target, 1 AS label FROM g UNION ALL SELECT DISTINCT source, lower(trim(relation)), target, 0 FROM negative_samples WHERE label = 0")
def f1_labelled_union(spark, d):
    neg = _t(spark, d, "negative_samples").filter("label = 0").select("source", F.lower(F.trim("relation")).alias("relation"), "target").distinct()
    return _graph(spark, d).select("source", "relation", "target", F.lit(1).alias("label")).unionByName(neg.withColumn("label", F.lit(0)))


@query(f"WITH {_G}, {_RENAMES} SELECT source, relation, target FROM g UNION SELECT source, coalesce(new, relation), target FROM g LEFT JOIN ren ON old = relation")
def f2_union_relabelled(spark, d):
    g = _graph(spark, d).select("source", "relation", "target", "relation_class")
    return g.unionByName(curate.relabel(g)).select("source", "relation", "target").distinct()


@query(f"WITH {_G}, {_N} SELECT word FROM (SELECT source AS word FROM g UNION SELECT target FROM g) EXCEPT SELECT word FROM n")
def f3_endpoint_difference(spark, d):
    return curate.endpoints(_graph(spark, d)).exceptAll(_nodes(spark, d).select("word").distinct())


@query(f"WITH {_N}, {_V} SELECT word FROM n INTERSECT SELECT word FROM v")
def f4_vocabulary_intersection(spark, d):
    return _nodes(spark, d).select("word").intersect(_vectors(spark, d).select("word"))


@query(f"WITH {_G}, x AS (SELECT source AS src, target AS dst, length(relation) AS etype FROM g) SELECT src, dst, etype, count(*) AS n FROM (SELECT * FROM x UNION ALL SELECT dst, src, etype + 37 FROM x) GROUP BY ALL")
def f5_bidirected(spark, d):
    g = _graph(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.length("relation").alias("etype"))
    return curate.reversed_edges(g, 37).groupBy("src", "dst", "etype").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G}, inv AS (SELECT * FROM {_values(rules.INVERSE_TABLE, 'relation, inv')}), {_BCLASS} SELECT g.target AS source, inv AS relation, coalesce(class, 'inverse_derivation') AS relation_class, g.source AS target FROM g JOIN inv USING (relation) LEFT JOIN bcls ON bcls.relation = inv.inv")
def f6_inverse_edges(spark, d):
    return derive.inverse_edges(_graph(spark, d)).select("source", "relation", "relation_class", "target")


# ---- G: text ---------------------------------------------------------------------------------------------------------
def _pages(spark, d):
    """Dictionary documents as wiki pages, titled by the word they are about."""
    return _t(spark, d, "documents").filter("text <> ''").select("doc_id", F.col("word").alias("title"), F.col("text").alias("page"))


@query("""WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)), lambda x: starts_with(x, '# '))[1] AS l FROM documents WHERE text <> '')
  SELECT doc_id, coalesce(left(trim(regexp_replace(regexp_replace(regexp_replace(substr(l, 3), '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', '\\1', 'g'), '\\{\\{[^}]+\\}\\}', '', 'g'), '''{2,3}', '', 'g')), 300), '') AS definition FROM x""")
def g2_first_definition(spark, d):
    return _pages(spark, d).select("doc_id", text.first_definition("page").alias("definition"))


@query(None)
def g3_compound_links(spark, d):
    return _pages(spark, d).select("doc_id", F.array_join(text.compound_links("page", "title", "Բառակազմություն"), ",").alias("links")).filter("links <> ''")


_WL = r"\[\[([^\]|#:]+)(?:\|[^\]]*)?\]\]"
_ETY = ", ".join(f"regexp_extract_all(s, '{p}', {g})" for p in (rf"{_WL}\s*\+\s*{_WL}", rf"{_WL}-\s*\+\s*{_WL}", rf"{_WL}\s*\+\s*-{_WL}") for g in (1, 2))


@query(rf"""WITH x AS (SELECT doc_id, word AS title, regexp_extract(text || chr(10) || '=', '==\s*Ստուգաբանություն\s*==((?:.|\n)*?)\n=', 1) AS s FROM documents WHERE text <> ''),
  y AS (SELECT doc_id, title, flatten([{_ETY}]) AS a FROM x)
  SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(a, lambda w: trim(w)), lambda w: length(w) > 1 AND w <> coalesce(title, '')))), ',') AS parts FROM y WHERE len(a) > 0""")
def g4_etymology_parts(spark, d):
    p = _pages(spark, d).withColumn("title", F.coalesce("title", F.lit("")))
    return p.select("doc_id", text.etymology_parts("page", "title").alias("p")).filter(F.size("p") > 0).select("doc_id", F.array_join("p", ",").alias("parts"))


@query(f"WITH {_N}, {_SUFPOS} SELECT n.node_id, coalesce((SELECT arg_min(s.pos, s.rank) FROM sufpos s WHERE ends_with(n.word, s.suffix)), 'unknown') AS guess FROM n")
def g5_suffix_pos(spark, d):
    return text.suffix_pos(_nodes(spark, d).select("node_id", "word")).select("node_id", "guess")


def _case(table, default):
    return "CASE " + " ".join(f"WHEN ends_with(word, '{e}') THEN '{x}'" for e, x in rules.entries(table)) + f" ELSE '{default}' END"


_HUMAN = f"word IN ({', '.join(repr(x) for x in rules.HUMAN_STEMS.split())}) OR " + " OR ".join(f"ends_with(word, '{x}')" for x in rules.HUMAN_SUFFIXES.split())
_TRANS = "CASE WHEN " + " OR ".join(f"ends_with(word, '{x}')" for x in rules.CAUSATIVE_ENDINGS.split()) + " THEN 'causative' WHEN " + " OR ".join(f"ends_with(word, '{x}')" for x in rules.INTRANSITIVE_ENDINGS.split()) + " THEN 'intransitive' ELSE 'transitive' END"


@query(f"""WITH {_N} SELECT node_id, CASE WHEN pos = 'noun' THEN CASE WHEN {_HUMAN} THEN '+human' ELSE '-human' END ELSE '' END AS animacy, CASE WHEN pos = 'noun' THEN {_case(rules.DECLENSIONS, 'consonant-decl')} ELSE '' END AS declension_class,
  CASE WHEN pos = 'verb' THEN {_TRANS} ELSE '' END AS verb_transitivity, CASE WHEN pos = 'verb' THEN {_case(rules.ACTIONS, '')} ELSE '' END AS aktionsart FROM n""")
def g6_g9_node_features(spark, d):
    return _nodes(spark, d).select("node_id", text.animacy().alias("animacy"), text.declension().alias("declension_class"), text.transitivity().alias("verb_transitivity"), text.action_kind().alias("aktionsart"))


@query(f"WITH {_BACK}, x AS (SELECT DISTINCT word FROM nodes WHERE word <> '' UNION SELECT DISTINCT stem FROM forms) SELECT word, 0 AS ord, word AS form FROM x UNION ALL SELECT word, ord, form FROM x JOIN forms ON stem = word")
def g10_root_forms(spark, d):
    w = _nodes(spark, d).select("word").union(spark.createDataFrame([(r[0],) for r in rules.root_variants()], "word string")).distinct()
    return _lexicon(spark, d).variants(w, "word", "form", "ord").select("word", F.col("ord").cast("int").alias("ord"), "form")


@query(f"WITH {_N} SELECT node_id, CASE WHEN (ends_with(word, 'ա') OR ends_with(word, 'ե')) AND length(word) > 3 THEN left(word, length(word) - 1) END AS stem FROM n")
def g11_bridge_vowel(spark, d):
    return _nodes(spark, d).select("node_id", text.strip_bridge("word").alias("stem"))


@query(r"""SELECT edge_id, CASE WHEN regexp_extract(coalesce(source, ''), '([\x{0531}-\x{0556}\x{0561}-\x{0587}-]+)', 1) <> '' THEN regexp_extract(source, '([\x{0531}-\x{0556}\x{0561}-\x{0587}-]+)', 1) ELSE regexp_replace(coalesce(source, ''), '^[^\p{L}]+|[^\p{L}]+$', '', 'g') END AS clean FROM edges""")
def g12_clean_word(spark, d):
    return _t(spark, d, "edges").select("edge_id", text.clean_word("source").alias("clean"))


@query("SELECT word, array_to_string(list(substr('#' || word || '#', i, 3) ORDER BY i), ',') AS grams FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM (SELECT DISTINCT word FROM nodes WHERE word <> '')) GROUP BY word")
def g13_trigrams(spark, d):
    return _nodes(spark, d).select("word").distinct().select("word", F.array_join(text.trigrams("word"), ",").alias("grams"))


@query(f"""WITH {_TRI}, top AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) AS id FROM tri GROUP BY t QUALIFY id <= 6000),
  x AS (SELECT word, i, substr('#' || word || '#', i, 3) AS t FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM (SELECT DISTINCT word FROM nodes WHERE word <> '')))
  SELECT word, array_to_string(list(coalesce(id, 0) ORDER BY i), ',') AS ids FROM x LEFT JOIN top USING (t) GROUP BY word""")
def g14_trigram_ids(spark, d):
    from ..operators.features import trigram_ids, trigram_vocabulary

    w = _nodes(spark, d).select("word").distinct()
    return trigram_ids(w, trigram_vocabulary(w)).select("word", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {_N}, x AS (SELECT pos AS label FROM n UNION SELECT '<UNK>') SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM x")
def g15_label_ids(spark, d):
    return curate.label_ids(_nodes(spark, d), "pos")


@query(f"""WITH {_N} SELECT node_id, CASE WHEN definition_hy = '' THEN word ELSE word || ': ' || CASE WHEN length(definition_hy) > 120 THEN regexp_replace(left(definition_hy, 120), '\\s\\S*$', '') || '…' ELSE definition_hy END END AS prompt FROM n""")
def g16_prompt(spark, d):
    return _nodes(spark, d).select("node_id", text.prompt("word", "definition_hy").alias("prompt"))


@query(f"WITH {_N} SELECT node_id, ('0x' || substr(md5(word), 1, 15))::BIGINT AS h FROM n")
def g17_stable_hash(spark, d):
    return _nodes(spark, d).select("node_id", text.stable_hash("word").alias("h"))


@query(r"SELECT doc_id, regexp_replace(source, '[^\p{L}\p{N}_-]', '_', 'g') AS name FROM documents")
def g18_file_name(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.file_name("source").alias("name"))


_HEADS = "CASE " + " ".join(f"WHEN contains(text, '{t}') THEN '{p}'" for t, p in rules.lines(rules.POS_TEMPLATES)) + " " + " ".join(rf"WHEN regexp_matches(text, '={{2,4}}\s*{h}\s*={{2,4}}') THEN '{p}'" for h, p in rules.lines(rules.POS_HEADS)) + " ELSE 'unknown' END"


@query(f"SELECT doc_id, {_HEADS} AS pos FROM documents WHERE text <> ''")
def g1_page_pos(spark, d):
    return _pages(spark, d).select("doc_id", text.page_pos("page").alias("pos"))


# ---- H: derivation rules over the whole dictionary -------------------------------------------------------------------
_LEX = f"{_KNOWN}, {_BACK}, forms0 AS (SELECT stem, form, ord FROM forms), w AS (SELECT * FROM lex)"
_VE = _values([(i, e) for i, e in enumerate(rules.VERB_ENDINGS.split())], "o, x")


def _vars(rel, col):
    """Rows of ``rel`` with every form of column ``col`` as ``form`` and its order ``v``."""
    return f"(SELECT r.*, r.{col} AS form, 0 AS v FROM {rel} r UNION ALL SELECT r.*, f.form, f.ord FROM {rel} r JOIN forms0 f ON f.stem = r.{col})"


def _edge_cols(h, rel, tpos="pos"):
    return f"SELECT trim(base, ' ') AS source, base_pos AS source_pos, {rel} AS relation, trim(word, ' ') AS target, {tpos} AS target_pos FROM {h}"


_H_COLS = ["source", "source_pos", "relation", "target", "target_pos"]
_H1 = f"h1 AS ({_edge_cols('(SELECT w.word, w.pos, k.word AS base, k.pos AS base_pos FROM w JOIN known k ON w.word = k.word || chr(45) || k.word)', chr(39) + 'reduplication' + chr(39))})"
_H2 = f"""h2 AS ({_edge_cols(f"(SELECT w.word, w.pos, k.word AS base, k.pos AS base_pos FROM w JOIN {_values([(i, s) for i, s in enumerate(rules.DEMONYM_ENDINGS.split())], 'o, s')} ON ends_with(w.word, s) AND length(w.word) > length(s) + 2 JOIN known k ON k.word = left(w.word, length(w.word) - length(s)) QUALIFY row_number() OVER (PARTITION BY w.word ORDER BY o) = 1)", "'demonym_suffix'")})"""
_H3 = f"""c3 AS (SELECT w.word, w.pos, o, regexp_replace(left(w.word, length(w.word) - length(s)), 'ն$', '') AS stem FROM w JOIN {_values([(i, s) for i, s in enumerate(rules.DIMINUTIVE_ENDINGS.split())], 'o, s')} ON ends_with(w.word, s) AND length(w.word) > length(s) + 2),
k3 AS (SELECT c.word, c.pos, o, k.word AS base, k.pos AS base_pos FROM {_vars('c3', 'stem')} c JOIN known k ON k.word = c.form QUALIFY row_number() OVER (PARTITION BY c.word, o ORDER BY v) = 1),
h3 AS ({_edge_cols('(SELECT * FROM k3 QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(base) DESC, o) = 1)', "'diminutive'")})"""
_H4 = f"""c4 AS (SELECT word, pos, left(word, length(word) - 3) AS stem FROM w WHERE pos IN ('verb', 'unknown') AND ends_with(word, 'վել')),
h4 AS ({_edge_cols(f"(SELECT c.word, c.pos, k.word AS base, k.pos AS base_pos FROM {_vars('c4', 'stem')} c, {_VE} JOIN known k ON k.word = c.form || x AND k.pos = 'verb' QUALIFY row_number() OVER (PARTITION BY c.word ORDER BY o, v) = 1)", "'detransitive'", "'verb'")})"""
_CAUS = _values([(i, r[0], j, e) for i, r in enumerate(rules.entries(rules.CAUSATIVES)) for j, e in enumerate(r[1:])], "o, s, j, x")
_H5 = f"""c5 AS (SELECT word, pos, o, j, x, left(word, length(word) - length(s)) AS stem FROM w JOIN {_CAUS} ON ends_with(word, s) AND length(word) > length(s) WHERE pos IN ('verb', 'unknown')),
d5 AS (SELECT *, stem AS st, 0 AS b FROM c5 UNION ALL SELECT *, left(stem, length(stem) - 1), CASE WHEN ends_with(stem, 'ա') THEN 1 ELSE 2 END FROM c5 WHERE ends_with(stem, 'ա') OR ends_with(stem, 'ե')),
h5 AS ({_edge_cols("(SELECT c.word, c.pos, k.word AS base, k.pos AS base_pos FROM d5 c JOIN known k ON k.word = c.st || c.x AND k.pos = 'verb' QUALIFY row_number() OVER (PARTITION BY c.word ORDER BY o, j, b) = 1)", "'causative'", "'verb'")})"""
_NOM = _values([(i, r[0], j, e) for i, r in enumerate(rules.entries(rules.NOMINALIZATIONS)) for j, e in enumerate(r[1:])], "o, s, j, x")
_H6 = f"""h6 AS ({_edge_cols(f"(SELECT w.word, w.pos, k.word AS base, k.pos AS base_pos FROM w JOIN {_NOM} ON ends_with(w.word, s) AND length(w.word) > length(s) + 2 JOIN known k ON k.word = left(w.word, length(w.word) - length(s)) || x AND k.pos = 'verb' QUALIFY row_number() OVER (PARTITION BY w.word ORDER BY o, j) = 1)", "'nominalization'")})"""
_H7 = f"""c7 AS (SELECT word, pos, o, left(word, length(word) - length(s)) AS stem FROM w JOIN {_values([(i, s) for i, s in enumerate(rules.DENOMINAL_VERB_ENDINGS.split())], 'o, s')} ON ends_with(word, s) AND length(word) > length(s) + 2 WHERE pos = 'verb'),
d7 AS (SELECT *, 0 AS way, stem AS base FROM c7 UNION ALL SELECT *, CASE WHEN ends_with(stem, 'ա') THEN 1 ELSE 2 END, left(stem, length(stem) - 1) FROM c7 WHERE ends_with(stem, 'ա') OR ends_with(stem, 'ե') UNION ALL SELECT *, 3, stem || 'ց' FROM c7),
n7 AS (SELECT word AS noun, word AS stem FROM lex WHERE pos = 'noun' UNION SELECT l.word, f.form FROM lex l JOIN forms0 f ON f.stem = l.word WHERE l.pos = 'noun'),
x7 AS (SELECT d.word, d.pos, o, way, d.base, k.pos AS base_pos FROM d7 d JOIN known k ON k.word = d.base AND k.pos = 'noun' UNION ALL SELECT c.word, c.pos, o, 9, n.noun, 'noun' FROM c7 c JOIN n7 n ON n.stem = c.stem),
h7 AS ({_edge_cols('(SELECT * FROM x7 QUALIFY row_number() OVER (PARTITION BY word ORDER BY o, way, base) = 1)', "'derives_noun'")})"""
_SUFT = f"suft AS (SELECT * FROM {_values(rules.SUFFIX_TABLE, 'ord, suffix, src, tgt, kind')}), sufd AS (SELECT DISTINCT suffix FROM suft)"
_H8 = f"""{_SUFT},
c8 AS (SELECT word, pos, suffix, left(word, length(word) - length(suffix)) AS stem FROM w JOIN sufd ON ends_with(word, suffix) AND length(word) > length(suffix) + 2),
s8 AS (SELECT word, pos, suffix, form AS st FROM {_vars('c8', 'stem')} UNION SELECT word, pos, suffix, left(stem, length(stem) - 1) FROM c8 WHERE (ends_with(stem, 'ա') OR ends_with(stem, 'ե')) AND length(stem) > 3),
b8 AS (SELECT word, pos, suffix, st AS base FROM s8 UNION SELECT word, pos, suffix, st || x FROM s8, {_VE}),
k8 AS (SELECT b.*, k.pos AS base_pos FROM b8 b JOIN known k ON k.word = b.base),
t8 AS (SELECT k.*, ord, kind || '_suffixation' AS relation, tgt FROM k8 k JOIN suft t ON t.suffix = k.suffix AND (t.src = k.base_pos OR k.base_pos = 'unknown')
  UNION ALL SELECT k.*, -1, 'suffixation', k.pos FROM k8 k WHERE base_pos <> 'unknown' AND NOT EXISTS (SELECT 1 FROM suft t WHERE t.suffix = k.suffix AND t.src = k.base_pos)),
h8 AS (SELECT trim(base, ' ') AS source, base_pos AS source_pos, relation, trim(word, ' ') AS target, tgt AS target_pos FROM t8 QUALIFY row_number() OVER (PARTITION BY word, base, relation ORDER BY length(suffix), suffix, ord) = 1)"""
_H9 = f"""c9 AS (SELECT word, pos, ord, prefix, rel, substr(word, length(prefix) + 1) AS stem FROM w JOIN {_values(rules.PREFIX_TABLE, 'ord, prefix, rel')} ON starts_with(word, prefix) AND length(word) > length(prefix) + 2),
d9 AS (SELECT word, pos, ord, prefix, rel, form AS base, CASE WHEN v = 0 THEN 0 ELSE v + 10 END AS v FROM {_vars('c9', 'stem')} UNION ALL SELECT word, pos, ord, prefix, rel, substr(stem, 2), CASE WHEN starts_with(stem, 'ա') THEN 1 ELSE 2 END FROM c9 WHERE starts_with(stem, 'ա') OR starts_with(stem, 'ե')),
h9 AS (SELECT trim(base, ' ') AS source, k.pos AS source_pos, rel AS relation, trim(d.word, ' ') AS target, d.pos AS target_pos FROM d9 d JOIN known k ON k.word = d.base QUALIFY row_number() OVER (PARTITION BY d.word ORDER BY length(prefix) DESC, ord, v) = 1)"""
_SUFIN = ", ".join(f"'{x}'" for x in rules.SUFFIXES)
_ANCH = "({c} = {s} OR (length({c}) >= 3 AND length({c}) >= length({s}) - 1 AND starts_with({s}, left({c}, length({c}) - 1))))"
_H10 = f"""a10 AS (SELECT word, pos, i, left(word, i) AS s1, substr(word, i + 1) AS r FROM (SELECT word, pos, unnest(range(3, length(word) - 2)) AS i FROM cw WHERE length(word) >= 6)),
b10 AS (SELECT word, pos, i, s1, 0 AS mode, 0 AS vowel, substr(r, 2) AS s2 FROM a10 WHERE starts_with(r, 'ա') AND length(r) >= 4 UNION ALL SELECT word, pos, i, s1, 0, 1, substr(r, 2) FROM a10 WHERE starts_with(r, 'ե') AND length(r) >= 4 UNION ALL SELECT word, pos, i, s1, 1, 0, r FROM a10),
c10 AS (SELECT * FROM b10 WHERE length(s2) >= 3 AND s2 NOT IN ({_SUFIN})),
d10 AS (SELECT c.*, k.pos AS pos1 FROM (SELECT * RENAME (form AS b1, v AS v1) FROM {_vars('c10', 's1')}) c JOIN knownc k ON k.word = c.b1 WHERE {_ANCH.format(c='b1', s='s1')}),
e10 AS (SELECT c.*, k.pos AS pos2 FROM (SELECT * RENAME (form AS b2, v AS v2) FROM {_vars('d10', 's2')}) c JOIN knownc k ON k.word = c.b2 WHERE {_ANCH.format(c='b2', s='s2')}),
f10 AS (SELECT *, CASE WHEN b2 IN ({', '.join(f"'{x}'" for x in rules.VERB_ROOTS.split())}) OR pos2 = 'verb' THEN 'synthetic_compound' WHEN pos1 = 'adjective' OR pos2 = 'adjective' THEN 'adjective_compound' ELSE 'root_compound' END AS kind FROM e10 QUALIFY row_number() OVER (PARTITION BY word ORDER BY mode, -i, vowel, v1, v2) = 1),
h10 AS (SELECT b1 AS source, pos1 AS source_pos, kind AS relation, trim(word, ' ') AS target, pos AS target_pos FROM f10 UNION SELECT b2, pos2, kind, trim(word, ' '), pos FROM f10)"""
_ALL_RULES = f"{_LEX}, {_H1}, {_H2}, {_H3}, {_H4}, {_H5}, {_H6}, {_H7}, {_H8}, {_H9}"
_UNION9 = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(1, 10))


def _rule(name, fn, parts, last):
    def q(spark, d):
        lex = _lexicon(spark, d)
        return fn(lex.words, lex).select(*_H_COLS)

    q.__name__ = name
    return query(f"WITH {_LEX}, {parts} SELECT * FROM {last}")(q)


_rule("h1_reduplication", derive.reduplication, _H1, "h1")
_rule("h2_place_person", derive.place_person, _H2, "h2")
_rule("h3_diminutive", derive.diminutive, _H3, "h3")
_rule("h4_detransitive", derive.detransitive, _H4, "h4")
_rule("h5_causative", derive.causative, _H5, "h5")
_rule("h6_nominalization", derive.nominalization, _H6, "h6")
_rule("h7_verb_to_noun", derive.verb_to_noun, _H7, "h7")
_rule("h8_suffixation", derive.suffixation, _H8, "h8")
_rule("h9_prefixation", derive.prefixation, _H9, "h9")
_rule("h10_compound", derive.compound, f"cw AS (SELECT * FROM w), {_H10}", "h10")

_ANALYSIS = f"""{_ALL_RULES.replace('w AS (SELECT * FROM lex)', f'''w AS (SELECT * FROM lex WHERE word NOT IN ({', '.join(f"'{x}'" for x in rules.BORROWINGS.split())}))''')}, simple AS ({_UNION9}),
cw AS (SELECT * FROM w WHERE trim(word, ' ') NOT IN (SELECT target FROM simple WHERE ends_with(relation, '_suffixation') OR relation IN ('nominalization', 'causative', 'detransitive'))), {_H10},
every AS (SELECT DISTINCT source, relation, target FROM (SELECT * FROM simple UNION ALL SELECT * FROM h10))"""


@query(f"WITH {_ANALYSIS} SELECT source, relation, target FROM every")
def h11_analyze(spark, d):
    lex = _lexicon(spark, d)
    return derive.analyze(lex.words, lex).select("source", "relation", "target")


_INV = f"inv AS (SELECT * FROM {_values(rules.INVERSE_TABLE, 'relation, inv')})"


@query(f"WITH {_ANALYSIS}, {_G}, {_INV}, both_ways AS (SELECT source, relation, target FROM every UNION SELECT target, inv, source FROM every JOIN inv USING (relation)) SELECT * FROM both_ways b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = b.source AND g.relation = b.relation AND g.target = b.target)")
def h14_reanalysis(spark, d):
    return derive.reanalysis(_lexicon(spark, d).words, _graph(spark, d)).select("source", "relation", "target")


@query(f"WITH {_ANALYSIS}, {_G} SELECT source, relation, target FROM every WHERE target IN (SELECT target FROM g WHERE relation = 'wiki_compound_member')")
def h15_legacy_compounds(spark, d):
    lex = _lexicon(spark, d)
    legacy = _graph(spark, d).filter("relation = 'wiki_compound_member'").select(F.col("target").alias("word")).distinct()
    return derive.analyze(lex.words.join(legacy, "word", "left_semi"), lex).select("source", "relation", "target")


@query(f"WITH {_N}, x AS (SELECT word, min(pos) AS pos FROM n GROUP BY word) SELECT word, pos FROM x UNION ALL SELECT * FROM {_values(rules.SEEDS, 'word, pos')} WHERE word NOT IN (SELECT word FROM x)")
def h16_seeded_lexicon(spark, d):
    return derive.seeded(_nodes(spark, d).groupBy("word").agg(F.min("pos").alias("pos")))


@query(f"""WITH RECURSIVE {_S}, l AS (SELECT DISTINCT source, target FROM s), r AS (SELECT word, 0 AS round FROM (SELECT source AS word FROM l GROUP BY source ORDER BY count(*) DESC, source LIMIT 20)
  UNION SELECT l.target, r.round + 1 FROM r JOIN l ON l.source = r.word WHERE r.round < 6) SELECT word, min(round) AS round FROM r GROUP BY word""")
def h13_frontier_rounds_small(spark, d):
    return _frontier(spark, _small(spark, d), 6)


@query()
def h13_frontier_rounds(spark, d):
    return _frontier(spark, _graph(spark, d))


def _frontier(spark, e, rounds=None):
    from ..operators.crawl import frontier_rounds

    return frontier_rounds(e.select(F.col("source").alias("word"), F.col("target").alias("to")), graph.top_roots(e, 20), Scratch(spark), rounds)


@query(None)
def h12_crawl(spark, d):
    from ..operators.crawl import crawl

    pages = curate.keep_first(_pages(spark, d).filter("title <> ''").select(F.col("title").alias("word"), "page", "doc_id"), ["word"], ["doc_id"]).select("word", "page")
    seeds = pages.select("word")
    edges, _ = crawl(pages, seeds, _lexicon(spark, d).words, Scratch(spark))
    return edges.select("source", "relation", "target")


# ---- I: graph --------------------------------------------------------------------------------------------------------
@query(f"""WITH {_E}, {_N}, a AS (SELECT * FROM e WHERE source IN (SELECT word FROM n) OR target IN (SELECT word FROM n)), b AS (SELECT DISTINCT source, relation, target FROM a)
  SELECT source, relation, target FROM b WHERE NOT (relation = 'derives_noun' AND EXISTS (SELECT 1 FROM b x WHERE x.relation = 'nominalization' AND x.source = b.source AND x.target = b.target))""")
def i1_curated_edges(spark, d):
    return curate.curated_graph(_nodes(spark, d), _edges(spark, d).select("edge_id", *derive.EDGE))[1].select("source", "relation", "target")


@query(f"""WITH {_E}, {_N}, a AS (SELECT * FROM e WHERE source IN (SELECT word FROM n) OR target IN (SELECT word FROM n)), w AS (SELECT source AS word FROM a UNION SELECT target FROM a),
  f AS (SELECT word, pos FROM n QUALIFY row_number() OVER (PARTITION BY word ORDER BY pos, definition_hy, animacy, declension_class, verb_transitivity, aktionsart, scraped_at) = 1) SELECT word, coalesce(pos, 'unknown') AS pos FROM w LEFT JOIN f USING (word)""")
def i1_curated_nodes(spark, d):
    return curate.curated_graph(_nodes(spark, d), _edges(spark, d).select("edge_id", *derive.EDGE))[0].select("word", "pos")


_REACH = f"{_S}, u AS (SELECT source AS a, target AS b FROM s UNION SELECT target, source FROM s), r AS (SELECT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), wcc AS (SELECT a AS word, min(b) AS component FROM r GROUP BY a)"


@query(f"WITH RECURSIVE {_REACH} SELECT word, component FROM wcc")
def i2_weak_components_small(spark, d):
    e = _small(spark, d)
    return graph.weak_components(curate.endpoints(e), e, Scratch(spark))


@query()
def i2_weak_components(spark, d):
    return graph.weak_components(_all_words(spark, d), _graph(spark, d), Scratch(spark))


@query(f"WITH RECURSIVE {_REACH}, z AS (SELECT component, count(*) AS n FROM wcc GROUP BY 1) SELECT count(*) AS n_components, max(n) AS largest_size, round(max(n) / sum(n), 6) AS largest_share FROM z")
def i2_component_stats_small(spark, d):
    return graph.component_stats(i2_weak_components_small(spark, d))


@query()
def i2_component_stats(spark, d):
    return graph.component_stats(i2_weak_components(spark, d))


@query(f"WITH RECURSIVE {_S}, l AS (SELECT DISTINCT source, target FROM s), r AS (SELECT source AS a, target AS b FROM l UNION SELECT r.a, l.target FROM r JOIN l ON l.source = r.b), w AS (SELECT source AS word FROM l UNION SELECT target FROM l) SELECT word, least(word, coalesce((SELECT min(r.b) FROM r JOIN r q ON q.a = r.b AND q.b = r.a WHERE r.a = word), word)) AS component FROM w")
def i3_strong_components_small(spark, d):
    return graph.strong_components(_small(spark, d), Scratch(spark))


@query()
def i3_strong_components(spark, d):
    """Every word; one without an edge stands alone."""
    c = graph.strong_components(_graph(spark, d), Scratch(spark))
    return _all_words(spark, d).join(c, "word", "left").select("word", F.coalesce("component", "word").alias("component"))


_BFS = f"{_G}, {_P}, roots AS (SELECT source AS root FROM p GROUP BY source ORDER BY count(*) DESC, source LIMIT 5), b AS (SELECT root, root AS word, 0 AS d FROM roots UNION SELECT b.root, p.target, b.d + 1 FROM b JOIN p ON p.source = b.word WHERE b.d < 3), dist AS (SELECT root, word, min(d) AS distance FROM b GROUP BY root, word)"


def _roots_bfs(spark, d, depth=None):
    g = _graph(spark, d)
    roots = graph.top_roots(g, 5).select(F.col("word").alias("root"))
    return g, graph.bfs(g, roots, Scratch(spark), depth)


@query(f"WITH RECURSIVE {_BFS} SELECT root, word, distance FROM dist")
def i5_bfs_distances_near(spark, d):
    return _roots_bfs(spark, d, 3)[1]


@query()
def i5_bfs_distances(spark, d):
    return _roots_bfs(spark, d)[1]


_FAM = f"{_BFS}, fam AS (SELECT root, word, distance FROM dist QUALIFY row_number() OVER (PARTITION BY root ORDER BY distance, word) <= 40)"


@query(f"WITH RECURSIVE {_FAM} SELECT root, word, distance FROM fam")
def i5_family_members_near(spark, d):
    return graph.family_members(_roots_bfs(spark, d, 3)[1], 40).select("root", "word", "distance")


@query()
def i5_family_members(spark, d):
    return graph.family_members(_roots_bfs(spark, d)[1], 40).select("root", "word", "distance")


@query(f"WITH RECURSIVE {_FAM} SELECT a.root, g.source, g.relation, g.target FROM g JOIN fam a ON a.word = g.source JOIN fam b ON b.word = g.target AND b.root = a.root")
def i6_induced_subgraph_near(spark, d):
    g, b = _roots_bfs(spark, d, 3)
    return graph.induced(g, graph.family_members(b, 40))


@query()
def i6_induced_subgraph(spark, d):
    g, b = _roots_bfs(spark, d)
    return graph.induced(g, graph.family_members(b, 40))


@query(f"""WITH RECURSIVE {_FAM}, x AS (SELECT *, row_number() OVER (PARTITION BY root, distance ORDER BY word) - 1 AS i, count(*) OVER (PARTITION BY root, distance) AS n FROM fam)
  SELECT root, word, distance, round(distance * cos(2 * pi() * i / n - pi() / 2), 4) AS x, round(distance * sin(2 * pi() * i / n - pi() / 2), 4) AS y FROM x""")
def i7_radial_layout_near(spark, d):
    return graph.radial_layout(graph.family_members(_roots_bfs(spark, d, 3)[1], 40))


@query()
def i7_radial_layout(spark, d):
    return graph.radial_layout(graph.family_members(_roots_bfs(spark, d)[1], 40))


_ET = ", ".join(f"'{r}'" for r, _ in rules.canonical_classes())


@query(f"""WITH {_G}, {_N}, i AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM n)), x AS (SELECT a.id AS src, b.id AS dst, coalesce(list_position([{_ET}], relation) - 1, 36) AS etype FROM g JOIN i a ON a.word = source JOIN i b ON b.word = target)
  SELECT etype, count(*) AS n, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM (SELECT src, dst, etype FROM x UNION ALL SELECT dst, src, etype + 37 FROM x) GROUP BY etype""")
def i8_homogeneous_graph(spark, d):
    from ..operators.features import homogeneous_graph

    _, e = homogeneous_graph(_nodes(spark, d), _graph(spark, d), [r for r, _ in rules.canonical_classes()])
    return e.groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


@query(f"""WITH RECURSIVE {_S}, l AS (SELECT DISTINCT source, target FROM s), adj AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS i, count(*) OVER (PARTITION BY source) AS deg FROM l),
  wk AS (SELECT source AS word, walk, source AS at, source AS path, 1 AS step FROM (SELECT DISTINCT source FROM l), (SELECT unnest([0, 1]) AS walk)
  UNION ALL SELECT wk.word, wk.walk, a.target, wk.path || '>' || a.target, wk.step + 1 FROM wk JOIN adj a ON a.source = wk.at AND a.i = {_draw(42, 'wk.word', 'wk.walk', 'wk.step')} % a.deg WHERE wk.step < 6)
  SELECT word, walk, path FROM wk QUALIFY row_number() OVER (PARTITION BY word, walk ORDER BY step DESC) = 1""")
def i9_random_walks(spark, d):
    e = _small(spark, d)
    return graph.random_walks(e, e.select(F.col("source").alias("word")), 2, 6, 42, Scratch(spark)).select("word", "walk", F.array_join("path", ">").alias("path"))


@query()
def i9_random_walks_whole(spark, d):
    """Ten walks of 40 words from every word over all links; i9_random_walks is the small graph that its SQL is written for."""
    return graph.random_walks(_graph(spark, d), _all_words(spark, d), 10, 40, 42, Scratch(spark)).select("word", "walk", F.array_join("path", ">").alias("path"))


@query()
def i10_biased_walks(spark, d):
    """Two walks of 5 words from every word, return weight 2 and in-out weight 1 / 2."""
    return graph.random_walks(_graph(spark, d), _all_words(spark, d), 2, 5, 42, Scratch(spark), 0.5, 2.0).select("word", "walk", F.array_join("path", ">").alias("path"))


_POOL = f"{_N}, x AS (SELECT word, coalesce(min(CASE WHEN pos NOT IN ('', 'unknown') THEN pos END), 'unknown') AS pos FROM n GROUP BY word), pool AS (SELECT pos, word, row_number() OVER (PARTITION BY pos ORDER BY word) - 1 AS i FROM x UNION ALL SELECT '*', word, row_number() OVER (ORDER BY word) - 1 FROM x), psize AS (SELECT pos, count(*) AS n FROM pool GROUP BY pos)"


def _negative_sql(strategy):
    side = "1" if strategy == "relation_corrupt" else f"{_draw(42, 'source', 'relation', 'target', 'k', chr(39) + 'side' + chr(39))} % 2"
    want = "'*'" if strategy == "random" else "CASE WHEN coalesce(z.pos, 'unknown') = 'unknown' THEN '*' ELSE z.pos END"
    return f"""WITH {_G}, {_POOL}, d AS (SELECT source, relation, target, k, {side} AS side, {_draw(42, 'source', 'relation', 'target', 'k', "'word'")} AS h FROM g, (SELECT unnest([0, 1, 2]) AS k)),
  w AS (SELECT d.*, {want} AS want FROM d LEFT JOIN x z ON z.word = CASE WHEN side = 1 THEN d.target ELSE d.source END),
  c AS (SELECT w.source AS ps, w.target AS pt, k, relation, CASE WHEN side = 0 THEN p.word ELSE source END AS source, CASE WHEN side = 1 THEN p.word ELSE target END AS target FROM w JOIN psize s ON s.pos = want JOIN pool p ON p.pos = want AND p.i = h % s.n),
  ok AS (SELECT relation, source, target, min((ps, pt, k)) AS o FROM c WHERE source <> target AND NOT EXISTS (SELECT 1 FROM g WHERE g.source = c.source AND g.relation = c.relation AND g.target = c.target) GROUP BY relation, source, target)
  SELECT source, relation, target, 0 AS label FROM ok QUALIFY row_number() OVER (PARTITION BY o[1], relation, o[2] ORDER BY o[3], source, target) = 1"""


def _negative(strategy):
    def q(spark, d):
        return sampling.negatives(_graph(spark, d), _nodes(spark, d), strategy)

    q.__name__ = f"i11_negatives_{strategy}"
    query(_negative_sql(strategy))(q)


for _s in sampling.STRATEGIES:
    _negative(_s)


def _uniform_sql(split, taken=""):
    return f"""SELECT source, target, '{split}' AS split FROM (SELECT a.word AS source, b.word AS target, min(r.id) AS id FROM (SELECT unnest(range(0, (SELECT 2 * greatest(1, count(*) // 10) + 16 FROM g))) AS id) r, (SELECT n AS total FROM psize WHERE pos = '*') JOIN pool a ON a.pos = '*' AND a.i = {_draw(42, f"'{split}'", "'s'", 'r.id')} % total
  JOIN pool b ON b.pos = '*' AND b.i = {_draw(42, f"'{split}'", "'t'", 'r.id')} % total WHERE a.word <> b.word GROUP BY 1, 2) u WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = u.source AND g.target = u.target) {taken} ORDER BY id LIMIT (SELECT greatest(1, count(*) // 10) FROM g)"""


@query(f"WITH {_G}, {_POOL}, v AS ({_uniform_sql('val')}), t AS ({_uniform_sql('test', 'AND NOT EXISTS (SELECT 1 FROM v WHERE v.source = u.source AND v.target = u.target)')}) SELECT * FROM v UNION ALL SELECT * FROM t")
def i12_uniform_negatives(spark, d):
    g, n = _graph(spark, d), _nodes(spark, d)
    k = max(1, g.count() // 10)  # as many as there are links in a split
    v = sampling.uniform_negatives(g, n, k, "val")
    return v.unionByName(sampling.uniform_negatives(g, n, k, "test", taken=v))


@query()
def i13_hard_negatives(spark, d):
    return sampling.hard_negatives(_graph(spark, d), _nodes(spark, d))


# ---- J: layers, one hop over the vectors -----------------------------------------------------------------------------
_JE = f"{_G}, {_P}, {_V}, je AS (SELECT p.source AS src, p.target AS dst FROM p WHERE source IN (SELECT word FROM v) AND target IN (SELECT word FROM v))"


def _jg(spark, d):
    v = _vectors(spark, d)
    e = graph.simple_pairs(_graph(spark, d))
    e = e.join(v.select(F.col("word").alias("source")), "source", "left_semi").join(v.select(F.col("word").alias("target")), "target", "left_semi")
    return v, e.select(F.col("source").alias("src"), F.col("target").alias("dst"))


def _coordinates(df):
    return df.select("word", *[F.round(F.get("vec", F.lit(i)), 5).alias(f"x{i}") for i in range(64)])


_F4 = ", ".join(f"round({{}}[{i + 1}], 5) AS x{i}" for i in range(64))


@query(f"""WITH {_JE}, ls AS (SELECT * FROM je UNION ALL SELECT word, word FROM v), dg AS (SELECT dst AS word, count(*) AS d FROM ls GROUP BY 1)
  SELECT ls.dst AS word, {', '.join(f'round(sum(v.vec[{i + 1}] / sqrt(a.d)) / sqrt(any_value(b.d)), 5) AS x{i}' for i in range(64))} FROM ls JOIN v ON v.word = ls.src JOIN dg a ON a.word = ls.src JOIN dg b ON b.word = ls.dst GROUP BY ls.dst""")
def j3_gcn(spark, d):
    v, e = _jg(spark, d)
    return _coordinates(layers.gcn(v, e, 64))


@query(f"WITH {_JE} SELECT v.word, {', '.join(f'round(coalesce(avg(s.vec[{i + 1}]), 0), 5) AS x{i}' for i in range(64))} FROM v LEFT JOIN je ON je.dst = v.word LEFT JOIN v s ON s.word = je.src GROUP BY v.word")
def j4_sage_mean(spark, d):
    v, e = _jg(spark, d)
    return _coordinates(layers.sage_mean(v, e, 64))


@query(f"""WITH {_JE}, at0 AS (SELECT je.src, je.dst, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.vec[i] + b.vec[i] > 0 THEN a.vec[i] + b.vec[i] ELSE 0.2 * (a.vec[i] + b.vec[i]) END)) AS s FROM je JOIN v a ON a.word = je.src JOIN v b ON b.word = je.dst)
  SELECT src, dst, round(exp(s) / sum(exp(s)) OVER (PARTITION BY dst), 5) AS alpha FROM at0""")
def j5_attention(spark, d):
    v, e = _jg(spark, d)
    return layers.attention(v, e, [1.0] * 64, 64).select("src", "dst", F.round("alpha", 5).alias("alpha"))


@query(f"""WITH {_G}, {_V} SELECT g.target AS word, length(g.relation) AS etype, {', '.join(f'round(avg(v.vec[{i + 1}]), 5) AS x{i}' for i in range(64))} FROM g JOIN v ON v.word = g.source GROUP BY 1, 2""")
def j6_rgcn_mean(spark, d):
    v = _vectors(spark, d)
    e = _graph(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.length("relation").alias("etype"))
    r = layers.rgcn_mean(v, e, 64)
    return r.select("word", "etype", *[F.round(F.get("vec", F.lit(i)), 5).alias(f"x{i}") for i in range(64)])


@query(f"WITH {_V} SELECT word, {', '.join(f'round(vec[{i + 1}] / sqrt(list_inner_product(vec, vec)), 5) AS x{i}' for i in range(64))} FROM v")
def j7_l2_normalize(spark, d):
    return _coordinates(_vectors(spark, d).withColumn("vec", layers.l2_normalize(F.col("vec"))))


@query(f"WITH {_JE} SELECT src AS source, dst AS target, round(list_inner_product(a.vec, b.vec), 5) AS score FROM je JOIN v a ON a.word = src JOIN v b ON b.word = dst")
def j8_bilinear_scores(spark, d):
    v, e = _jg(spark, d)
    s = layers.bilinear_scores(e.select(F.col("src").alias("source"), F.col("dst").alias("target")), v)
    return s.withColumn("score", F.round("score", 5))


@query(f"WITH {_SCORED}, a AS (SELECT score / 1000 AS p, row_number() OVER (ORDER BY score, label) AS i FROM sc WHERE label = 1), b AS (SELECT score / 1000 AS n, row_number() OVER (ORDER BY score, label) AS i FROM sc WHERE label = 0) SELECT round(avg(ln(1 + exp(-(p - n)))), 6) AS loss, count(*) AS n_pairs FROM a JOIN b USING (i)")
def j9_bpr_loss(spark, d):
    s = _scored(spark, d).withColumn("score", F.col("score") / 1000)
    w = Window.partitionBy("label").orderBy("score")
    s = s.withColumn("i", F.row_number().over(w))
    a, b = s.filter("label = 1").select("i", F.col("score").alias("p")), s.filter("label = 0").select("i", F.col("score").alias("n"))
    return a.join(b, "i").agg(F.round(F.avg(layers.bpr_loss(F.col("p"), F.col("n"))), 6).alias("loss"), F.count(F.lit(1)).alias("n_pairs"))


@query(f"""WITH {_JE}, m AS (SELECT v.word, v.vec AS x, list_transform(range(1, 65), lambda i: coalesce(s.m[i], 0)) AS y FROM v LEFT JOIN (SELECT dst AS word, [{', '.join(f'avg(a.vec[{i + 1}])' for i in range(64))}] AS m FROM je JOIN v a ON a.word = src GROUP BY dst) s USING (word))
  SELECT word, {', '.join(f"round(list_sum(list_transform(range(1, {n + 1}), lambda i: i * ({e}))), 4) AS {k}" for k, n, e in (('gate', 64, '0.25 * x[i] + 0.75 * y[i]'), ('concat', 128, 'CASE WHEN i <= 64 THEN x[i] ELSE y[i - 64] END'), ('weighted', 64, '0.3 * x[i] + 0.7 * y[i]'), ('sum', 64, 'x[i] + y[i]'), ('gnn_only', 64, 'x[i]'), ('aux_only', 64, 'y[i]')))} FROM m""")
def j12_ensemble_modes(spark, d):
    v, e = _jg(spark, d)
    m = v.select("word", F.col("vec").alias("x")).join(layers.sage_mean(v, e, 64).select("word", F.col("vec").alias("y")), "word")
    gate = F.array_repeat(F.lit(0.25), 64)
    weighted = lambda v: F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    modes = {"gate": gate, "concat": 0.5, "weighted": 0.3, "sum": 0.5, "gnn_only": 0.5, "aux_only": 0.5}
    return m.select("word", *[F.round(weighted(layers.ensemble(F.col("x"), F.col("y"), k, g)), 4).alias(k) for k, g in modes.items()])


@query(f"WITH {_LONG}, z AS (SELECT model, round(avg(value), 6) AS m FROM lm WHERE metric = 'ari' AND NOT isnan(value) GROUP BY model) SELECT arg_max(model, (m, model = 'gcn')) AS model FROM z WHERE model IN ('ensemble', 'gcn')")
def j13_best_auxiliary(spark, d):
    return metrics.best_aux(metrics.summary(_seeds(spark, d), ["model"]), "ensemble", "gcn")


# ---- K: evaluation ---------------------------------------------------------------------------------------------------
@query(f"WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc), z AS (SELECT sum(label) AS p, count(*) - sum(label) AS n, sum(CASE WHEN label = 1 THEN rk END) AS s FROM r) SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auc FROM z")
def k1_roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d))


_THR = f"{_SCORED}, x AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM sc GROUP BY score), t AS (SELECT score, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp FROM x WINDOW w AS (ORDER BY score DESC))"


@query(f"WITH {_THR} SELECT round(sum(p / pp * tp / (tp + fp)), 6) AS ap FROM t")
def k2_average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d))


@query(f"WITH {_THR} SELECT score AS threshold, round(2 * tp / (tp + fp + pp), 9) AS f1 FROM t ORDER BY f1 DESC, score LIMIT 1")
def k3_best_f1_threshold(spark, d):
    return metrics.best_f1_threshold(_scored(spark, d))


@query(f"WITH {_SCORED}, z AS (SELECT count(*) FILTER (score >= 2000 AND label = 1) AS tp, count(*) FILTER (score >= 2000 AND label = 0) AS fp, count(*) FILTER (score < 2000 AND label = 1) AS fn FROM sc) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM z")
def k4_scores_at_threshold(spark, d):
    return metrics.scores_at(_scored(spark, d), 2000.0)


@query(f"""WITH {_G}, {_V}, h AS (SELECT *, {_draw(42, 'source', 'relation', 'target')} AS hh FROM g), t0 AS (SELECT DISTINCT source, target FROM h QUALIFY row_number() OVER (ORDER BY hh) <= greatest(1, floor(0.1::DOUBLE * count(*) OVER ()))),
  t AS (SELECT source, target, a.vec AS vs, round(list_inner_product(a.vec, b.vec), 6) AS truth FROM t0 JOIN v a ON a.word = source JOIN v b ON b.word = target),
  ids AS (SELECT word, vec, row_number() OVER (ORDER BY word) - 1 AS i FROM v), kn AS (SELECT DISTINCT source, target AS word FROM g),
  dr AS (SELECT t.source, t.target, ids.word, min(k) AS k FROM t, (SELECT unnest(range(0, 2392)) AS k) r JOIN ids ON ids.i = {_draw(42, 't.source', 't.target', 'r.k')} % (SELECT count(*) FROM v)
    WHERE ids.word <> t.target AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.source = t.source AND kn.word = ids.word) GROUP BY ALL),
  c AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY k, word) <= 299),
  rk AS (SELECT t.source, t.target, 1 + coalesce(sum((round(list_inner_product(t.vs, v.vec), 6) > t.truth)::INT), 0) AS rank FROM t LEFT JOIN c USING (source, target) LEFT JOIN v ON v.word = c.word GROUP BY t.source, t.target)
  SELECT round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits1, round(avg((rank <= 5)::INT), 6) AS hits5, round(avg((rank <= 10)::INT), 6) AS hits10 FROM rk""")
def k5_filtered_ranking(spark, d):
    v = _vectors(spark, d)
    e = sampling.global_split(_graph(spark, d))
    return search.ranking_metrics(search.filtered_ranks(e.filter("split = 'test'"), e, v))


@query(f"""WITH {_V}, {_N}, x AS (SELECT v.word, v.vec, p.pos FROM v JOIN (SELECT word, min(pos) AS pos FROM n WHERE pos <> '' GROUP BY word) p USING (word)), m AS (SELECT pos, count(*) AS n FROM x GROUP BY pos),
  s AS (SELECT a.word, a.pos AS own, b.pos, sum(1 - list_cosine_similarity(a.vec, b.vec)) AS far FROM x a JOIN x b ON true GROUP BY ALL),
  z AS (SELECT word, max(CASE WHEN s.pos = own AND m.n > 1 THEN far / (m.n - 1) END) AS a, min(CASE WHEN s.pos <> own THEN far / m.n END) AS b FROM s JOIN m ON m.pos = s.pos GROUP BY word)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM z""")
def k6_silhouette(spark, d):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = _vectors(spark, d).join(_nodes(spark, d).filter("pos <> ''").groupBy("word").agg(F.min("pos").alias("pos")), "word")
    ids = curate.label_ids(v, "pos")
    x = v.join(F.broadcast(ids.select(F.col("label").alias("pos"), F.col("label_id").cast("double").alias("prediction"))), "pos").select("prediction", array_to_vector("vec").alias("features"))
    s = ClusteringEvaluator(distanceMeasure="cosine").evaluate(x)
    return spark.createDataFrame([(round(s, 6),)], "silhouette double")


@query(f"""WITH {_G}, {_V}, pr AS (SELECT relation, source, target, a.vec AS vs, b.vec AS vt, row_number() OVER (PARTITION BY relation ORDER BY source, target) AS i FROM (SELECT DISTINCT relation, source, target FROM g) JOIN v a ON a.word = source JOIN v b ON b.word = target QUALIFY i <= 24),
  p4 AS (SELECT *, count(*) OVER (PARTITION BY relation) AS c FROM pr QUALIFY c >= 4),
  q AS (SELECT x.relation, x.i, y.i AS j, x.source AS s, x.target AS t, y.source AS base, list_transform(range(1, 65), lambda k: x.vt[k] - x.vs[k] + y.vs[k]) AS vec FROM p4 x JOIN p4 y ON x.relation = y.relation AND x.i <> y.i QUALIFY row_number() OVER (PARTITION BY x.relation ORDER BY x.i, y.i) <= 500),
  sm AS (SELECT q.relation, q.i, q.j, q.base, v.word, row_number() OVER (PARTITION BY q.relation, q.i, q.j ORDER BY round(list_cosine_similarity(q.vec, v.vec), 6) DESC, v.word) AS rank FROM q JOIN v ON v.word NOT IN (q.s, q.t, q.base) WHERE list_inner_product(q.vec, q.vec) > 0 QUALIFY rank <= 10),
  ft AS (SELECT relation, i, j, min(CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.relation = sm.relation AND g.source = sm.base AND g.target = sm.word) THEN rank END) AS f FROM sm GROUP BY ALL)
  SELECT relation, count(*) AS n_queries, round(avg((coalesce(f, 99) <= 1)::INT), 6) AS acc_1, round(avg((coalesce(f, 99) <= 5)::INT), 6) AS acc_5, round(avg((coalesce(f, 99) <= 10)::INT), 6) AS acc_10 FROM ft GROUP BY relation""")
def k9_analogy(spark, d):
    return search.analogy_accuracy(_graph(spark, d), _vectors(spark, d))


_KEYS = ["model", "mode"]


@query(None)
def k10_bca_intervals(spark, d):
    return metrics.bca_intervals(_seeds(spark, d), _KEYS)


@query(f"""WITH {_LONG}, v AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY model, mode, metric) AS n FROM lm WHERE NOT isnan(value) WINDOW w AS (PARTITION BY model, mode, metric ORDER BY value)),
  b AS (SELECT a.model, a.mode, a.metric, r.b, avg(s.value) AS boot FROM v a, (SELECT unnest(range(0, 9999)) AS b) r JOIN v s ON s.model = a.model AND s.mode = a.mode AND s.metric = a.metric AND s.i = {_draw(0, 'a.model', 'a.mode', 'a.metric', 'r.b', 'a.i')} % a.n GROUP BY ALL)
  SELECT model, mode, metric, round(quantile_cont(boot, 0.025), 6) AS ci_low, round(quantile_cont(boot, 0.975), 6) AS ci_high FROM b GROUP BY ALL""")
def k10_percentile_intervals(spark, d):
    return metrics.percentile_intervals(_seeds(spark, d), _KEYS)


_T = _values([(n, str(round(metrics.t_quantile(0.975, n - 1), 12))) for n in range(2, 60)], "n_seeds, t").replace("t(n_seeds, t)", "tq(n_seeds, tv)")


@query(f"""WITH {_LONG}, z AS (SELECT model, mode, metric, count(*) AS n_seeds, avg(value) AS m, stddev_samp(value) AS s FROM lm WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)
  SELECT model, mode, metric, z.n_seeds, round(m, 6) AS mean, round(m - coalesce(tv::DOUBLE * s / sqrt(z.n_seeds), 0), 6) AS ci_low, round(m + coalesce(tv::DOUBLE * s / sqrt(z.n_seeds), 0), 6) AS ci_high FROM z LEFT JOIN {_T} ON tq.n_seeds = z.n_seeds""")
def k11_t_intervals(spark, d):
    return metrics.t_intervals(_seeds(spark, d), _KEYS)


@query(f"""WITH {_LONG}, z AS (SELECT model, mode, metric, count(*) FILTER (WHERE NOT isnan(value)) AS n_seeds, avg(value) FILTER (WHERE NOT isnan(value)) AS m, stddev_samp(value) FILTER (WHERE NOT isnan(value)) AS s FROM lm GROUP BY ALL)
  SELECT model, mode, metric, z.n_seeds, round(coalesce(m, 'nan'), 6) AS mean, round(coalesce(m - coalesce(tv::DOUBLE * s / sqrt(z.n_seeds), 0), 'nan'), 6) AS ci_low, round(coalesce(m + coalesce(tv::DOUBLE * s / sqrt(z.n_seeds), 0), 'nan'), 6) AS ci_high, 0.95::DOUBLE AS ci_level, 't' AS method FROM z LEFT JOIN {_T} ON tq.n_seeds = z.n_seeds""")
def k12_intervals(spark, d):
    return metrics.intervals(_seeds(spark, d), _KEYS, "t")


@query()
def k12_intervals_bca(spark, d):
    return metrics.intervals(_seeds(spark, d), _KEYS)


@query(f"WITH {_LONG}, z AS (SELECT CASE WHEN mode = '' THEN 'baseline/' || model ELSE model END AS model, metric, value FROM lm WHERE NOT isnan(value)) SELECT model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n_seeds FROM z GROUP BY ALL")
def k13_seed_summary(spark, d):
    s = _seeds(spark, d).withColumn("model", F.when(F.col("mode") == "", F.concat(F.lit("baseline/"), "model")).otherwise(F.col("model")))
    return metrics.summary(s, ["model"])


@query("SELECT seed, model, coalesce(mode, '') AS mode, u.metric, u.value FROM results_ensemble, LATERAL (VALUES ('ari', ari), ('silhouette', silhouette)) u(metric, value) WHERE u.value IS NOT NULL AND NOT isnan(u.value)")
def k14_flatten(spark, d):
    s = _seeds(spark, d)
    return s.filter(F.col("metric").isin("ari", "silhouette") & F.col("value").isNotNull() & ~F.isnan("value"))


@query(f"WITH {_LONG} SELECT model, round(avg(value) FILTER (metric = 'ari'), 6) AS ari, round(avg(value) FILTER (metric = 'nmi'), 6) AS nmi, round(avg(value) FILTER (metric = 'silhouette'), 6) AS silhouette FROM lm WHERE NOT isnan(value) GROUP BY model")
def k15_summary_pivot(spark, d):
    return metrics.pivot_summary(metrics.summary(_seeds(spark, d), ["model"]), ["ari", "nmi", "silhouette"])


_PAIRS_SCORED = "round(list_cosine_similarity(a.vec, b.vec), 6) AS score"


@query(f"""WITH {_JE}, z AS (SELECT src AS source, dst AS target, {_PAIRS_SCORED} FROM je JOIN v a ON a.word = src JOIN v b ON b.word = dst),
  neg AS (SELECT DISTINCT source, target FROM negative_samples x WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM p WHERE p.source = x.source AND p.target = x.target)),
  y AS (SELECT source, target, {_PAIRS_SCORED} FROM neg JOIN v a ON a.word = source JOIN v b ON b.word = target)
  SELECT * FROM (SELECT source, target, score, 'missed' AS kind FROM z ORDER BY score, source, target LIMIT 20) UNION ALL SELECT * FROM (SELECT source, target, score, 'false alarm' AS kind FROM y ORDER BY score DESC, source, target LIMIT 20)""")
def l3_worst_pairs(spark, d):
    """The links scored lowest and the negatives scored highest."""
    v, e = _jg(spark, d)
    v = v.withColumn("vec", layers.l2_normalize(F.col("vec")))
    neg = _t(spark, d, "negative_samples").filter("label = 0").select("source", "target").distinct().join(_graph(spark, d).select("source", "target"), ["source", "target"], "left_anti")
    links = layers.bilinear_scores(e.select(F.col("src").alias("source"), F.col("dst").alias("target")), v).withColumn("score", F.round("score", 6))
    others = layers.bilinear_scores(neg, v).withColumn("score", F.round("score", 6))
    low = links.orderBy("score", "source", "target").limit(20).withColumn("kind", F.lit("missed"))
    return low.unionByName(others.orderBy(F.desc("score"), "source", "target").limit(20).withColumn("kind", F.lit("false alarm")))


# ---- J: learning; results without an oracle in SQL ---------------------------------------------------------------------
def _model_input(spark, d, sc):
    """((id, word, cat, tri, label), (src, dst, etype) with reverses, labels of each categorical, relation types, parts of speech)."""
    from ..operators.features import CATEGORICAL, categorical_ids, trigram_ids, trigram_vocabulary

    nodes, edges = curate.curated_graph(_nodes(spark, d), _edges(spark, d).select("edge_id", *derive.EDGE))
    nodes, edges = sc.cut(nodes), sc.cut(edges.select("source", "relation", "target"))
    from ..operators.features import homogeneous_graph

    types = [r for r, _ in rules.canonical_classes()]
    ids, e = homogeneous_graph(nodes, edges, types)
    cat = categorical_ids(nodes)
    sizes = [curate.label_ids(nodes, c).count() for c in CATEGORICAL]
    tri = trigram_ids(nodes.select("word"), trigram_vocabulary(nodes.select("word")))
    pos = curate.label_ids(nodes, "pos").filter(F.col("label").isin("", "unknown", "<UNK>")).select(F.col("label_id").alias("pos_id"), F.lit(-1).alias("label"))
    x = ids.join(cat, "word").join(tri, "word", "left").join(F.broadcast(pos), "pos_id", "left")
    x = x.select("id", "word", F.array(*[f"{c}_id" for c in CATEGORICAL]).alias("cat"), F.coalesce("tri_ids" if "tri_ids" in tri.columns else "ids", F.array().cast("array<int>")).alias("tri"), F.coalesce("label", "pos_id").alias("label"))
    return sc.cut(x), sc.cut(e), sizes, 2 * (len(types) + 1), sizes[0]


def _training(spark, d, kind, epochs, feat=128, hid=256, out=128, **more):
    """One model trained on nine tenths of the links and validated on a tenth, with its negatives."""
    from ..operators import fullbatch, models

    sc = Scratch(spark)
    nodes, edges, sizes, types, parts = _model_input(spark, d, sc)
    split = sc.cut(sampling.global_split(edges.filter(F.col("etype") < types // 2).withColumnsRenamed({"src": "source", "dst": "target"}), unit=("source", "target")))
    kept = split.filter("split = 'train'").select("source", "target", "etype")
    both = kept.select(F.col("source").alias("src"), F.col("target").alias("dst"), "etype")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("etype") + types // 2).alias("etype")))
    model = models.Encoder(nodes.select("id", "cat", "tri"), both, kind, feat, hid, out, sc, types=types if kind == "rgcn" else 1, labels=sizes, trigrams=6001, **more)
    words = nodes.select(F.col("id").cast("string").alias("word"), F.col("label").cast("string").alias("pos")).withColumn("pos", F.when(F.col("pos") == "-1", "unknown").otherwise(F.col("pos")))

    def negatives(of, seed):
        n = sampling.hard_negatives(of.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")), words, seed=seed).filter("valid")
        return n.select(*[F.col(c).cast("long").alias(c) for c in ("source", "target", "negative")])

    def pairs_of(epoch):
        p = kept.join(negatives(kept, 42 + epoch), ["source", "target"])
        return sc.cut(p.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("negative").alias("w"), "etype"), "pairs")

    held = split.filter("split = 'val'").select("source", "target").distinct()
    wrong = sampling.uniform_negatives(split.select("source", "target"), words.select(F.col("word"), F.lit("unknown").alias("pos")).selectExpr("CAST(word AS BIGINT) AS word", "pos"), max(1, held.count()), "val")
    val = sc.cut(held.withColumn("label", F.lit(1)).unionByName(wrong.select("source", "target", F.lit(0).alias("label"))))
    heads = {"types": types // 2, "labels": nodes.select("id", "label"), "parts": parts}
    if kind in WHOLE:
        return model, fullbatch.train(model, kept, words, val, epochs, **heads), val
    t = models.train(model, pairs_of, val, epochs, every=max(1, epochs // 2), **heads)
    return model, t, val


def _history(spark, t):
    return spark.createDataFrame([("loss", i, float(x)) for i, x in enumerate(t.losses)] + [("val_auc", i, float(x)) for i, x in enumerate(t.aucs)], "metric string, step int, value double")


#: Encoders trained by tasks that keep their nodes (``operators/fullbatch.py``).
WHOLE = ("gcn", "sage", "rgcn")

#: Epochs of j5 and j12, each a dozen jobs over the whole graph; the operators' own default is 200 with patience 30.
EPOCHS = 1
#: Epochs of the encoders in ``WHOLE``, validated each 10 with patience 30.
WHOLE_EPOCHS = 200


@query()
def j3_train_gcn(spark, d):
    """Embedder, two-layer GCN, decoder and both heads trained together; losses by epoch and validation AUC."""
    return _history(spark, _training(spark, d, "gcn", WHOLE_EPOCHS)[1])


@query()
def j4_train_sage(spark, d):
    return _history(spark, _training(spark, d, "sage", WHOLE_EPOCHS, 64, 128, 64)[1])


@query()
def j5_train_gat(spark, d):
    return _history(spark, _training(spark, d, "gat", EPOCHS, 16, 16, 16, heads=2)[1])


@query()
def j6_train_rgcn(spark, d):
    return _history(spark, _training(spark, d, "rgcn", WHOLE_EPOCHS, 64, 256, 64, bases=32)[1])


@query()
def j2_node_embedding(spark, d):
    """(word, x0 ... x63): the embedder of labels and trigrams with its first parameters."""
    from ..operators import models

    sc = Scratch(spark)
    nodes, edges, sizes, _, _ = _model_input(spark, d, sc)
    m = models.Encoder(nodes.select("id", "cat", "tri"), edges.limit(0), "sage", 64, 8, 8, sc, labels=sizes, trigrams=6001)
    return _coordinates(m.features().join(nodes.select("id", "word"), "id"))


def _both_vectors(spark, d, sc):
    """(id, gnn, aux) of every word with a vector: the vector, and the mean over its neighbours."""
    v, e = _jg(spark, d)
    ids = sc.cut(curate.dense_ids(v))
    b = v.join(ids, "word").select("word", "id", F.col("vec").alias("gnn")).join(layers.sage_mean(v, e, 64).select("word", F.col("vec").alias("aux")), "word")
    e = e.join(ids.select(F.col("word").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("word").alias("dst"), F.col("id").alias("target")), "dst").select("source", "target")
    return sc.cut(b.select("id", "gnn", "aux")), sc.cut(e.distinct())


@query()
def j12_ensemble_ablation(spark, d):
    """The six ways to join two models' vectors, trained on the same links; test metrics, the threshold fixed on validation."""
    from ..operators import models

    sc = Scratch(spark)
    both, e = _both_vectors(spark, d, sc)
    s = sc.cut(sampling.global_split(e, unit=("source", "target")))
    words = both.select(F.col("id").alias("word"), F.lit("unknown").alias("pos"))
    wrong = {k: sampling.uniform_negatives(e, words, max(1, s.filter(F.col("split") == k).count()), k) for k in ("val", "test")}
    part = {k: sc.cut(s.filter(F.col("split") == k).select("source", "target", F.lit(1).alias("label")).unionByName(w.select("source", "target", F.lit(0).alias("label")))) for k, w in wrong.items()}
    train = s.filter("split = 'train'").select("source", "target")
    neg = sc.cut(sampling.hard_negatives(train, words).filter("valid"))
    pairs = neg.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("negative").alias("w"))
    return models.ablation(both, 64, 64, lambda epoch: pairs, part["val"], part["test"], sc, epochs=EPOCHS)


@query()
def j14_walk_embedding(spark, d):
    from ..operators.embed import walk_embedding

    return walk_embedding(_graph(spark, d)).select("word", F.size("vec").alias("dim"))


@query(rf"""WITH {_V}, vt AS (SELECT vec, unnest(list_transform(range(1, length(word) + 1), lambda i: substr('#' || word || '#', i, 3))) AS t FROM v), tv AS (SELECT t, [{', '.join(f'avg(vec[{i + 1}])' for i in range(64))}] AS m FROM vt GROUP BY t), {_TRI}
  SELECT word, {', '.join(f'round(avg(m[{i + 1}]), 5) AS x{i}' for i in range(64))} FROM tri JOIN tv USING (t) GROUP BY word""")
def j15_subword_embedding(spark, d):
    from ..operators.embed import subword_embedding

    return _coordinates(subword_embedding(_vectors(spark, d), _nodes(spark, d).select("word"), 64))


@query()
def j16_text_embedding(spark, d):
    from ..operators.embed import hashed_text_provider, text_embedding

    return _coordinates(text_embedding(curate.keep_first(_nodes(spark, d).select("word", "definition_hy", "node_id"), ["word"], ["node_id"]), hashed_text_provider(64), 64))


@query()
def j17_pca(spark, d):
    from ..operators.embed import pca

    return pca(_vectors(spark, d), 16, 32).select("word", F.size("vec").alias("dim"))


@query()
def j18_kmeans(spark, d):
    from ..operators.embed import kmeans

    return kmeans(_vectors(spark, d), 10)


@query()
def j19_tsne(spark, d):
    from ..operators.embed import tsne

    return tsne(_vectors(spark, d))


__all__ = ["ORACLES", "QUERIES", "connected_components", "draw"]
