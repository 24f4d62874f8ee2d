"""Exact vector search for given queries, analogies and filtered ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..scratch import Scratch, bounded_broadcast
from .curate import dense_ids
from .layers import dot, l2_normalize, project

MAX_QUERIES = 20_000


def _packed(rows, col):
    return np.array([r[col] for r in rows], dtype=np.float64)


def _keep_best(i, words, sims, k):
    """The ``k`` best of each query number ``i`` by similarity, ties by word."""
    t = pd.DataFrame({"i": i, "w": words, "s": sims}).sort_values(["i", "s", "w"], ascending=[True, False, True])
    t = t[t.groupby("i").cumcount() < k]
    return t["i"].to_numpy(), t["w"].to_numpy(), t["s"].to_numpy()


def knn(queries: DataFrame, index: DataFrame, k: int, banned: str | None = None) -> DataFrame:
    """(qid, word, sim, rank): the ``k`` most similar index words of each query by cosine (6 decimals, ties by word).

    ``queries``: qid, vec and optionally an array of words to leave out. A stated
    query set against all rows: queries go in blocks of ``MAX_QUERIES`` to every
    partition of the index, each partition keeps its best ``k`` a query, and the
    few that are left are ranked.
    """
    out = None
    queries = Scratch(index.sparkSession).cut(queries)
    n = queries.count()
    blocks = max(1, -(-n // MAX_QUERIES))
    for b in range(blocks):
        q = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = q.collect()  # at most about MAX_QUERIES
        if not rows:
            continue
        ids = np.array([r["qid"] for r in rows], dtype=object)
        m = _packed(rows, "vec")
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        most = max((len(r[banned] or ()) for r in rows), default=0) if banned else 0
        skip = np.array([[*(r[banned] or ()), *[None] * (most - len(r[banned] or ()))] for r in rows], dtype=object) if most else None

        def scan(batches, ids=ids, m=m, skip=skip, most=most):
            bi, bw, bs = np.zeros(0, int), np.zeros(0, object), np.zeros(0)
            for batch in batches:
                if not len(batch):
                    continue
                words = batch["word"].to_numpy()
                v = np.stack(batch["vec"].to_numpy()).astype(np.float64)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                take = min(len(words), k + most)
                for at in range(0, len(ids), 1024):
                    s = np.round(m[at : at + 1024] @ v.T, 6)
                    cut = np.partition(s, len(words) - take, axis=1)[:, len(words) - take]
                    i, j = np.nonzero(s >= cut[:, None])
                    ok = ~(words[j][:, None] == skip[at + i]).any(1) if skip is not None else np.ones(len(i), bool)
                    i, j = i[ok], j[ok]
                    bi, bw, bs = np.concatenate([bi, at + i]), np.concatenate([bw, words[j]]), np.concatenate([bs, s[i, j]])
                if len(bi) > 4 * k * len(ids):
                    bi, bw, bs = _keep_best(bi, bw, bs, k)
            bi, bw, bs = _keep_best(bi, bw, bs, k)
            yield pd.DataFrame({"qid": ids[bi], "word": bw, "sim": bs})

        kind = dict(queries.dtypes)["qid"]
        part = index.select("word", "vec").mapInPandas(scan, f"qid {kind}, word string, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return index.sparkSession.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, word string, sim double, rank int")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "word")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_words(index: DataFrame, words: list[str], k: int = 5) -> DataFrame:
    """(word, neighbour, sim, rank) of given words, themselves left out."""
    q = index.filter(F.col("word").isin(words)).select(F.col("word").alias("qid"), "vec", F.array("word").alias("skip"))
    return knn(q, index, k, "skip").select(F.col("qid").alias("word"), F.col("word").alias("neighbour"), "sim", "rank")


def analogy_queries(edges: DataFrame, index: DataFrame, pairs: int = 24, most: int = 500, least: int = 4) -> DataFrame:
    """(relation, i, j, s, t, base, vec): t_i - s_i + s_j over ordered pairs of each relation's first edges, i-major."""
    e = edges.select("relation", "source", "target").distinct().join(index.select(F.col("word").alias("source"), F.col("vec").alias("vs")), "source").join(index.select(F.col("word").alias("target"), F.col("vec").alias("vt")), "target")
    w = Window.partitionBy("relation").orderBy("source", "target")
    e = e.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= pairs).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("relation"))).filter(F.col("n") >= least)
    b = e.select("relation", F.col("i").alias("j"), F.col("source").alias("base"), F.col("vs").alias("vb"))
    q = e.join(b, "relation").filter("i <> j")
    at = Window.partitionBy("relation").orderBy("i", "j")
    q = q.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= most)
    vec = F.zip_with(F.zip_with(F.col("vt"), F.col("vs"), lambda x, y: x - y), F.col("vb"), lambda x, y: x + y)
    q = q.select("relation", "i", "j", F.col("source").alias("s"), F.col("target").alias("t"), "base", vec.alias("vec"))
    return q.filter(dot(F.col("vec"), F.col("vec")) > 0).withColumn("vec", l2_normalize(F.col("vec")))


def analogy_accuracy(edges: DataFrame, index: DataFrame, ks=(1, 5, 10), pairs: int = 24, most: int = 500) -> DataFrame:
    """Per relation the share of queries with a known target of (relation, base) among the first k."""
    index = Scratch(index.sparkSession).cut(index.select("word", "vec"))
    q = Scratch(index.sparkSession).cut(analogy_queries(edges, index, pairs, most).withColumn("qid", F.concat_ws("|", "relation", "i", "j")))
    near = knn(q.select("qid", "vec", F.array("s", "t", "base").alias("skip")), index, max(ks), "skip")
    ok = edges.select("relation", F.col("source").alias("base"), F.col("target").alias("word")).distinct()
    hit = near.join(q.select("qid", "relation", "base"), "qid").join(ok, ["relation", "base", "word"]).groupBy("qid").agg(F.min("rank").alias("first"))
    r = q.select("qid", "relation").join(hit, "qid", "left")
    return r.groupBy("relation").agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("int")), 6).alias(f"acc_{k}") for k in ks])


def ranking_candidates(tests: DataFrame, known: DataFrame, words: DataFrame, n: int, seed: int = 42, rounds: int = 4) -> DataFrame:
    """(source, target, word): exactly ``n`` words a test pair that are no known target of the source nor the target; all there are where fewer exist.

    2 n hashed draws a round, only for pairs that still lack some; pairs left
    after ``rounds`` rounds take words in word order: of the first 2 n + degree
    at least what is missing is free.
    """
    sc = Scratch(tests.sparkSession)
    ids = sc.cut(dense_ids(words).select(F.col("id").alias("i"), "word"))
    total = max(ids.count(), 1)
    pairs = sc.cut(tests.select("source", "target").distinct())
    taken = sc.cut(known.select("source", F.col("target").alias("word")).distinct())
    open_, have = pairs, None
    at = Window.partitionBy("source", "target").orderBy("k", "word")

    def best(c: DataFrame) -> DataFrame:
        c = c.groupBy("source", "target", "word").agg(F.min("k").alias("k"))
        return c.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= n).drop("at")

    for r in range(rounds + 1):  # the draws, 2 n times the pairs, look small to Catalyst, which would broadcast them
        if r < rounds:
            k = F.sequence(F.lit(2 * n * r).cast("long"), F.lit(2 * n * (r + 1) - 1).cast("long"))
            d = open_.withColumn("k", F.explode(k)).withColumn("i", F.pmod(draw(seed, "source", "target", "k"), F.lit(total)))
        else:
            deg = taken.groupBy("source").agg(F.count(F.lit(1)).alias("deg"))
            up_to = F.least(F.lit(total), F.lit(2 * n + 1) + F.coalesce("deg", F.lit(0))) - 1
            d = open_.join(deg, "source", "left").select("source", "target", F.explode(F.sequence(F.lit(0).cast("long"), up_to.cast("long"))).alias("i")).withColumn("k", F.lit(2 * n * rounds) + F.col("i"))
        c = d.join(ids.hint("shuffle_hash"), "i").filter("word <> target").select("source", "target", "word", "k").join(taken, ["source", "word"], "left_anti")
        have = sc.cut(best(c if have is None else c.unionByName(have)), "have")
        full = have.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
        open_ = sc.cut(pairs.join(full, ["source", "target"], "left_anti"), "open")
        if open_.limit(1).count() == 0:
            break
    return have.select("source", "target", "word")


def filtered_ranks(tests: DataFrame, known: DataFrame, index: DataFrame, n: int = 299, seed: int = 42, ws=None, wt=None) -> DataFrame:
    """(source, target, rank): 1 + the candidates that score above the true target (6 decimals); the score is <W_s u, W_t v>, the dot product without matrices."""
    sc = Scratch(index.sparkSession)
    v = sc.cut(index.select("word", "vec"))  # read four times below; the plan that makes it is large
    src = sc.cut(project(v, ws)) if ws is not None else v
    tgt = sc.cut(project(v, wt)) if wt is not None else v
    t = tests.select("source", "target").distinct().join(src.select(F.col("word").alias("source"), F.col("vec").alias("vs")), "source").join(tgt.select(F.col("word").alias("target"), F.col("vec").alias("vt")), "target")
    t = sc.cut(t.select("source", "target", "vs", F.round(dot(F.col("vs"), F.col("vt")), 6).alias("true")))
    c = ranking_candidates(t, known, v, n, seed).join(tgt, "word").select("source", "target", "vec")
    above = (F.round(dot(F.col("vs"), F.col("vec")), 6) > F.col("true")).cast("int")
    s = c.join(bounded_broadcast(t, 50_000), ["source", "target"]).groupBy("source", "target").agg(F.sum(above).alias("above"))  # summed before a shuffle
    return t.select("source", "target").join(s, ["source", "target"], "left").select("source", "target", (1 + F.coalesce("above", F.lit(0))).alias("rank"))


def ranking_metrics(ranks: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    return ranks.agg(F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), *[F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"hits{k}") for k in ks])
