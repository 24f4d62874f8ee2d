"""Message passing, scoring and ensembles over (word, vec ARRAY<DOUBLE>) and typed edges.

Weights are matrices of a layer's fixed size that travel with the task and are
applied by one product a batch; aggregation over neighbours stays in built-in
expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def vector_sum(df: DataFrame, by: list[str], vec: str = "vec", dim: int = 64) -> DataFrame:
    """Componentwise sums per key: one flat aggregation with ``dim`` partial sums, combined map-side."""
    return df.groupBy(*by).agg(F.array(*[F.sum(F.get(F.col(vec), F.lit(i))) for i in range(dim)]).alias(vec))


def project(nodes: DataFrame, w: Sequence[Sequence[float]], b: Sequence[float] | None = None) -> DataFrame:
    """(word, W vec + b) by one matrix product a batch; the matrix (a layer's, of fixed size) travels with the task."""
    m, c = np.asarray(w, dtype=float), 0.0 if b is None else np.asarray(b, dtype=float)

    def run(batches):
        for x in batches:
            y = np.stack(x["vec"].to_numpy()) @ m.T + c if len(x) else np.zeros((0, len(m)))
            yield pd.DataFrame({"word": x["word"], "vec": list(y)})

    return nodes.select("word", "vec").mapInPandas(run, f"word {dict(nodes.dtypes)['word']}, vec array<double>")


def gcn(nodes: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """One propagation with self-loops: sum of h_j / sqrt(d_i d_j) over in-neighbours j and i itself; edges: src, dst."""
    e = edges.select("src", "dst").unionByName(nodes.select(F.col("word").alias("src"), F.col("word").alias("dst")))
    deg = e.groupBy(F.col("dst").alias("word")).agg(F.count(F.lit(1)).alias("d"))
    h = nodes.join(deg, "word").select(F.col("word").alias("src"), scale(F.col("vec"), 1 / F.sqrt("d")).alias("vec"))
    s = vector_sum(e.join(h, "src").select(F.col("dst").alias("word"), "vec"), ["word"], dim=dim)
    return s.join(deg, "word").select("word", scale(F.col("vec"), 1 / F.sqrt("d")).alias("vec"))


def sage_mean(nodes: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Mean over in-neighbours; zeros without any."""
    m = edges.select("src", "dst").join(nodes.select(F.col("word").alias("src"), "vec"), "src")
    n = m.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    s = vector_sum(m.select(F.col("dst").alias("word"), "vec"), ["word"], dim=dim).join(n.withColumnRenamed("dst", "word"), "word").select("word", scale(F.col("vec"), 1 / F.col("n")).alias("mean"))
    zero = F.array(*[F.lit(0.0)] * dim)
    return nodes.select("word").join(s, "word", "left").select("word", F.coalesce("mean", zero).alias("vec"))


def rgcn_mean(nodes: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """(word, etype, vec): mean over in-neighbours by edge type, to be weighted by each type's matrix."""
    m = edges.select("src", "dst", "etype").join(nodes.select(F.col("word").alias("src"), "vec"), "src")
    n = m.groupBy("dst", "etype").agg(F.count(F.lit(1)).alias("n"))
    s = vector_sum(m.select("dst", "etype", "vec"), ["dst", "etype"], dim=dim).join(n, ["dst", "etype"])
    return s.select(F.col("dst").alias("word"), "etype", scale(F.col("vec"), 1 / F.col("n")).alias("vec"))


def rgcn(nodes: DataFrame, edges: DataFrame, dim: int, root: Sequence[Sequence[float]], bases: Sequence, mix: dict[int, Sequence[float]]) -> DataFrame:
    """W0 h_i + sum over types of mean_j W_r h_j with W_r = sum of mix[r][b] * bases[b].

    Each type's mean is mixed into one long vector, a part for each basis, and
    summed in one aggregation; the node's own vector goes in front, so that one
    product with [W0, bases...] gives the layer.
    """
    per = rgcn_mean(nodes, edges, dim)
    table = F.broadcast(nodes.sparkSession.createDataFrame([(r, [float(x) for x in c]) for r, c in mix.items()], "etype int, c array<double>"))  # one row a type
    mixed = per.join(table, "etype").select("word", F.flatten(F.transform("c", lambda c: F.transform("vec", lambda x: c * x))).alias("vec"))
    more = vector_sum(mixed, ["word"], dim=dim * len(bases)).withColumnRenamed("vec", "more")
    zero = F.array_repeat(F.lit(0.0), dim * len(bases))
    long = nodes.select("word", "vec").join(more, "word", "left").select("word", F.concat("vec", F.coalesce("more", zero)).alias("vec"))
    return project(long, np.concatenate([np.asarray(root, float), *[np.asarray(b, float) for b in bases]], axis=1))


def attention(nodes: DataFrame, edges: DataFrame, a: Sequence[float], dim: int, slope: float = 0.2) -> DataFrame:
    """(src, dst, alpha): softmax over the in-edges of a word of a . LeakyReLU(h_i + h_j)."""
    e = edges.select("src", "dst").distinct().join(nodes.select(F.col("word").alias("src"), F.col("vec").alias("hj")), "src").join(nodes.select(F.col("word").alias("dst"), F.col("vec").alias("hi")), "dst")
    z = F.transform(add(F.col("hi"), F.col("hj")), lambda x: F.when(x > 0, x).otherwise(x * slope))
    e = e.select("src", "dst", dot(z, F.array(*[F.lit(float(x)) for x in a])).alias("s"))
    top = e.groupBy("dst").agg(F.max("s").alias("m"))
    e = e.join(top, "dst").withColumn("x", F.exp(F.col("s") - F.col("m")))
    total = e.groupBy("dst").agg(F.sum("x").alias("t"))
    return e.join(total, "dst").select("src", "dst", (F.col("x") / F.col("t")).alias("alpha"))


def gat(nodes: DataFrame, edges: DataFrame, a: Sequence[float], dim: int) -> DataFrame:
    al = attention(nodes, edges, a, dim).join(nodes.select(F.col("word").alias("src"), "vec"), "src")
    return vector_sum(al.select(F.col("dst").alias("word"), scale(F.col("vec"), F.col("alpha")).alias("vec")), ["word"], dim=dim)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean
    return F.transform(v, lambda x: (x - mean) / F.sqrt(var + eps))


def bilinear_scores(pairs: DataFrame, nodes: DataFrame, ws=None, wt=None) -> DataFrame:
    """score = <W_s z_u, W_t z_v>; each word is projected once; without matrices the plain dot product."""
    s = (project(nodes, ws) if ws is not None else nodes).select(F.col("word").alias("source"), F.col("vec").alias("zs"))
    t = (project(nodes, wt) if wt is not None else nodes).select(F.col("word").alias("target"), F.col("vec").alias("zt"))
    return pairs.join(s, "source").join(t, "target").withColumn("score", dot(F.col("zs"), F.col("zt"))).drop("zs", "zt")


def bpr_loss(pos: Column, neg: Column) -> Column:
    """-log sigmoid(pos - neg), stable for large differences."""
    x = pos - neg
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ensemble(x: Column, y: Column, mode: str, gate: Column | float = 0.5) -> Column:
    """Vectors of two models in one of six ways, with the projections already applied; 'gate' takes a vector of gates, 'weighted' one weight."""
    if mode == "gate":
        return F.zip_with(F.zip_with(gate, x, lambda g, v: g * v), F.zip_with(gate, y, lambda g, v: (1 - g) * v), lambda p, q: p + q)
    if mode == "weighted":
        g = F.lit(gate) if isinstance(gate, float) else gate
        return F.zip_with(x, y, lambda p, q: g * p + (1 - g) * q)
    if mode == "concat":
        return F.concat(x, y)
    if mode == "sum":
        return add(x, y)
    if mode == "gnn_only":
        return x
    if mode == "aux_only":
        return y
    raise ValueError(mode)


def char_cnn(words: DataFrame, kernels: dict[int, np.ndarray], table: np.ndarray, length: int = 32) -> DataFrame:
    """(word, ids ARRAY<INT>) to (word, vec): embedded trigram ids, 1-d convolutions of each width with max-pooling, ReLU."""

    def run(batches):
        for b in batches:
            n = len(b)
            x = np.zeros((n, length), np.int64)
            for i, ids in enumerate(b["ids"]):
                k = np.asarray(ids if ids is not None else [], np.int64)[:length]
                x[i, : len(k)] = k
            e = table[np.clip(x, 0, len(table) - 1)]
            out = []
            for width, w in kernels.items():  # w: (channels, width, dim)
                p = np.pad(e, ((0, 0), (width // 2, width // 2), (0, 0)))
                win = np.stack([p[:, j : j + length] for j in range(width)], 2)
                out.append(np.maximum(np.einsum("nlwd,cwd->nlc", win, w), 0).max(1))
            yield pd.DataFrame({"word": b["word"], "vec": list(np.concatenate(out, 1).astype(float))})

    return words.select("word", "ids").mapInPandas(run, "word string, vec array<double>")


def top_k_by(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
