"""Embeddings from walks, text and features, and their reductions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prompt, trigrams
from .layers import vector_sum
from .skipgram import walk_vectors


def walk_embedding(edges: DataFrame, walks: int = 10, length: int = 40, dim: int = 64, window: int = 5, epochs: int = 1, seed: int = 42) -> DataFrame:
    """(word, vec): skip-gram vectors of uniform walks (return and in-out weights 1)."""
    return walk_vectors(edges, walks, length, dim, window, epochs, seed)


def subword_embedding(vectors: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """(word, vec) for any word: the mean of its trigrams' vectors, those being means over the words that have them."""
    t = vectors.select(F.explode(trigrams("word")).alias("t"), "vec")
    n = t.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    tv = vector_sum(t, ["t"], dim=dim).join(n, "t").select("t", F.transform("vec", lambda x: x / F.col("n")).alias("vec"))
    w = words.select("word").distinct().select("word", F.explode(trigrams("word")).alias("t")).join(tv, "t")
    k = w.groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    return vector_sum(w.select("word", "vec"), ["word"], dim=dim).join(k, "word").select("word", F.transform("vec", lambda x: x / F.col("k")).alias("vec"))


def text_embedding(nodes: DataFrame, provider, dim: int) -> DataFrame:
    """(word, vec) of each word's prompt text; ``provider`` maps a list of texts to an array (n, dim), in batches on the executors."""
    import pandas as pd

    def run(batches):
        for b in batches:
            v = np.asarray(provider(b["text"].tolist()), dtype=float).reshape(len(b), dim)
            yield pd.DataFrame({"word": b["word"], "vec": list(v)})

    return nodes.select("word", prompt("word", "definition_hy").alias("text")).mapInPandas(run, "word string, vec array<double>")


def hashed_text_provider(dim: int):
    """A stand-in provider without weights: signed hashed trigrams, scaled to length 1."""

    def run(texts):
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            p = f"#{t}#"
            for j in range(len(p) - 2):
                h = zlib.crc32(p[j : j + 3].encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def pca(vectors: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """(word, vec): the first ``k`` principal components, padded with zeros to ``width``."""
    x = vectors.select("word", array_to_vector("vec").alias("f"))
    p = PCA(k=k, inputCol="f", outputCol="p").fit(x).transform(x).select("word", vector_to_array("p").alias("vec"))
    return p if not width or width <= k else p.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), width - k)))


def kmeans(vectors: DataFrame, k: int, starts: int = 20, seed: int = 42) -> DataFrame:
    """(word, cluster) of the best of ``starts`` runs by training cost."""
    x = vectors.select("word", array_to_vector("vec").alias("features")).persist()
    best = None
    for i in range(starts):
        m = KMeans(k=k, seed=seed + i, maxIter=20).fit(x)
        if best is None or m.summary.trainingCost < best[0]:
            best = (m.summary.trainingCost, m)
    x.unpersist()
    return best[1].transform(vectors.select("word", array_to_vector("vec").alias("features"))).select("word", F.col("prediction").alias("cluster"))


def tsne(vectors: DataFrame, most: int = 2000, perplexity: float = 30.0, steps: int = 250, seed: int = 42) -> DataFrame:
    """(word, x, y) of at most ``most`` words (a plot's bound, picked by hash), exact t-SNE started from two principal components."""
    from ..functions.hashing import draw

    rows = vectors.orderBy(draw(seed, "word"), "word").limit(most).toPandas()  # a bounded sample for a plot
    n = len(rows)
    x = np.stack(rows["vec"].to_numpy()) if n else np.zeros((0, 2))
    if n < 3:
        y = np.zeros((n, 2))
    else:
        x = x - x.mean(0)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        y = u[:, :2] * s[:2]
        y = y / (y[:, 0].std() + 1e-12) * 1e-4
        d = ((x[:, None] - x[None]) ** 2).sum(-1) if n <= 500 else (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
        lo, hi = np.full(n, 1e-12), np.full(n, 1e12)
        want = np.log(min(perplexity, (n - 1) / 3))
        for _ in range(60):
            beta = np.sqrt(lo * hi)
            p = np.exp(-d * beta[:, None])
            np.fill_diagonal(p, 0)
            s = p.sum(1) + 1e-300
            h = np.log(s) + beta * (d * p).sum(1) / s
            lo, hi = np.where(h > want, beta, lo), np.where(h > want, hi, beta)
        p = p / s[:, None]
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        v, gain = np.zeros_like(y), np.ones_like(y)
        for t in range(steps):
            q = 1 / (1 + (y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T)
            np.fill_diagonal(q, 0)
            w = (p * (12 if t < 100 else 1) - q / q.sum()) * q
            g = 4 * (w.sum(1)[:, None] * y - w @ y)
            gain = np.maximum(np.where(np.sign(g) != np.sign(v), gain + 0.2, gain * 0.8), 0.01)
            v = (0.5 if t < 100 else 0.8) * v - max(n / 48, 50) * gain * g
            y = y + v
    rows["x"], rows["y"] = (y[:, 0], y[:, 1]) if n else ([], [])
    return vectors.sparkSession.createDataFrame(rows[["word", "x", "y"]], "word string, x double, y double") if n else vectors.sparkSession.createDataFrame([], "word string, x double, y double")
