"""Skip-gram vectors of walks: counts of the pairs within a window, and training over blocks of words."""

from __future__ import annotations

import math
import uuid
from hashlib import md5

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .curate import dense_ids
from .graph import random_walks, simple_pairs

#: Links that go to every task as two arrays (at most 100 MB); beyond, walks are made by joins. The counts are the same.
PACKED = 8_000_000
#: Most words of a block; two blocks and their pairs are what a training task holds. Smaller tables make sqrt(words / SPLIT) blocks, for tasks at once.
BLOCK, SPLIT = 300_000, 25_000
#: Words to a row of a stored block.
CHUNK = 8192
#: Weight of the drawn contexts of a pair, how many are drawn for the pairs of a batch together, pairs of a batch, parts that a pair's count is spread over.
NEGATIVES, DRAWN, BATCH, PARTS, RATE = 5, 128, 1024, 4, 0.1


def walk_counts(edges: DataFrame, ids: DataFrame, walks: int, length: int, window: int, seed: int, scratch: Scratch, packed: int = PACKED) -> DataFrame:
    """(a, b, n), a <= b: pairs of words up to ``window`` apart in the walks of ``random_walks`` from every source.

    ``ids`` are dense integers in word order. A pair d apart adds window - d + 1 to
    n, which is window times its chance under a window drawn from 1 to ``window``.
    Every source also has a row of its own with 0, should its walks have no pair.
    """
    starts = edges.select(F.col("source").alias("word")).distinct()
    own = starts.join(ids, "word").select("word", "id")
    links = scratch.cut(simple_pairs(edges), "links")
    if links.count() <= packed:
        n = _counts_packed(links, own, ids, walks, length, window, seed)
    else:
        n = _counts_joined(edges, starts, ids, walks, length, window, seed, scratch)
    n = n.unionByName(own.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("n")))
    n = scratch.cut(n.groupBy("a", "b").agg(F.sum("n").alias("n")), codec="zstd")
    scratch.drop("links")
    return n


def _counts_joined(edges, starts, ids, walks, length, window, seed, scratch) -> DataFrame:
    w = random_walks(edges, starts, walks, length, seed, scratch).filter(F.size("path") > 1)
    d = w.select("path", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d")).filter(F.size("path") > F.col("d"))
    both = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - F.col("d")).alias("x"), F.slice("path", F.col("d") + 1, F.size("path")).alias("y"))
    p = d.select(F.explode(both).alias("p"), (window + 1 - F.col("d")).cast("long").alias("n"))
    p = p.select(F.least("p.x", "p.y").alias("x"), F.greatest("p.x", "p.y").alias("y"), "n").groupBy("x", "y").agg(F.sum("n").alias("n"))
    return p.join(ids.select(F.col("word").alias("x"), F.col("id").alias("a")), "x").join(ids.select(F.col("word").alias("y"), F.col("id").alias("b")), "y").select("a", "b", "n")


def _counts_packed(links, own, ids, walks, length, window, seed) -> DataFrame:
    spark = links.sparkSession
    size = ids.count()
    t = links.join(ids.select(F.col("word").alias("source"), F.col("id").alias("a")), "source").join(ids.select(F.col("word").alias("target"), F.col("id").alias("b")), "target").select(F.col("a").cast("int"), F.col("b").cast("int")).toArrow()  # bounded by PACKED
    key = np.sort(t["a"].to_numpy().astype(np.int64) * size + t["b"].to_numpy())
    first = np.searchsorted(key, np.arange(size + 1, dtype=np.int64) * size)
    graph = spark.sparkContext.broadcast((first, (key % size).astype(np.int32)))
    del t, key

    def merged(codes, n):
        codes, at = np.unique(np.concatenate(codes), return_inverse=True)
        return codes, np.bincount(at, np.concatenate(n), len(codes)).astype(np.int64)

    def walk(words, ids):
        first, target = graph.value
        begun = [md5(f"{seed}|{w}|{k}|".encode()) for w in words for k in range(walks)]
        path = np.full((length, len(begun)), -1, np.int64)
        path[0] = at = np.repeat(ids, walks)
        live = np.arange(len(begun))
        for step in range(1, length):
            deg = first[at + 1] - first[at]
            on = deg > 0
            live, at, deg = live[on], at[on], deg[on]
            if not len(at):
                break
            i, many, tail = np.zeros(len(at), np.int64), np.flatnonzero(deg > 1), str(step).encode()
            for k, x in zip(many.tolist(), live[many].tolist(), strict=True):
                h = begun[x].copy()
                h.update(tail)
                i[k] = int.from_bytes(h.digest()[:8]) >> 4  # as hashing.draw
            at = target[first[at] + i % deg].astype(np.int64)
            path[step, live] = at
        codes, n = [], []
        for d in range(1, min(window, length - 1) + 1):
            x, y = path[:-d], path[d:]
            x, y = x[y >= 0], y[y >= 0]
            c, k = np.unique(np.minimum(x, y) * size + np.maximum(x, y), return_counts=True)
            codes.append(c)
            n.append(k * (window + 1 - d))
        return (codes, n) if codes else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])

    def run(batches):
        codes, n = [], []
        for b in batches:
            for j in range(0, len(b), 1000):
                c, k = walk(b["word"].iloc[j : j + 1000], b["id"].to_numpy()[j : j + 1000])
                codes += c
                n += k
                if sum(map(len, codes)) > 2_000_000:
                    c, k = merged(codes, n)
                    codes, n = [c], [k]
                    if len(c) > 1_000_000:
                        yield pd.DataFrame({"a": c // size, "b": c % size, "n": k})
                        codes, n = [], []
        if codes:
            c, k = merged(codes, n)
            yield pd.DataFrame({"a": c // size, "b": c % size, "n": k})

    return own.repartition(max(2 * spark.sparkContext.defaultParallelism, own.count() // 20_000)).mapInPandas(run, "a long, b long, n long")


def _step(table: np.ndarray, rows: np.ndarray, grad: np.ndarray, dim: int) -> None:
    """Adagrad by rows; repeated rows are summed."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    g, rows = np.add.reduceat(grad[order], first, axis=0), rows[first]
    table[rows, dim] += (g * g).mean(1)
    table[rows, :dim] += RATE * g / np.sqrt(table[rows, dim] + 1e-12)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(x, y, z, w, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sum w (log s(x y) + NEGATIVES mean log s(-x z)) by centres x, contexts y and drawn contexts z; ``own`` marks where z is the pair's own context."""
    g = w * (1 - _sigmoid(np.einsum("bd,bd->b", x, y)))
    h = _sigmoid(x @ z.T) * (-w * NEGATIVES / len(z))[:, None]
    h[own] = 0
    return g[:, None] * y + h @ z, g[:, None] * x, h.T @ x


def train_bucket(u, c, n, into, out, dim: int, rng) -> None:
    """Negative sampling over pairs (u, c) with counts ``n``, changing both tables; contexts are drawn by count ** 0.75."""
    into[u, dim + 1] = 1  # words that walks visit
    u, c, n = u[n > 0], c[n > 0], n[n > 0]
    if not len(u):
        return
    heap = np.cumsum(np.bincount(c, n, len(out)) ** 0.75)
    heap /= heap[-1]
    w = (n / PARTS).astype(np.float32)
    size = min(max(len(u) // 64, 16), BATCH)
    for _ in range(PARTS):
        mixed = rng.permutation(len(u))
        for k in range(0, len(u), size):
            b = mixed[k : k + size]
            far = np.searchsorted(heap, rng.random(DRAWN), side="right")
            dx, dy, dz = gradients(into[u[b], :dim], out[c[b], :dim], out[far, :dim], w[b], c[b][:, None] == far)
            _step(into, u[b], dx, dim)
            _step(out, np.r_[c[b], far], np.concatenate([dy, dz]), dim)


def _save(uri: str, x: np.ndarray) -> None:
    """Whole or not at all; a task run again writes the same."""
    fs, path = FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(x.reshape(-1).view(np.uint8))
    fs.move(part, path)


def _load(uri: str, x: np.ndarray, row: int = 0) -> None:
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(row * x.shape[1] * x.itemsize)
        f.readinto(x.reshape(-1).view(np.uint8))


def skip_gram(counts: DataFrame, size: int, dim: int, epochs: int, seed: int, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """(id, vec) of every id in ``counts`` (a, b, n); ids are below ``size``. Pairs count in both directions.

    Ids are dealt to blocks. In a round every block of centres meets one block of
    contexts, in a task that holds these two; after as many rounds as there are
    blocks all pairs have been met. Tasks keep the blocks in the shared folder,
    each round's beside those of the round before.
    """
    spark = counts.sparkSession
    blocks = blocks or max(1, math.ceil(size / BLOCK), math.ceil(math.sqrt(size / SPLIT)))
    p = counts.unionByName(counts.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    deal = lambda x: F.pmod(x, F.lit(blocks)).cast("int")
    local = lambda x: F.floor(F.col(x) / blocks).cast("int")
    p = p.select(deal(F.col("b") - F.col("a")).alias("r"), deal(F.col("a")).alias("i"), local("a").alias("u"), local("b").alias("c"), "n")
    p = scratch.cut(p.repartition("r", "i").sortWithinPartitions("r"), "buckets", codec="zstd")
    width, rows = dim + 2, [(size - b + blocks - 1) // blocks for b in range(blocks)]  # a row: vector, sum of squares, visited
    root, kept = scratch.root, {}  # kept: where a kind's block is, by (kind, block)

    def task(turn, epoch, r, kept):
        def train(key, pairs):
            i = int(key[0])
            tables = []
            for kind, b in enumerate((i, (i + r) % blocks)):
                x = np.zeros((rows[b], width), np.float32)
                if (kind, b) in kept:
                    _load(kept[kind, b], x)
                elif kind == 0:
                    x[:, :dim] = (np.random.default_rng([seed, b]).random((len(x), dim), np.float32) - 0.5) / dim
                tables.append(x)
            order = np.lexsort((pairs["c"], pairs["u"]))
            u, c, n = (pairs[k].to_numpy()[order] for k in ("u", "c", "n"))
            train_bucket(u, c, n, *tables, dim, np.random.default_rng([seed, epoch, r, i]))
            for kind, b in enumerate((i, (i + r) % blocks)):
                _save(f"{root}/vectors-{turn}-{kind}-{b}", tables[kind])
            return pd.DataFrame({"i": [i]})

        return train

    for turn, (epoch, r) in enumerate((epoch, r) for epoch in range(epochs) for r in range(blocks)):
        # by range, so that every block has a task of its own
        done = p.filter(F.col("r") == r).select("i", "u", "c", "n").repartitionByRange(blocks, "i").groupBy("i").applyInPandas(task(turn, epoch, r, dict(kept)), "i int").collect()
        for (i,) in done:
            for kind, b in enumerate((i, (i + r) % blocks)):
                scratch.drop(f"vectors-{kind}-{b}")
                scratch.at[f"vectors-{kind}-{b}"] = kept[kind, b] = f"{root}/vectors-{turn}-{kind}-{b}"
    scratch.drop("buckets", *[f"vectors-1-{b}" for b in range(blocks)])

    def vectors(batches):
        for batch in batches:
            for b, at in batch[["b", "at"]].itertuples(index=False):
                x = np.empty((min(CHUNK, rows[b] - at), width), np.float32)
                _load(kept[0, b], x, at)
                seen = np.flatnonzero(x[:, dim + 1])
                yield pd.DataFrame({"id": (seen + at) * blocks + b, "vec": list(x[seen, :dim])})

    chunks = [(b, at) for b in range(blocks) if (0, b) in kept for at in range(0, rows[b], CHUNK)]
    return spark.createDataFrame(chunks, "b int, at long").mapInPandas(vectors, "id long, vec array<float>")


def walk_vectors(edges: DataFrame, walks: int, length: int, dim: int, window: int, epochs: int, seed: int) -> DataFrame:
    """(word, vec) of every word in the walks."""
    sc = Scratch(edges.sparkSession)
    edges = sc.cut(simple_pairs(edges).dropna(), "edges")
    words = edges.select(F.col("source").alias("word")).unionByName(edges.select(F.col("target").alias("word")))
    ids = sc.cut(dense_ids(words))
    counts = walk_counts(edges, ids, walks, length, window, seed, sc)
    sc.drop("edges")
    v = skip_gram(counts.withColumn("n", F.col("n") / window), ids.count(), dim, epochs, seed, sc)
    return ids.join(v, "id").select("word", F.col("vec").cast("array<double>").alias("vec"))
