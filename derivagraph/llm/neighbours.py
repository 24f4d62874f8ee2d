"""Most similar vectors for every vector: a forest of random-projection trees.

The trees' hyperplanes are fitted on a bounded sample (about ``SAMPLE`` vectors,
those with the smallest content hashes); every vector is indexed. A query descends all
trees at once with one shared priority queue over their branches, ordered by
the largest margin passed on the wrong side, and visits the best ``PROBES``
leaves within ``REACH``; candidates of a leaf are reranked exactly in double precision. Equal
vectors are one class: copies never meet in a leaf, they are expanded at the end.
Leaves are cut to chunks of ``CHUNK`` members, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

SAMPLE, TREES, PROBES, LEAF, MAX_DEPTH, CHUNK = 20_000, 2, 6, 4_000, 12, 10_000
#: A branch is visited only if no hyperplane was passed on its wrong side by more than this.
REACH = 0.08
MIN_COS, K = 0.87, 5
#: Far more than the error of a cosine in single precision.
SLACK = 1e-4


_UNIT = float((1 << 23) - 1)


def pack(unit: np.ndarray) -> list[bytes]:
    """Rows of numbers in [-1, 1] as 24-bit integers (an error of 6e-8, that of float32): a quarter less to move."""
    if not len(unit):
        return []
    q = np.ascontiguousarray(np.rint(unit * _UNIT).astype("<i4"))
    b = np.ascontiguousarray(q.view(np.uint8).reshape(len(q), -1, 4)[:, :, :3])
    return [r.tobytes() for r in b]


def matrix(col) -> np.ndarray:
    """Packed vectors to unit rows in double precision."""
    n = len(col)
    if not n:
        return np.zeros((0, 1))
    b = np.frombuffer(b"".join(col), dtype=np.uint8).reshape(n, -1, 3)
    full = np.zeros((n, b.shape[1], 4), np.uint8)
    full[:, :, 1:] = b  # the sign moves to the top byte
    m = full.view("<i4")[:, :, 0].astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vector_table(df: DataFrame, columns: list[str], key: str = "vec_id") -> DataFrame:
    """(vec_id, digest, v): usable vectors, scaled to length 1 and packed; a missing, NaN, infinite or all-zero one is left out.

    ``digest`` is the same for vectors that pack to the same bytes: copies, also scaled ones.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = b[columns].to_numpy(dtype=np.float64, na_value=np.nan)
            ok = np.isfinite(m).all(1) & (m != 0).any(1)
            m = m[ok]
            v = pack(m / np.linalg.norm(m, axis=1, keepdims=True))
            yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[ok], "digest": [hashlib.blake2b(x, digest_size=16).digest() for x in v], "v": v})

    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), *columns).mapInPandas(read, "vec_id long, digest binary, v binary")


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes (trees, 2^depth, dim) and their offsets, in heap order from 1: each parts its vectors at the median between two drifting centres."""
    n, dim = sample.shape
    planes, offsets = np.zeros((trees, 1 << depth, dim), np.float32), np.zeros((trees, 1 << depth), np.float32)
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        at = {1: np.arange(n)}
        for node in range(1, 1 << depth):
            idx = at.pop(node, np.zeros(0, int))
            w = None
            if len(idx) >= 2:
                a, b = sample[rng.choice(idx, 2, replace=False)]
                for _ in range(3):
                    w = a - b
                    s = sample[idx] @ w
                    side = s > np.median(s)
                    if side.all() or not side.any():
                        break
                    a, b = sample[idx[side]].mean(0), sample[idx[~side]].mean(0)
                w = w if np.linalg.norm(w) > 1e-9 else None
            if w is None:
                w = rng.standard_normal(dim)
            w = w / np.linalg.norm(w)
            s = sample[idx] @ w
            off = float(np.median(s)) if len(idx) else 0.0
            planes[t, node], offsets[t, node] = w, off
            at[2 * node], at[2 * node + 1] = idx[s <= off], idx[s > off]
    return planes, offsets


def route(x: np.ndarray, planes: np.ndarray, offsets: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``probes`` leaves of each row over all trees, best first: arrays (tree, leaf, priority), each (n, probes).

    The queues of a batch advance together, one level at a time; a branch whose
    priority is not among the best ``probes`` of its row can never be visited.
    """
    trees, size, _ = planes.shape
    n = len(x)
    tree = np.repeat(np.arange(trees)[None, :], n, 0)
    node = np.ones((n, trees), np.int64)
    pri = np.zeros((n, trees))
    proj = [x @ planes[t].T - offsets[t] for t in range(trees)] if 1 < size <= 512 else None
    rows = np.arange(n)[:, None]
    level = 1
    while level < size:
        if proj is not None:
            m = np.stack(proj)[tree, rows, node]
        else:
            m = np.einsum("nkd,nd->nk", planes[tree, node], x) - offsets[tree, node]
        near, far = 2 * node + (m > 0), 2 * node + (m <= 0)
        node, tree = np.concatenate([near, far], 1), np.concatenate([tree, tree], 1)
        pri = np.concatenate([pri, np.maximum(pri, np.maximum(np.abs(m), 1e-12))], 1)  # a row on a plane still has one home
        if node.shape[1] > probes:
            o = np.argpartition(pri, probes - 1, axis=1)[:, :probes]
            node, tree, pri = (np.take_along_axis(a, o, 1) for a in (node, tree, pri))
        level *= 2
    o = np.argsort(pri, axis=1, kind="stable")
    return tuple(np.take_along_axis(a, o, 1) for a in (tree, node, pri))


def _leaf_of_each_tree(x, planes, offsets):
    out = [route(x, planes[t : t + 1], offsets[t : t + 1], 1)[1][:, 0] for t in range(len(planes))]
    return np.stack(out, 1)


class Index:
    """Classes of equal vectors, their members, and the forest over the classes."""

    def __init__(self, vectors: DataFrame, scratch: Scratch | None = None, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, sample: int = SAMPLE):
        self.sc = scratch or Scratch(vectors.sparkSession)
        vectors = self.sc.cut(vectors, "vectors")
        first = vectors.groupBy("digest").agg(F.min("vec_id").alias("rep"))
        self.members = self.sc.cut(vectors.select("vec_id", "digest").join(first, "digest").select("rep", "vec_id"))
        copies = self.members.filter("rep <> vec_id").select("vec_id")
        self.classes = self.sc.cut(vectors.join(copies, "vec_id", "left_anti"))
        self.sc.drop("vectors")
        n = self.classes.count()
        self.n, self.probes = n, probes
        depth = int(min(MAX_DEPTH, max(1, np.ceil(np.log2(max(n, 1) / leaf)))))
        self.depth = depth
        if n:
            # content hashes are uniform: those below this one are about ``sample`` classes, whatever n
            bar = F.lit(bytearray(int(min(1.0, sample / n) * (2**32 - 1)).to_bytes(4, "big")))
            s = self.classes.filter(F.substring("digest", 1, 4) <= bar).select("v").toPandas()
            self.planes, self.offsets = fit_forest(matrix(s["v"]), depth, trees)
        else:
            self.planes, self.offsets = np.zeros((1, 1, 1), np.float32), np.zeros((1, 1), np.float32)
        self._chunks: dict[tuple[int, int], int] | None = None

    def _chunk_counts(self) -> dict[tuple[int, int], int]:
        """Chunks of each leaf that needs more than one: at most TREES * 2^MAX_DEPTH leaves, counted in Spark."""
        if self._chunks is None:
            planes, offsets = self.planes, self.offsets

            def leaves(batches):
                for b in batches:
                    lf = _leaf_of_each_tree(matrix(b["v"]), planes, offsets)
                    yield pd.DataFrame({"tree": np.tile(np.arange(lf.shape[1]), len(lf)), "leaf": lf.ravel()})

            c = self.classes.select("v").mapInPandas(leaves, "tree int, leaf long").groupBy("tree", "leaf").count().filter(F.col("count") > CHUNK).collect()
            self._chunks = {(r["tree"], r["leaf"]): -(-r["count"] // CHUNK) for r in c}
        return self._chunks

    def blocks(self, queries: DataFrame | None = None) -> DataFrame:
        """(bin, role, id, v): each row once per leaf (and chunk) it belongs to or visits.

        Role 0 is an index row, 1 a query, 2 both. Where the classes query
        themselves a row's own leaves are among those it visits, so it moves
        there once.
        """
        planes, offsets, probes, chunks = self.planes, self.offsets, self.probes, self._chunk_counts()
        span = 1 << (MAX_DEPTH + 1)

        def bins(tree, leaf, chunk):
            return tree + len(planes) * (leaf + span * chunk)

        def own_chunk(ids, tree, leaf):
            return np.array([int(r) % chunks.get((int(t), int(x)), 1) for r, t, x in zip(ids, tree, leaf, strict=True)], np.int64) if chunks else np.zeros(len(ids), np.int64)

        def as_index(batches):
            for b in batches:
                lf = _leaf_of_each_tree(matrix(b["v"]), planes, offsets)
                for t in range(lf.shape[1]):
                    yield pd.DataFrame({"bin": bins(t, lf[:, t], own_chunk(b["vec_id"], np.full(len(b), t), lf[:, t])), "role": np.zeros(len(b), np.int8), "id": b["vec_id"], "v": b["v"]})

        def as_query(both):
            def run(batches):
                for b in batches:
                    for i in range(0, len(b), 4096):
                        part = b.iloc[i : i + 4096]
                        ids, v = part["vec_id"].to_numpy(), part["v"].to_numpy()
                        tr, lf, pri = route(matrix(part["v"]), planes, offsets, probes)
                        near = pri <= REACH
                        own = (pri == 0)[near] & both
                        who, tr, lf = np.nonzero(near)[0], tr[near], lf[near]
                        c = np.zeros(len(who), np.int64)
                        if chunks:
                            home = own_chunk(ids[who], tr, lf)
                            k = np.array([chunks.get((int(t), int(x)), 1) for t, x in zip(tr, lf, strict=True)], np.int64)
                            c = np.concatenate([np.arange(j) for j in k]) if len(k) else c
                            who, tr, lf, own, home = (np.repeat(a, k) for a in (who, tr, lf, own, home))
                            own = own & (home == c)
                        yield pd.DataFrame({"bin": bins(tr, lf, c), "role": np.where(own, 2, 1).astype(np.int8), "id": ids[who], "v": v[who]})

            return run

        schema = "bin long, role byte, id long, v binary"
        c = self.classes.select("vec_id", "v")
        if queries is None:
            return c.mapInPandas(as_query(True), schema)
        return c.mapInPandas(as_index, schema).unionByName(queries.select("vec_id", "v").mapInPandas(as_query(False), schema))

    def by_bin(self, blocks: DataFrame):
        """Rows of ``blocks`` grouped by bin, spread over about 40,000 rows a task."""
        n = max(12, int(self.classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.n * self.probes // 40_000)
        return blocks.repartition(n, "bin").groupBy("bin")

    def leaf_neighbours(self, queries: DataFrame | None = None, k: int = K, min_cos: float = MIN_COS) -> DataFrame:
        """(q, id, cos): per visited leaf the best ``k`` others of each query (default: of each class), exactly reranked."""

        def rank(rows: pd.DataFrame) -> pd.DataFrame:
            qs, ids, cs = [], [], []
            left, right = rows[rows["role"] != 1], rows[rows["role"] != 0]
            if len(left) and len(right):
                left = left.sort_values("id", kind="stable")
                mi, m = left["id"].to_numpy(), matrix(left["v"])
                m32 = m.astype(np.float32)
                for i in range(0, len(right), 1024):
                    r = right.iloc[i : i + 1024]
                    home = (r["role"] == 2).to_numpy()
                    qi, q = r["id"].to_numpy(), matrix(r["v"])
                    near = q.astype(np.float32) @ m32.T >= min_cos - SLACK  # what single precision cannot rule out is computed exactly
                    for j in np.flatnonzero(near.sum(1) > home):
                        c = np.flatnonzero(near[j])
                        c = c[mi[c] != qi[j]]
                        s = np.round(m[c] @ q[j], 6)
                        c, s = c[s >= min_cos], s[s >= min_cos]
                        o = np.argsort(-s, kind="stable")[:k]  # ids ascend, so ties go to the smaller
                        qs.extend([qi[j]] * len(o)), ids.extend(mi[c[o]]), cs.extend(s[o])
            return pd.DataFrame({"q": np.array(qs, np.int64), "id": np.array(ids, np.int64), "cos": np.array(cs, np.float64)})

        return self.by_bin(self.blocks(queries)).applyInPandas(rank, "q long, id long, cos double")


def class_neighbours(index: Index, queries: DataFrame | None = None, k: int = K, min_cos: float = MIN_COS) -> DataFrame:
    """(q, near): the best ``k`` other classes of each query class as sorted structs (far = -cos, id); one shuffle, at most ``k`` a visited leaf to a list."""
    found = index.leaf_neighbours(queries, k, min_cos)
    return found.groupBy("q").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cos")).alias("far"), "id"))), 1, k).alias("near"))


def nearest(index: Index, k: int = K, min_cos: float = MIN_COS) -> DataFrame:
    """(vec_id, neighbour, cos): for every vector its ``k`` most similar others of at least ``min_cos``.

    Cosine rounded to 6 decimals, ties to the smaller id. Vectors of a class of
    equals see their smallest fellows first (cosine 1); a class passes on only
    its first k + 1 members, so a group of copies of any size stays cheap.
    Vectors without any are left out; an empty table gives an empty result.
    """
    sc = index.sc
    w = Window.partitionBy("rep").orderBy("vec_id")
    copies = index.members.filter("rep <> vec_id").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)
    heads = sc.cut(copies.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("more")).select("rep", F.concat(F.array("rep"), "more").alias("head")))
    near = sc.cut(class_neighbours(index, None, k, min_cos))
    one = near.select(F.col("q").alias("rep"), F.explode("near").alias("x")).select("rep", F.col("x.far").alias("far"), F.col("x.id").alias("id"))
    one = one.join(heads.select(F.col("rep").alias("id"), "head"), "id", "left")
    other = one.select("rep", "far", F.explode(F.coalesce("head", F.array("id"))).alias("to"))
    own = heads.select("rep", F.lit(-1.0).alias("far"), F.explode("head").alias("to"))
    best = other.unionByName(own).groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "to"))), 1, k * (k + 2)).alias("cand"))
    each = index.members.join(best, "rep")
    take = F.slice(F.filter("cand", lambda x: x["to"] != F.col("vec_id")), 1, k)
    return each.select("vec_id", F.explode(take).alias("x")).select("vec_id", F.col("x.to").alias("neighbour"), (-F.col("x.far")).alias("cos"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Distinct pairs of which either is a neighbour of the other, vec_a < vec_b."""
    return near.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
