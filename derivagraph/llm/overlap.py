"""Records of held-out splits that come back, the same or nearly so, in the training split.

Winnowing: of a record (source, relation, target) one of the two words is the
anchor and the other the text. The text, padded with end marks, is cut into
2-grams; of every window of w grams the gram with the smallest hash is selected
as a seed. Two texts one edit apart share a run of at least w unchanged grams
(w follows the length of the text), and the smallest hash of a window is also the
smallest of every shorter window around it, so they always share a seed. Seeds
are joined across splits under one key of relation, anchor and gram; seeds of a
pair are chained collinearly, the pair is extended to an alignment, and what it
covers is reported.

A seed that very many records of both splits share (a hot anchor whose texts
begin alike) is made longer: within it the join key also holds the text with
one letter left out, one key per place. Texts one edit apart share such a key
too, so nothing is lost and no bucket is paired in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spelling import filled, plain_spelling
from ..operators.relations import with_relation
from ..scratch import Scratch

HOT_PAIRS = 2_000


def records(samples: DataFrame, names: DataFrame) -> DataFrame:
    """sample_id, split, src, rel, dst in comparable form; rows with an empty field or another split are left out."""
    r = with_relation(samples.filter(filled("source", "relation", "target", "split")).select("sample_id", "split", "source", "relation", "target"), names)
    return r.filter(F.col("split").isin("train", "val", "test")).select("sample_id", "split", plain_spelling("source").alias("src"), F.coalesce("_canonical", "_label").alias("rel"), plain_spelling("target").alias("dst"))


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[0] + b * _MIX[1]
    x ^= x >> np.uint64(29)
    x *= _MIX[0]
    return x ^ (x >> np.uint64(32))


def winnow(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, gram hash, place) of the selected 2-grams of each text, padded with end marks.

    Texts of one length go together; window minima come from doubling, so a text
    of any length costs n log n. Equal hashes go to the earlier place.
    """
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(n) - n
    out = []
    for length in np.unique(n):
        every = np.flatnonzero(n == length)
        for k in range(0, len(every), max(1, (1 << 22) // (length + 2))):
            rows = every[k : k + max(1, (1 << 22) // (length + 2))]
            m = np.full((len(rows), length + 2), 2, np.uint64)
            m[:, 1:-1] = codes[start[rows][:, None] + np.arange(length)]
            m[:, -1] = 3
            h = _mixed(m[:, :-1], m[:, 1:])
            w = max(1, int(length - 2) // 2)
            low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(h.shape[1], dtype=np.uint64)  # ordered by hash, then by place
            p = 1
            while 2 * p <= w:
                low = np.minimum(low[:, :-p], low[:, p:])
                p *= 2
            if p < w:
                low = np.minimum(low[:, : low.shape[1] - (w - p)], low[:, w - p :])
            at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
            new = np.ones(at.shape, bool)
            new[:, 1:] = at[:, 1:] != at[:, :-1]
            i, j = np.nonzero(new)
            at = at[i, j]
            out.append((rows[i], h[i, at], at))
            if length <= 1:  # a word of one letter shares no gram with another one: they meet under a key of their own
                out.append((rows, np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _views(classes: DataFrame) -> DataFrame:
    """Each class twice, with source and with target as anchor; training rows only under anchors that a held-out row has too."""
    views = [classes.select("cid", "in_train", "in_eval", F.col(text).alias("text"), F.xxhash64(F.lit(view), "rel", anchor).alias("anchor")) for view, anchor, text in ((0, "src", "dst"), (1, "dst", "src"))]
    rows = views[0].unionByName(views[1])
    asked = rows.filter("in_eval").select("anchor").distinct()
    return rows.filter("in_eval").unionByName(rows.filter("NOT in_eval").join(asked, "anchor", "left_semi").select(rows.columns))


def _seeds(views: DataFrame) -> DataFrame:
    """One row per selected seed: key, cid, sides, text, at (place of the gram)."""

    def run(batches):
        for b in batches:
            text = b["text"].to_numpy()
            i, h, at = winnow(text.tolist())
            key = _mixed(b["anchor"].to_numpy().astype(np.uint64)[i], h).view(np.int64)
            yield pd.DataFrame({"key": key, "cid": b["cid"].to_numpy()[i], "in_train": b["in_train"].to_numpy()[i], "in_eval": b["in_eval"].to_numpy()[i], "text": text[i], "at": at.astype(np.int32)})

    return views.mapInPandas(run, "key long, cid long, in_train boolean, in_eval boolean, text string, at int")


def _gapped(col):
    """The text and the text with each one letter left out: shared by any two texts at most one edit apart."""
    n = F.length(col)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, n)))
    return F.array_distinct(F.concat(F.array(col), cut))


def _pairs(seeds: DataFrame, keys: list[str]) -> DataFrame:
    a = seeds.filter("in_train").select(*keys, F.col("cid").alias("a"), F.col("text").alias("ta"), F.col("at").alias("at_a"))
    b = seeds.filter("in_eval").select(*keys, F.col("cid").alias("b"), F.col("text").alias("tb"), F.col("at").alias("at_b"))
    near = (F.col("a") != F.col("b")) & (F.abs(F.length("ta") - F.length("tb")) <= 1) & (F.abs(F.col("at_a") - F.col("at_b")) <= 1)
    m = a.join(b, keys).filter(near)
    return m.filter(F.levenshtein("ta", "tb", 1) >= 0).select("a", "b", "at_a", "at_b")


def overlaps(recs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, classes, matches) of records that overlap across splits.

    classes: src, rel, dst, cid, in_train, in_eval; ``cid`` is the smallest
    sample_id of all rows with the same content. matches: (a, b, n_seeds,
    coverage) between a class with training rows and one with held-out rows
    (a = b: the same content), n_seeds the length of the longest collinear chain
    of seeds, coverage the share of the held-out record's letters that the
    alignment matches: all of them where the training record only has one letter
    more. Pairs of rows follow by joining both sides to their rows.
    """
    sc = scratch or Scratch(recs.sparkSession)
    recs = sc.cut(recs)
    train = F.col("split") == "train"
    classes = sc.cut(recs.groupBy("src", "rel", "dst").agg(F.min("sample_id").alias("cid"), F.max(train).alias("in_train"), F.max(~train).alias("in_eval")))
    seeds = sc.cut(_seeds(_views(classes)))
    met = seeds.groupBy("key").agg(F.count_if("in_train").alias("nt"), F.count_if("in_eval").alias("ne"))
    hot_keys = sc.cut(met.filter(F.col("nt") * F.col("ne") > HOT_PAIRS).select("key"))
    cool = _pairs(seeds.join(hot_keys, "key", "left_anti"), ["key"])
    hot = _pairs(seeds.join(hot_keys, "key", "left_semi").withColumn("gap", F.explode(_gapped(F.col("text")))).withColumn("gap", F.xxhash64("gap")), ["key", "gap"])
    seen = cool.unionByName(hot).groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("at_a", "at_b"))).alias("chain"))
    # the seeds lie on two neighbouring diagonals: the longest collinear chain counts each place of the shorter text once
    n_seeds = F.size(F.array_distinct(F.transform("chain", lambda s: F.least(s["at_a"], s["at_b"]))))
    c1 = classes.select(F.col("cid").alias("a"), F.col("src").alias("s1"), F.col("rel").alias("r1"), F.col("dst").alias("d1"))
    c2 = classes.select(F.col("cid").alias("b"), F.col("src").alias("s2"), F.col("rel").alias("r2"), F.col("dst").alias("d2"))
    x = seen.select("a", "b", n_seeds.alias("n_seeds")).join(c1, "a").join(c2, "b")
    # the extension: one side equal, the other one edit away
    x = x.filter((F.col("r1") == F.col("r2")) & (F.levenshtein("s1", "s2") + F.levenshtein("d1", "d2") == 1))
    own, other = F.length("s2") + F.length("d2"), F.length("s1") + F.length("d1")
    x = x.select("a", "b", "n_seeds", ((own - F.when(other > own, 0).otherwise(1)) / own).alias("coverage"))
    same = classes.filter("in_train AND in_eval").select(F.col("cid").alias("a"), F.col("cid").alias("b"), (F.length("src") + F.length("dst") + 2).alias("n_seeds"), F.lit(1.0).alias("coverage"))
    return recs, classes, sc.cut(x.unionByName(same))


def _rows_of(recs: DataFrame, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """(cid, sample_id, split) of the records of some classes."""
    c = classes.join(cids.distinct(), "cid", "left_semi").select("cid", "src", "rel", "dst")
    return recs.join(c, ["src", "rel", "dst"]).select("cid", "sample_id", "split")


def overlap_pairs(recs: DataFrame, classes: DataFrame, matches: DataFrame) -> DataFrame:
    """Every (train row, held-out row) of the matches as sample_a < sample_b."""
    a = _rows_of(recs.filter("split = 'train'"), classes, matches.select(F.col("a").alias("cid"))).select(F.col("cid").alias("a"), F.col("sample_id").alias("x"))
    b = _rows_of(recs.filter("split <> 'train'"), classes, matches.select(F.col("b").alias("cid"))).select(F.col("cid").alias("b"), F.col("sample_id").alias("y"))
    return matches.select("a", "b").join(a, "a").join(b, "b").select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b"))


def overlap_report(recs: DataFrame, classes: DataFrame, matches: DataFrame) -> DataFrame:
    """Per held-out split and source word: rows, rows that overlap with training, rows that come back the same, and their mean best coverage."""
    best = matches.groupBy("b").agg(F.max("coverage").alias("coverage"), F.max(F.col("a") == F.col("b")).alias("same"))
    c = classes.filter("in_eval").join(best, F.col("cid") == F.col("b"), "left").select("src", "rel", "dst", "coverage", "same")
    m = recs.filter("split <> 'train'").join(c, ["src", "rel", "dst"])
    return m.groupBy("split", F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("coverage").alias("n_overlapping"), F.count_if("same").alias("n_same"), F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 6).alias("mean_coverage"))
