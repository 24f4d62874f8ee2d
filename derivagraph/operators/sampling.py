"""Negative samples and splits, reproducible by hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..scratch import Scratch, bounded_broadcast
from .ranks import numbered, smallest

STRATEGIES = ("random", "typed", "relation_corrupt")


def pools(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pos, i, word), (pos, n)): words numbered within their part of speech, and under pos '*' all together."""
    w = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.coalesce(F.min(F.when(~F.col("pos").isin("", "unknown"), F.col("pos"))), F.lit("unknown")).alias("pos"))
    both = w.unionByName(w.withColumn("pos", F.lit("*")))
    p = Scratch(words.sparkSession).cut(numbered(both, ["pos"], ["word"]).select("word", "pos", "i"))
    return p, p.groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def negatives(positives: DataFrame, words: DataFrame, strategy: str = "typed", per_positive: int = 1, attempts: int = 3, seed: int = 42, mode: str = "per_positive") -> DataFrame:
    """Corrupted edges (source, relation, target, label 0).

    Each positive makes ``attempts`` x ``per_positive`` draws: source or target
    (target only under relation_corrupt) becomes a word drawn from all words, from
    those of the corrupted end's part of speech (typed), or of the target's
    (relation_corrupt); an empty or unknown pool is that of all words. Draws that
    hit an edge, a self-loop or an earlier draw are dropped. ``per_positive`` keeps
    the first ``per_positive`` of each positive, ``global_cap`` as many in all as
    there are positives times ``per_positive``, first positives first.
    """
    pool, size = pools(words)
    dim = size.join(size.filter("pos = '*'").select(F.col("n").alias("all_n")))  # a row for each part of speech
    pos_of = pool.filter("pos <> '*'").select("word", "pos")
    key = ["source", "relation", "target"]
    p = positives.select(*key).distinct()
    d = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(attempts * per_positive - 1))))
    side = F.lit(1) if strategy == "relation_corrupt" else F.pmod(draw(seed, "source", "relation", "target", "k", F.lit("side")), F.lit(2)).cast("int")
    d = d.withColumn("side", side).withColumn("h", draw(seed, "source", "relation", "target", "k", F.lit("word")))
    end = F.when(F.col("side") == 1, F.col("target")).otherwise(F.col("source"))
    if strategy == "random":
        d = d.withColumn("want", F.lit("*"))
    else:
        d = d.withColumn("end", end).join(pos_of.select(F.col("word").alias("end"), F.col("pos").alias("want")), "end", "left").withColumn("want", F.when(F.coalesce("want", F.lit("unknown")) == "unknown", "*").otherwise(F.col("want")))
    d = d.join(bounded_broadcast(dim.select(F.col("pos").alias("want"), "n")), "want").withColumn("i", F.pmod("h", F.col("n")))
    d = d.join(pool.select(F.col("pos").alias("want"), F.col("i"), F.col("word").alias("new")), ["want", "i"])
    c = d.select(F.col("source").alias("ps"), F.col("target").alias("pt"), "k", "relation", F.when(F.col("side") == 0, F.col("new")).otherwise(F.col("source")).alias("source"), F.when(F.col("side") == 1, F.col("new")).otherwise(F.col("target")).alias("target"))
    c = c.filter("source <> target").join(p, key, "left_anti")
    c = c.groupBy(*key).agg(F.min(F.struct("ps", "pt", "k")).alias("o")).select(*key, "o.ps", "o.pt", "o.k")
    if mode == "per_positive":
        w = Window.partitionBy("ps", "relation", "pt").orderBy("k", "source", "target")
        c = c.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= per_positive)
    else:
        c = c.orderBy("ps", "relation", "pt", "k").limit(p.count() * per_positive)
    return c.select(*key, F.lit(0).alias("label"))


def stratified_split(edges: DataFrame, seed: int = 42, shares=(0.8, 0.1), by: str = "relation", key=("source", "relation", "target")) -> DataFrame:
    """Adds ``split``: per ``by``, in hashed order, the first int(.8 n) train, the next int(.1 n) val, the rest test."""
    e = numbered(edges.withColumn("_h", draw(seed, *key)), [by], ["_h", *key], "_i", "_n").drop("_h")
    a = F.floor(F.col("_n") * shares[0])
    b = a + F.floor(F.col("_n") * shares[1])
    return e.withColumn("split", F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "val").otherwise("test")).drop("_i", "_n")


def global_split(edges: DataFrame, seed: int = 42, share: float = 0.1, unit=("source", "relation", "target")) -> DataFrame:
    """Adds ``split`` by the rank of the unit's hash: test first, then val, the rest train; ``unit`` (source, target) keeps the relations of a pair together.

    The two border hashes are found by counting leading bits, so no task sorts or
    holds more than a few thousand of them.
    """
    u = edges.select(*unit).distinct().withColumn("_h", draw(seed, *unit))
    u = Scratch(edges.sparkSession).cut(u.select("_h"))
    n = u.count()
    k = max(1, int(share * n))
    a, b = smallest(u, "_h", k), smallest(u, "_h", min(2 * k, n)) if n else None
    h = draw(seed, *unit)
    return edges.withColumn("split", F.when(h <= F.lit(a), "test").when(h <= F.lit(b), "val").otherwise("train"))


def uniform_negatives(edges: DataFrame, words: DataFrame, n: int, split: str, seed: int = 42, taken: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """``n`` distinct (source, target) that are no edge, no self-loop and not in ``taken``: hashed draws in order, as many rounds as it takes.

    Where the words leave fewer than ``n`` such pairs to find within ``rounds``
    rounds (each twice as long as the one before), an error says so.
    """
    spark = words.sparkSession
    sc = Scratch(spark)
    pool, size = pools(words)
    pool = pool.filter("pos = '*'").select("i", "word")
    total = size.filter("pos = '*'").select(F.col("n").alias("total"))
    out_of = edges.select("source", "target")
    if taken is not None:
        out_of = out_of.unionByName(taken.select("source", "target"))
    out_of = sc.cut(out_of.distinct())
    have, start, step = None, 0, 2 * n + 16
    for _ in range(rounds):
        d = spark.range(start, start + step).join(F.broadcast(total)).select("id", F.pmod(draw(seed, F.lit(split), F.lit("s"), "id"), "total").alias("i"), F.pmod(draw(seed, F.lit(split), F.lit("t"), "id"), "total").alias("j"))
        d = d.join(pool.select("i", F.col("word").alias("source")), "i").join(pool.select(F.col("i").alias("j"), F.col("word").alias("target")), "j").filter("source <> target")
        d = d.select("source", "target", "id").join(out_of, ["source", "target"], "left_anti")
        d = d if have is None else d.unionByName(have)
        have = sc.cut(d.groupBy("source", "target").agg(F.min("id").alias("id")), "have")
        if have.count() >= n:
            return have.orderBy("id").limit(n).select("source", "target", F.lit(split).alias("split"))
        start, step = start + step, 2 * step
        if start > 1 << 40 or have.count() == 0 and start > 1 << 20:
            break
    raise ValueError(f"the words leave fewer than {n} pairs to draw")


def hard_negatives(edges: DataFrame, words: DataFrame, tries: int = 20, more_tries: int = 50, seed: int = 42) -> DataFrame:
    """(source, target, negative, valid): per pair a word that is no target of the source, and an exact search where no draw finds one.

    The first ``tries`` draws are from the target's part of speech, ``more_tries``
    from all words; five draws at first, and further ones only for pairs still
    open, so most pairs cost five. A pair still open then takes the first word in word
    order that is no target of its source. null and invalid where
    the source leads to every word there is.
    """
    sc = Scratch(edges.sparkSession)
    pool, size = pools(words)
    pos_of = pool.filter("pos <> '*'").select(F.col("word").alias("target"), "pos")
    pairs = sc.cut(edges.select("source", "target").distinct())
    d = pairs.join(pos_of, "target", "left").withColumn("pos", F.coalesce("pos", F.lit("*")))
    n_of = bounded_broadcast(size.select("pos", "n"))
    open_ = d.join(n_of, "pos").select("source", "target", F.when(F.col("n") <= 1, "*").otherwise(F.col("pos")).alias("pos"))
    open_ = sc.cut(open_, "open")
    known = pairs.select("source", F.col("target").alias("negative"))
    found = None
    for first, last in ((0, min(5, tries) - 1), (min(5, tries), tries - 1), (tries, tries + more_tries - 1)):
        if last < first:
            continue
        c = open_.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("want", F.when(F.col("k") < tries, F.col("pos")).otherwise("*"))
        c = c.join(n_of.select(F.col("pos").alias("want"), "n"), "want").withColumn("i", F.pmod(draw(seed, "source", "target", "k"), F.col("n")))
        c = c.join(pool.select(F.col("pos").alias("want"), "i", F.col("word").alias("negative")), ["want", "i"]).filter("negative <> target").select("source", "target", "k", "negative")
        ok = c.join(known, ["source", "negative"], "left_anti")
        ok = sc.cut(ok.groupBy("source", "target").agg(F.min_by("negative", "k").alias("negative")))
        found = ok if found is None else found.unionByName(ok)
        open_ = sc.cut(open_.join(ok.select("source", "target"), ["source", "target"], "left_anti"), "open")
        if open_.limit(1).count() == 0:
            break
    # exactly: of deg + 1 words at least one is no target of a source with deg targets
    of = open_.select("source").distinct()
    every = pool.filter("pos = '*'").select("i", F.col("word").alias("negative"))
    deg = known.join(of, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("deg"))
    c = deg.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deg"))).alias("i")).join(every, "i").join(known, ["source", "negative"], "left_anti")
    rest = open_.join(c.groupBy("source").agg(F.min_by("negative", "i").alias("negative")), "source").select("source", "target", "negative")
    best = rest if found is None else found.unionByName(rest)
    return pairs.join(best, ["source", "target"], "left").withColumn("valid", F.col("negative").isNotNull())


def custom_negatives(samples: DataFrame, edges: DataFrame, nodes: DataFrame, split: str) -> DataFrame:
    """Labelled 0 in ``split``, both ends known, no real edge."""
    v = nodes.select("word").distinct()
    s = samples.filter((F.col("split") == split) & (F.col("label") == 0)).select("source", "target").distinct()
    s = s.join(v.withColumnRenamed("word", "source"), "source", "left_semi").join(v.withColumnRenamed("word", "target"), "target", "left_semi")
    return s.join(edges.select("source", "target"), ["source", "target"], "left_anti")
