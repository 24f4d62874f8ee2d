"""Evaluation metrics as aggregations and windows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from .ranks import running_sums


def threshold_table(scored: DataFrame) -> DataFrame:
    """(score, tp, fp, n_pos, n_neg, p, n) at each distinct score, counting rows scored at least so.

    ``scored``: score, label (0/1); null and NaN scores or labels are left out.
    """
    s = scored.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isin(0, 1))
    g = s.groupBy("score").agg(F.sum("label").alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    t = running_sums(g, F.desc("score"), {"tp": "p", "fp": "n"})
    return t.select("score", "tp", "fp", F.col("tp_all").alias("n_pos"), F.col("fp_all").alias("n_neg"), "p", "n")


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve with ties counted half; null where one class is missing."""
    t = threshold_table(scored)
    return t.agg(F.round(F.try_divide(F.sum((F.col("tp") - F.col("p") / 2) * F.col("n")), F.max("n_pos") * F.max("n_neg")), 6).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    t = threshold_table(scored)
    return t.agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("n_pos")), 6).alias("ap"))


def best_f1_threshold(scored: DataFrame) -> DataFrame:
    """The lowest threshold with the highest F1 (rounded to 9 places)."""
    t = threshold_table(scored)
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")), 9)
    return t.select("score", f1.alias("f1")).orderBy(F.desc("f1"), "score").limit(1).select(F.col("score").alias("threshold"), "f1")


def scores_at(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall and F1 of score >= threshold; 0 where undefined."""
    s = scored.filter(F.col("score").isNotNull() & F.col("label").isin(0, 1))
    tp, fp, fn = (F.count_if(c).alias(n) for c, n in (((F.col("score") >= threshold) & (F.col("label") == 1), "tp"), ((F.col("score") >= threshold) & (F.col("label") == 0), "fp"), ((F.col("score") < threshold) & (F.col("label") == 1), "fn")))
    z = s.agg(tp, fp, fn)
    part = lambda a, b, n: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6).alias(n)
    return z.select(part(F.col("tp"), F.col("tp") + F.col("fp"), "precision"), part(F.col("tp"), F.col("tp") + F.col("fn"), "recall"), part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), "f1"))


def clustering_agreement(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic) of columns ``label`` and ``cluster``."""
    c = labels.filter(F.col("label").isNotNull() & F.col("cluster").isNotNull()).groupBy("label", "cluster").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = c.groupBy("label").agg(F.sum("n").alias("a"))
    b = c.groupBy("cluster").agg(F.sum("n").alias("b"))
    pairs = lambda x: x * (x - 1) / 2
    x = c.agg(F.sum("n").alias("N"), F.sum(pairs(F.col("n"))).alias("ij"), F.sum(F.col("n") * F.log("n")).alias("hij"))
    y = a.agg(F.sum(pairs(F.col("a"))).alias("ai"), F.sum(F.col("a") * F.log("a")).alias("ha"))
    z = b.agg(F.sum(pairs(F.col("b"))).alias("bj"), F.sum(F.col("b") * F.log("b")).alias("hb"))
    t = x.crossJoin(y).crossJoin(z)  # one row each
    n = F.col("N")
    e = F.try_divide(F.col("ai") * F.col("bj"), pairs(n))
    ari = F.coalesce(F.try_divide(F.col("ij") - e, (F.col("ai") + F.col("bj")) / 2 - e), F.lit(1.0))
    hu, hv = F.log(n) - F.col("ha") / n, F.log(n) - F.col("hb") / n
    mi = (F.col("hij") - F.col("ha") - F.col("hb")) / n + F.log(n)
    return t.filter("N > 0").select(F.round(ari, 6).alias("ari"), F.round(F.coalesce(F.try_divide(mi, (hu + hv) / 2), F.lit(1.0)), 6).alias("nmi"))


def long_metrics(results: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Wide results to (keys, metric, value)."""
    return results.unpivot(keys, metrics, "metric", "value")


def summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and number of seeds per key and metric; NaN is no value."""
    v = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return v.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.count(F.lit(1)).alias("n_seeds"))


def pivot_summary(s: DataFrame, metrics: list[str], row: str = "model") -> DataFrame:
    return s.groupBy(row).pivot("metric", metrics).agg(F.first("mean"))


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile by bisection on the regularised incomplete beta function."""

    def cdf(t: float) -> float:
        x = df / (df + t * t)
        return 1 - 0.5 * _betainc(df / 2, 0.5, x)

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-30)
        c = 1 + num / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_intervals(long: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """mean -+ t * s / sqrt(n) per key and metric; one value gives the value itself, a group whose values are all missing NaN with n_seeds 0."""
    good = F.col("value").isNotNull() & ~F.isnan("value")
    value = F.when(good, F.col("value"))
    v = long.groupBy(*keys, "metric").agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n_seeds"))

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        at = {k: t_quantile((1 + level) / 2, int(k) - 1) for k in n.unique() if k > 1}
        return n.map(lambda k: at.get(k, 0.0))

    half = F.coalesce(quantile("n_seeds") * F.col("s") / F.sqrt("n_seeds"), F.lit(0.0))
    nan = lambda c: F.round(F.coalesce(c, F.lit(float("nan"))), 6)
    return v.select(*keys, "metric", "n_seeds", nan(F.col("m")).alias("mean"), nan(F.col("m") - half).alias("ci_low"), nan(F.col("m") + half).alias("ci_high"))


def intervals(long: DataFrame, keys: list[str], method: str = "bca", resamples: int = 9_999, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, metric, mean, ci_low, ci_high, n_seeds, ci_level, method): ``method`` is bca, percentile or t; a group without a value has NaN and n_seeds 0."""
    t = t_intervals(long, keys, level)
    if method != "t":
        s = t.select(*keys, "metric", "n_seeds", "mean")
        c = (bca_intervals if method == "bca" else percentile_intervals)(long, keys, resamples, level, seed).select(*[F.col(k).alias(f"_{k}") for k in (*keys, "metric")], "ci_low", "ci_high")
        meet = F.lit(True)
        for k in (*keys, "metric"):
            meet = meet & (F.coalesce(F.col(k), F.lit("")) == F.coalesce(F.col(f"_{k}"), F.lit("")))
        nan = F.lit(float("nan"))
        t = s.join(c, meet, "left").select(*keys, "metric", "n_seeds", "mean", F.coalesce("ci_low", nan).alias("ci_low"), F.coalesce("ci_high", nan).alias("ci_high"))
    return t.select(*keys, "metric", "mean", "ci_low", "ci_high", "n_seeds", F.lit(level).alias("ci_level"), F.lit(method).alias("method"))


def bootstrap_means(long: DataFrame, keys: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """(keys, metric, b, boot): means of hashed resamples; the values of a group are numbered by value."""
    k = [*keys, "metric"]
    v = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy(*k)
    v = v.withColumn("i", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    draws = v.select(*k, "i", "n").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("j", F.pmod(draw(seed, *[F.coalesce(F.col(c), F.lit("")) for c in k], "b", "i"), F.col("n")))
    src = v.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("i").alias("_j"), "value")
    d = draws.join(src, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in k], F.col("j") == F.col("_j")])
    return d.groupBy(*k, "b").agg(F.avg("value").alias("boot"))


def percentile_intervals(long: DataFrame, keys: list[str], resamples: int = 9_999, level: float = 0.95, seed: int = 0) -> DataFrame:
    b = bootstrap_means(long, keys, resamples, seed)
    q = F.percentile("boot", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return b.groupBy(*keys, "metric").agg(q.alias("q")).select(*keys, "metric", F.round(F.col("q")[0], 6).alias("ci_low"), F.round(F.col("q")[1], 6).alias("ci_high"))


def bca_intervals(long: DataFrame, keys: list[str], resamples: int = 9_999, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Bias-corrected and accelerated bootstrap intervals; one value gives the value itself."""
    k = [*keys, "metric"]
    v = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).na.fill("", k)
    s = v.groupBy(*k).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"))
    j = v.join(s, k).select(*k, F.when(F.col("n") > 1, (F.col("sum") - F.col("value")) / (F.col("n") - 1)).alias("jack"))
    d = j.join(j.groupBy(*k).agg(F.avg("jack").alias("jm")), k).select(*k, (F.col("jm") - F.col("jack")).alias("d"))
    acc = d.groupBy(*k).agg(F.coalesce(F.try_divide(F.sum(F.pow("d", F.lit(3))), 6 * F.pow(F.sum(F.col("d") * F.col("d")), F.lit(1.5))), F.lit(0.0)).alias("a"))
    b = bootstrap_means(v, keys, resamples, seed)
    bs = b.join(s, k).groupBy(*k).agg((F.count_if(F.col("boot") < F.col("m")) / F.count(F.lit(1))).alias("below"), F.sort_array(F.collect_list("boot")).alias("boots"))  # ``resamples`` values
    z = NormalDist()
    lo, hi = z.inv_cdf((1 - level) / 2), z.inv_cdf((1 + level) / 2)

    @F.pandas_udf("double")
    def ppf(p):
        return p.clip(1e-6, 1 - 1e-6).map(NormalDist().inv_cdf)

    @F.pandas_udf("double")
    def cdf(x):
        return x.map(NormalDist().cdf)

    r = s.join(acc, k).join(bs, k).select(*k, "m", "n", "a", "below", "boots").withColumn("z0", ppf("below"))
    out = r
    for name, q in (("ci_low", lo), ("ci_high", hi)):
        p = cdf(F.col("z0") + (F.col("z0") + q) / (1 - F.col("a") * (F.col("z0") + q)))
        out = out.withColumn("_p", p).withColumn("_at", F.col("_p") * (resamples - 1)).withColumn("_i", F.floor("_at").cast("int"))
        left, right = F.get("boots", F.col("_i")), F.get("boots", F.least(F.col("_i") + 1, F.lit(resamples - 1)))
        out = out.withColumn(name, F.when(F.col("n") > 1, left + (right - left) * (F.col("_at") - F.col("_i"))).otherwise(F.col("m")))
    return out.select(*k, F.round("m", 6).alias("mean"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), F.col("n").alias("n_seeds"))


def best_aux(s: DataFrame, a: str, b: str) -> DataFrame:
    """The model with the greater mean ARI of two; ``b`` on ties."""
    return s.filter(F.col("metric") == "ari").filter(F.col("model").isin(a, b)).agg(F.max_by("model", F.struct("mean", (F.col("model") == b).alias("tie"))).alias("model"))
