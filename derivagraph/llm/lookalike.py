"""Texts that look equal brought to one plain spelling, as a dataflow over code points.

Each text is exploded to positioned code points; broadcast dimension tables
decompose them (and drop what is invisible) and, once the main script of the
text is known, replace look-alike letters; combining marks are put in the order
of their class, recomposed with their base, and the strings rebuilt. The tables
are fixed by Unicode (a few thousand rows), so broadcasting them is bounded.
Exploded rows carry a 128-bit key of their text, not the text itself.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spelling import ECH_YIWN, EW, HYPHENS, LOOK_ALIKES, SCRIPT_ORDER, SCRIPT_RANGES, is_invisible, known_plain


@cache
def _decompositions() -> list[tuple[str, list[str]]]:
    """Code point -> its parts, for all that do not stand for themselves (none: invisible)."""
    out = []
    for o in range(sys.maxunicode + 1):
        if 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xDFFF:  # Hangul syllables decompose and recompose to themselves
            continue
        ch = chr(o)
        if is_invisible(ch):
            parts = []
        else:
            d = "-" if ch in HYPHENS else unicodedata.normalize("NFKD", ch)
            parts = ["-" if c in HYPHENS else c for c in d if not is_invisible(c)]
        if parts != [ch]:
            out.append((ch, parts))
    return out


@cache
def _mark_classes() -> list[tuple[str, int]]:
    return [(chr(o), unicodedata.combining(chr(o))) for o in range(sys.maxunicode + 1) if unicodedata.combining(chr(o))]


@cache
def _compositions() -> list[tuple[str, str]]:
    """base + mark -> composed letter."""
    out = []
    for o in range(0x00C0, 0x10000):
        ch = chr(o)
        if 0xAC00 <= o <= 0xD7A3:
            continue
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and " " in d:
            pair = "".join(chr(int(x, 16)) for x in d.split())
            if unicodedata.normalize("NFC", pair) == ch:
                out.append((pair, ch))
    return out


def _script(col):
    o = F.ascii(col)
    out = F.lit(None).cast("string")
    for name in SCRIPT_ORDER[::-1]:
        hit = F.lit(False)
        for n, a, b in SCRIPT_RANGES:
            if n == name:
                hit = hit | o.between(a, b)
        out = F.when(hit, name).otherwise(out)
    return out


def _dimensions(spark: SparkSession):
    decomposed = spark.createDataFrame(_decompositions(), "ch string, parts array<string>")
    marks = spark.createDataFrame(_mark_classes(), "c string, ccc int")
    alike = spark.createDataFrame([(a, s, b) for (a, s), b in LOOK_ALIKES.items()], "c string, main string, same string")
    return F.broadcast(decomposed), F.broadcast(marks), F.broadcast(alike)


def _compose(run):
    """One base and its ordered marks to the composed string (the canonical composition, marks of class above 0)."""
    table = F.map_from_arrays(F.lit([p for p, _ in _compositions()]), F.lit([c for _, c in _compositions()]))
    start = F.struct(run[0]["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc, m):
        made = F.when((acc["last"] == 0) | (acc["last"] < m["ccc"]), F.element_at(table, F.concat(acc["base"], m["c"])))
        return F.struct(
            F.coalesce(made, acc["base"]).alias("base"), F.when(made.isNull(), F.concat(acc["rest"], m["c"])).otherwise(acc["rest"]).alias("rest"), F.when(made.isNull(), m["ccc"]).otherwise(acc["last"]).alias("last")
        )

    return F.aggregate(F.slice(run, 2, F.size(run)), start, step, lambda a: F.concat(a["base"], a["rest"]))


def needs_work(col="written"):
    """Not known to be plain by its form alone (the form is a fixed point of the whole procedure)."""
    return ~known_plain(F.col(col))


def plain_forms(texts: DataFrame) -> DataFrame:
    """``written`` to distinct (written, plain).

    Null is left out, '' stays '', a text of invisible characters alone becomes
    ''; texts of any length pass whole; repeated texts come out once; an empty
    table gives an empty result; other columns are ignored. Scripts with equally
    many letters rank armenian, latin, cyrillic, greek; a foreign letter without
    a twin in the main script stays.
    """
    spark = texts.sparkSession
    decomposed, marks, alike = _dimensions(spark)
    t = texts.select("written").filter(F.col("written").isNotNull())
    done = t.filter(~needs_work()).distinct().select("written", F.col("written").alias("plain"))
    t = t.filter(needs_work()).distinct()
    t = t.select("written", F.xxhash64("written").alias("k1"), F.xxhash64(F.lit("k"), F.reverse("written")).alias("k2"), F.split("written", "").alias("chars"))
    x = t.select("k1", "k2", "written", F.posexplode_outer("chars").alias("pos", "ch"))
    x = x.select("k1", "k2", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("written")).alias("whole"), F.coalesce("pos", F.lit(0)).alias("pos"), "ch")
    x = x.join(decomposed, "ch", "left").select("k1", "k2", "whole", "pos", F.posexplode_outer(F.coalesce("parts", F.array("ch"))).alias("sub", "c"))
    x = x.join(marks, "c", "left").select("k1", "k2", "whole", "pos", "sub", "c", F.coalesce("ccc", F.lit(0)).alias("ccc"), _script(F.col("c")).alias("script"))
    cp = F.struct("pos", "sub", "c", "ccc", "script")
    counts = [F.count_if(F.col("script") == s).alias(f"n_{s}") for s in SCRIPT_ORDER]
    g = x.groupBy("k1", "k2").agg(F.max("whole").alias("written"), F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), cp))).alias("cps"), *counts)
    most = F.greatest(*[F.col(f"n_{s}") for s in SCRIPT_ORDER])
    main = F.coalesce(*[F.when((F.col(f"n_{s}") == most) & (most > 0), F.lit(s)) for s in SCRIPT_ORDER])
    g = g.withColumn("main", main)
    # second pass, on the same partitioning: look-alikes of the main script
    y = g.select("k1", "k2", "written", "main", F.posexplode_outer("cps").alias("at", "x"))
    y = y.select("k1", "k2", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("written")).alias("written"), "at", F.col("x.c").alias("c"), F.col("x.ccc").alias("ccc"), F.when(F.col("x.script") != F.col("main"), F.col("main")).alias("main"))
    y = y.join(alike, ["c", "main"], "left").select("k1", "k2", "written", "at", F.coalesce("same", "c").alias("c"), "ccc")
    r = y.groupBy("k1", "k2").agg(F.max("written").alias("written"), F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("at", "c", "ccc")))).alias("cps"))
    has_marks = F.exists("cps", lambda z: z["ccc"] > 0)
    simple = F.array_join(F.transform("cps", lambda z: z["c"]), "")
    # runs of one base with its marks; the marks in the order of their class, then of their place
    starts = F.filter(F.transform("cps", lambda z, i: F.when((z["ccc"] == 0) | (i == 0), i)), lambda i: i.isNotNull())
    runs = F.transform(
        starts,
        lambda s, j: F.slice(F.col("cps"), s + 1, F.coalesce(F.get(starts, j + 1), F.size("cps")) - s),
    )
    ordered = F.transform(runs, lambda run: F.concat(F.slice(run, 1, 1), F.transform(F.array_sort(F.transform(F.slice(run, 2, F.size(run)), lambda z, i: F.struct(z["ccc"].alias("ccc"), i.alias("i"), z["c"].alias("c")))), lambda z: F.struct(F.lit(0).alias("at"), z["c"].alias("c"), z["ccc"].alias("ccc")))))
    composed = F.array_join(F.transform(ordered, lambda run: F.when(F.size(run) == 1, run[0]["c"]).otherwise(_compose(run))), "")
    plain = F.when(has_marks, composed).otherwise(simple)
    plain = F.replace(F.trim(F.regexp_replace(plain, r"[\s\p{Z}]+", " ")), F.lit(ECH_YIWN), F.lit(EW))
    return r.select("written", plain.alias("plain")).unionByName(done)


def field_strings(*fields: tuple[DataFrame, str]) -> DataFrame:
    """``written``: the non-empty strings of (table, column) pairs."""
    out = None
    for df, c in fields:
        one = df.select(F.col(c).alias("written")).filter(F.col(c).isNotNull() & (F.col(c) != ""))
        out = one if out is None else out.union(one)
    return out


def not_plain(texts: DataFrame) -> DataFrame:
    """(written, plain) of the texts that are not in plain spelling; the known-plain form is left out before any shuffle."""
    return plain_forms(texts.filter(needs_work())).filter(F.col("written") != F.col("plain"))


def variant_groups(texts: DataFrame) -> DataFrame:
    """Per plain spelling written in more than one way: how many ways and how often in all."""
    n = texts.groupBy("written").agg(F.count(F.lit(1)).alias("n"))
    return n.join(plain_forms(texts), "written").groupBy("plain").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_rows")).filter("n_forms > 1")
