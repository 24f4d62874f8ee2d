"""Derivation rules as relational plans over all words at once.

Affix tests are equi-joins: every ending (or beginning) of a word is exploded as
a key and joined with the broadcast rule table. Candidate bases are exploded with
a priority and met with the known words by a hash join; where the first hit
counts, the best priority is kept by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..scratch import Scratch

EDGE = ["source", "source_pos", "relation", "relation_class", "target", "target_pos"]
MIN_ROOT = 2


def _table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A rule table; at most a few hundred rows, fixed by this package."""
    return F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema))


def _strs(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


class Lexicon:
    """Words with their part of speech, and what counts as known."""

    def __init__(self, words: DataFrame):
        self.spark, self.cut = words.sparkSession, False
        self.words = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.coalesce(F.min(F.when(F.col("pos") != "unknown", F.col("pos"))), F.lit("unknown")).alias("pos"))
        roots = self.spark.createDataFrame([(w,) for w in rules.ROOTS], "word string")
        both = self.words.unionByName(roots.join(self.words, "word", "left_anti").withColumn("pos", F.lit("unknown")))
        out = [*rules.AFFIXES, *rules.BORROWINGS.split()]
        self.known = both.filter((F.length("word") >= MIN_ROOT) & ~F.col("word").isin(out))
        self.known_compound = self.known.filter((F.col("pos") != "unknown") | F.col("word").isin(rules.ROOTS))

    def written(self, sc: Scratch) -> Lexicon:
        """The same with its tables written once, for plans that meet them many times."""
        if not self.cut:
            self.words, self.known, self.known_compound = sc.cut(self.words), sc.cut(self.known), sc.cut(self.known_compound)
            self.cut = True
        return self

    def hits(self, cands: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Candidates (column ``base``) that are known, with their part of speech as ``base_pos``."""
        k = (self.known if known is None else known).select(F.col("word").alias("base"), F.col("pos").alias("base_pos"))
        return cands.join(k, "base")

    def variants(self, df: DataFrame, stem: str, out: str = "base", order: str = "v") -> DataFrame:
        """Explodes ``stem`` to itself (0) and its other root forms (1, 2, ...)."""
        dim: dict[str, list] = {}
        for s, v, i in rules.root_variants():
            dim.setdefault(s, []).append((i, v))
        t = _table(self.spark, [(s, [(0, s), *vs]) for s, vs in dim.items()], "_stem string, _vs array<struct<i: int, w: string>>")
        x = df.join(t, F.col(stem) == F.col("_stem"), "left")
        own = F.array(F.struct(F.lit(0).alias("i"), F.col(stem).alias("w")))
        return x.withColumn("_x", F.explode(F.coalesce("_vs", own))).withColumn(out, F.col("_x.w")).withColumn(order, F.col("_x.i")).drop("_stem", "_vs", "_x")


def with_endings(words: DataFrame, endings: DataFrame, least_stem: int = MIN_ROOT + 1) -> DataFrame:
    """(word, pos, stem) x the ending rows (column ``suffix``) the word ends with, its stem having ``least_stem`` letters or more."""
    longest = max(len(s) for s in (*rules.SUFFIXES, *rules.DENOMINAL_VERB_ENDINGS.split(), *rules.DIMINUTIVE_ENDINGS.split()))
    n = F.length("word")
    keys = words.filter(n > least_stem).withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - least_stem))))
    return keys.withColumn("suffix", F.expr("right(word, _n)")).withColumn("stem", F.expr("left(word, length(word) - _n)")).drop("_n").join(endings, "suffix")


def _first(hits: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """The hit of each word with the smallest ``order``."""
    return hits.groupBy("word", "pos").agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_k")).select("word", "pos", *[F.col(f"_k.{c}").alias(c) for c in keep])


def _classes() -> Column:
    m = F.create_map(*[F.lit(x) for pair in rules.BUILDER_CLASS for x in pair])
    return F.coalesce(F.try_element_at(m, F.col("relation")), F.lit("other"))


def edges_of(hits: DataFrame, relation: str | Column, target_pos: Column | str = "pos", source_pos: Column | str = "base_pos") -> DataFrame:
    rel = F.lit(relation) if isinstance(relation, str) else relation
    col = lambda c: F.col(c) if isinstance(c, str) else c
    e = hits.select(F.trim("base").alias("source"), col(source_pos).alias("source_pos"), rel.alias("relation"), F.trim("word").alias("target"), col(target_pos).alias("target_pos"))
    return e.withColumn("relation_class", _classes()).select(*EDGE)


def reduplication(words: DataFrame, lex: Lexicon) -> DataFrame:
    """x-x with x known."""
    w = words.withColumn("base", F.substring_index("word", "-", 1)).filter(F.col("word") == F.concat("base", F.lit("-"), "base"))
    return edges_of(lex.hits(w), "reduplication")


def place_person(words: DataFrame, lex: Lexicon) -> DataFrame:
    """Place to person; the first ending, in table order, with a known stem."""
    t = _table(lex.spark, [(i, s) for i, s in enumerate(rules.DEMONYM_ENDINGS.split())], "ord int, suffix string")
    h = lex.hits(with_endings(words, t).withColumn("base", F.col("stem")))
    return edges_of(_first(h, ["ord"], ["base", "base_pos"]), "demonym_suffix")


def diminutive(words: DataFrame, lex: Lexicon) -> DataFrame:
    """Per ending the first known form of the stem (without a final ն); the longest of them."""
    t = _table(lex.spark, [(i, s) for i, s in enumerate(rules.DIMINUTIVE_ENDINGS.split())], "ord int, suffix string")
    c = with_endings(words, t).withColumn("s", F.regexp_replace("stem", "ն$", ""))
    h = lex.hits(lex.variants(c, "s"))
    per = h.groupBy("word", "pos", "ord").agg(F.min_by(F.struct("base", "base_pos"), "v").alias("k")).select("word", "pos", "ord", "k.*").withColumn("short", -F.length("base"))
    return edges_of(_first(per, ["short", "ord"], ["base", "base_pos"]), "diminutive")


def _verbs(words: DataFrame) -> DataFrame:
    return words.filter(F.col("pos").isin("verb", "unknown", ""))


def _endings(df: DataFrame, stem: str, text: str) -> DataFrame:
    """``stem`` + each ending, in order, as ``base`` and ``e``."""
    return df.select("*", F.posexplode(_strs(text.split())).alias("e", "_end")).withColumn("base", F.concat(stem, "_end")).drop("_end")


def detransitive(words: DataFrame, lex: Lexicon) -> DataFrame:
    w = _verbs(words).filter(F.col("word").endswith("վել")).withColumn("stem", F.expr("left(word, length(word) - 3)"))
    h = lex.hits(_endings(lex.variants(w, "stem", "form"), "form", rules.VERB_ENDINGS)).filter("base_pos = 'verb'")
    return edges_of(_first(h, ["e", "v"], ["base", "base_pos"]), "detransitive", F.lit("verb"))


def causative(words: DataFrame, lex: Lexicon) -> DataFrame:
    rows = [(i, r[0], j, e) for i, r in enumerate(rules.entries(rules.CAUSATIVES)) for j, e in enumerate(r[1:])]
    w = with_endings(_verbs(words), _table(lex.spark, rows, "ord int, suffix string, e int, ending string"), 0)
    bridge = [F.when(F.col("stem").endswith(v), F.expr("left(stem, length(stem) - 1)")) for v in rules.BRIDGE_VOWELS.split()]
    w = w.select("*", F.posexplode(F.array("stem", *bridge)).alias("b", "s")).filter(F.col("s").isNotNull()).withColumn("base", F.concat("s", "ending"))
    return edges_of(_first(lex.hits(w).filter("base_pos = 'verb'"), ["ord", "e", "b"], ["base", "base_pos"]), "causative", F.lit("verb"))


def nominalization(words: DataFrame, lex: Lexicon) -> DataFrame:
    rows = [(i, r[0], j, e) for i, r in enumerate(rules.entries(rules.NOMINALIZATIONS)) for j, e in enumerate(r[1:])]
    w = with_endings(words, _table(lex.spark, rows, "ord int, suffix string, e int, ending string")).withColumn("base", F.concat("stem", "ending"))
    return edges_of(_first(lex.hits(w).filter("base_pos = 'verb'"), ["ord", "e"], ["base", "base_pos"]), "nominalization")


def verb_to_noun(words: DataFrame, lex: Lexicon) -> DataFrame:
    """Noun under a verb: the stem, the stem without a bridge vowel, the stem with ց, a noun one form of which is the stem (the first by word)."""
    t = _table(lex.spark, [(i, s) for i, s in enumerate(rules.DENOMINAL_VERB_ENDINGS.split())], "ord int, suffix string")
    w = with_endings(words.filter("pos = 'verb'"), t)
    bridge = [F.when(F.col("stem").endswith(v), F.expr("left(stem, length(stem) - 1)")) for v in rules.BRIDGE_VOWELS.split()]
    c = w.select("word", "pos", "ord", "stem", F.posexplode(F.array("stem", *bridge, F.concat("stem", F.lit("ց")))).alias("way", "base")).filter(F.col("base").isNotNull())
    direct = lex.hits(c).filter("base_pos = 'noun'").select("word", "pos", "ord", "way", "base", "base_pos")
    forms = lex.variants(lex.words.filter("pos = 'noun'").select(F.col("word").alias("noun")), "noun", "stem").select("stem", F.col("noun").alias("base"))
    back = w.join(forms, "stem").select("word", "pos", "ord", F.lit(9).alias("way"), "base", F.lit("noun").alias("base_pos"))
    return edges_of(_first(direct.unionByName(back), ["ord", "way", "base"], ["base", "base_pos"]), "derives_noun")


def suffixation(words: DataFrame, lex: Lexicon) -> DataFrame:
    """All typed derivations by suffix; several edges a word, one for each (base, relation)."""
    t = _table(lex.spark, [(s,) for s in rules.SUFFIXES], "suffix string")
    w = with_endings(words, t)
    bridge = [F.when(F.col("stem").endswith(v) & (F.length("stem") > MIN_ROOT + 1), F.expr("left(stem, length(stem) - 1)")) for v in rules.BRIDGE_VOWELS.split()]
    stems = lex.variants(w, "stem", "s").select("word", "pos", "suffix", "s").unionByName(w.select("word", "pos", "suffix", F.coalesce(*bridge).alias("s")).filter(F.col("s").isNotNull()))
    c = stems.select("word", "pos", "suffix", F.explode(F.array("s", *[F.concat("s", F.lit(v)) for v in rules.VERB_ENDINGS.split()])).alias("base")).distinct()
    h = lex.hits(c)
    typed = _table(lex.spark, rules.SUFFIX_TABLE, "ord int, suffix string, src string, tgt string, kind string")
    fits = h.join(typed, "suffix").filter((F.col("src") == F.col("base_pos")) | (F.col("base_pos") == "unknown"))
    fits = fits.select("word", "pos", "base", "base_pos", "suffix", "ord", F.concat("kind", F.lit("_suffixation")).alias("relation"), "tgt")
    pairs = F.broadcast(lex.spark.createDataFrame([(r[1], r[2]) for r in rules.SUFFIX_TABLE], "suffix string, base_pos string").distinct())
    rest = h.filter("base_pos <> 'unknown'").join(pairs, ["suffix", "base_pos"], "left_anti").select("word", "pos", "base", "base_pos", "suffix", F.lit(-1).alias("ord"), F.lit("suffixation").alias("relation"), F.col("pos").alias("tgt"))
    best = fits.unionByName(rest).groupBy("word", "pos", "base", "base_pos", "relation").agg(F.min_by("tgt", F.struct(F.length("suffix"), "suffix", "ord")).alias("tgt"))
    return edges_of(best, F.col("relation"), "tgt")


def prefixation(words: DataFrame, lex: Lexicon) -> DataFrame:
    """The longest prefix that leaves a known word; the rest as it is, without a bridge vowel, in another form."""
    t = _table(lex.spark, rules.PREFIX_TABLE, "ord int, prefix string, rel string")
    n = F.length("word")
    k = words.filter(n > MIN_ROOT + 1).withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(map(len, rules.PREFIXES))), n - MIN_ROOT - 1))))
    w = k.withColumn("prefix", F.expr("left(word, _n)")).withColumn("stem", F.expr("substring(word, _n + 1)")).drop("_n").join(t, "prefix").withColumn("short", -F.length("prefix"))
    forms = lex.variants(w, "stem").withColumn("v", F.when(F.col("v") == 0, 0).otherwise(F.col("v") + 10))
    bare = w.select("*", F.posexplode(F.array(*[F.when(F.col("stem").startswith(v), F.expr("substring(stem, 2)")) for v in rules.BRIDGE_VOWELS.split()])).alias("v", "base")).filter(F.col("base").isNotNull()).withColumn("v", F.col("v") + 1)
    h = lex.hits(forms.unionByName(bare))
    return edges_of(_first(h, ["short", "ord", "v"], ["base", "base_pos", "rel"]), F.col("rel"))


def _anchored(surface: str, cand: str) -> Column:
    s, c = F.col(surface), F.col(cand)
    return (s == c) | ((F.length(c) >= 3) & (F.length(c) >= F.length(s) - 1) & s.startswith(F.expr(f"left({cand}, length({cand}) - 1)")))


def compound(words: DataFrame, lex: Lexicon) -> DataFrame:
    """Two known parts, with a bridge vowel first, then joined bare; the longest first part wins; two edges."""
    n = F.length("word")
    w = words.filter(n >= 6)
    at = w.withColumn("i", F.explode(F.sequence(F.lit(3), n - 3)))
    p1, rest = F.expr("left(word, i)"), F.expr("substring(word, i + 1)")
    splits = at.select("word", "pos", "i", p1.alias("s1"), rest.alias("r"))
    ways = [F.struct(F.lit(0).alias("mode"), F.lit(j).alias("vowel"), F.when(F.col("r").startswith(v) & (F.length("r") >= 4), F.expr("substring(r, 2)")).alias("s2")) for j, v in enumerate(rules.BRIDGE_VOWELS.split())]
    ways.append(F.struct(F.lit(1).alias("mode"), F.lit(0).alias("vowel"), F.col("r").alias("s2")))
    c = splits.select("word", "pos", "i", "s1", F.explode(F.array(*ways)).alias("x")).select("word", "pos", "i", "s1", "x.mode", "x.vowel", "x.s2")
    c = c.filter(F.col("s2").isNotNull() & (F.length("s2") >= 3) & ~F.col("s2").isin(rules.SUFFIXES))
    k = lex.known_compound
    a = lex.variants(c, "s1", "b1", "v1").filter(_anchored("s1", "b1")).join(k.select(F.col("word").alias("b1"), F.col("pos").alias("pos1")), "b1")
    b = lex.variants(a, "s2", "b2", "v2").filter(_anchored("s2", "b2")).join(k.select(F.col("word").alias("b2"), F.col("pos").alias("pos2")), "b2")
    best = _first(b.withColumn("short", -F.col("i")), ["mode", "short", "vowel", "v1", "v2"], ["b1", "pos1", "b2", "pos2"])
    kind = F.when(F.col("b2").isin(rules.VERB_ROOTS.split()) | (F.col("pos2") == "verb"), "synthetic_compound").when((F.col("pos1") == "adjective") | (F.col("pos2") == "adjective"), "adjective_compound").otherwise("root_compound")
    two = best.withColumn("kind", kind).select("word", "pos", "kind", F.explode(F.array(F.struct(F.col("b1").alias("base"), F.col("pos1").alias("base_pos")), F.struct(F.col("b2").alias("base"), F.col("pos2").alias("base_pos")))).alias("x"))
    return edges_of(two.select("word", "pos", "kind", "x.base", "x.base_pos"), F.col("kind")).distinct()


RULES = (reduplication, place_person, diminutive, detransitive, causative, nominalization, verb_to_noun, suffixation, prefixation)


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, relation, target): the smallest of the other columns together."""
    rest = [c for c in EDGE if c not in ("source", "relation", "target")]
    return edges.groupBy("source", "relation", "target").agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in EDGE])


def analyze(words: DataFrame, lex: Lexicon) -> DataFrame:
    """All edges of all words: every rule, and compounds for words that no suffix rule has explained. Borrowings give none."""
    sc = Scratch(words.sparkSession)
    lex = lex.written(sc)
    w = sc.cut(words.filter(F.col("word").isNotNull() & ~F.col("word").isin(rules.BORROWINGS.split())).select("word", F.coalesce("pos", F.lit("unknown")).alias("pos")).distinct())
    simple = None
    for r in RULES:
        e = r(w, lex)
        simple = e if simple is None else simple.unionByName(e)
    simple = sc.cut(simple)
    blocks = F.col("relation").endswith("_suffixation") | F.col("relation").isin("nominalization", "causative", "detransitive")
    left = w.join(simple.filter(blocks).select(F.col("target").alias("word")).distinct(), "word", "left_anti")
    return unique_edges(simple.unionByName(compound(left, lex)))


def inverse_edges(edges: DataFrame) -> DataFrame:
    """The edge from derived word back to base, for relations that have an inverse."""
    t = _table(edges.sparkSession, rules.INVERSE_TABLE, "relation string, inv string")
    e = edges.join(t, "relation").select(F.col("target").alias("source"), F.col("target_pos").alias("source_pos"), F.col("inv").alias("relation"), F.col("source").alias("target"), F.col("source_pos").alias("target_pos"))
    m = F.create_map(*[F.lit(x) for pair in rules.BUILDER_CLASS for x in pair])
    return e.withColumn("relation_class", F.coalesce(F.try_element_at(m, F.col("relation")), F.lit("inverse_derivation"))).select(*EDGE)


def reanalysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, with their inverses, that the full dictionary gives and ``edges`` lacks."""
    new = analyze(nodes.select("word", "pos"), Lexicon(nodes))
    both = unique_edges(new.unionByName(inverse_edges(new)))
    return both.join(edges.select("source", "relation", "target").distinct(), ["source", "relation", "target"], "left_anti").select(*EDGE)


def seeded(words: DataFrame) -> DataFrame:
    """(word, pos) with the seed words added; what is there already wins."""
    s = words.sparkSession.createDataFrame(rules.SEEDS, "word string, pos string")
    w = words.select("word", "pos")
    return w.unionByName(s.join(w.select("word"), "word", "left_anti"))


__all__ = ["EDGE", "Lexicon", "RULES", "Window", "analyze", "inverse_edges", "reanalysis", "seeded", "unique_edges"]
