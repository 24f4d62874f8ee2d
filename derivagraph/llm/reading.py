"""Reading level of documents: the median of several readability formulas.

Sentences, words, letters and syllables of the running text are counted with
built-in expressions. Syllables follow hyphenation-style rules: one for each
vowel that can carry a syllable (in Armenian and Cyrillic each vowel letter, the
second letter of a digraph not counting; in Latin script each run of vowels, a
silent final e not counting but after l), one at least for a word. The scale differs by
script, so levels are cut where the labelled documents say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentence marks get lost: a text counts as at least one sentence for so many words.
LONGEST_SENTENCE = 40
LEVELS = ("basic", "middle", "advanced")
#: Borders between the levels for a script of which no document is labelled: grades of general readers.
DEFAULT_BORDERS = (9.0, 15.0)
#: Ratings that borders are fitted on, about; of more a sample by hash of the document is taken.
MAX_RATINGS = 200_000

# Vowel letters that carry a syllable each, and vowel letters that carry one in a run.
_VOWELS_EACH = "աեէըիոօևаеёиоуыэюяі"
_VOWELS_RUN = "aeiouyéèêëàâäáîïíôöóûüú"
_LETTERS = "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, range(0xDF, 0x250))) + "".join(map(chr, range(0x430, 0x52F))) + "".join(map(chr, range(0x561, 0x588)))
_OTHERS = "".join(c for c in dict.fromkeys(_LETTERS) if c not in _VOWELS_EACH + _VOWELS_RUN + "e" and c.isalpha())
#: Letters to classes: v a vowel of its own, a a vowel of a run, e the letter e, c another letter.
_FROM = _VOWELS_EACH + _VOWELS_RUN.replace("e", "", 1) + _OTHERS
_TO = "v" * len(_VOWELS_EACH) + "a" * (len(_VOWELS_RUN) - 1) + "c" * len(_OTHERS)


def running_text(text: str | Column) -> Column:
    """The running text: headings, list items, tables and lines of links alone left out; wiki and HTML marks and invisible characters removed."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, "[­​-‏⁠-⁤︀-️﻿]", "")
    t = F.regexp_replace(t, r"(?m)^[^\S\n]*(?:=.*|[*|{!].*|<h\d[^>]*>.*|<li[^>]*>.*|(?:\[\[[^\]\n]*\]\]|[\s+,;/·-])+)$", "\n")
    t = F.regexp_replace(t, r"\[\[(?:[^\]|\n]*\|)?([^\]\n]*)\]\]", "$1")
    t = F.regexp_replace(t, r"<[^<>\n]*>|&#?\w{1,8};|\{\{[^}\n]*\}\}", " ")
    return F.regexp_replace(t, r"(?m)^[#:;\s]+", "")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds script and n_words, n_letters, n_sentences, n_syllables, n_hard (3 syllables or more), n_long (7 letters or more)."""
    # the text once, small letters mapped to their classes; every count then runs over plain ASCII
    d = docs.withColumn("_r", F.lower(running_text(text)))
    d = d.withColumn("_l", F.regexp_count("_r", F.lit("[a-zà-ɏ]"))).withColumn("_s", F.translate("_r", _FROM, _TO))
    c = F.col("_s")
    n = {
        "n_words": F.regexp_count(c, F.lit(r"[vaec]++")),
        "n_marks": F.regexp_count(c, F.lit(r"[vaec][^vaec\n։:.!?…]*+(?:[։:.!?…]++|\n|$)")),
        "n_letters": F.regexp_count(c, F.lit("[vaec]")),
        "n_syllables": F.regexp_count(c, F.lit("v|[ae]++")) - F.regexp_count(c, F.lit(r"[ae]c{1,4}+e(?![vaec])")) + F.regexp_count("_r", F.lit(r"(?<=[a-z])le(?![a-z])")),
        "n_hard": F.regexp_count(c, F.lit("(?:c*+(?:v|[ae]++)){3}[vaec]*+")),
        "n_long": F.regexp_count(c, F.lit("[vaec]{7,}+")),
        "_l": F.col("_l"),
    }
    d = d.select(*docs.columns, *[c.alias(k) for k, c in n.items()])
    least = F.greatest(F.col("n_marks"), F.ceil(F.col("n_words") / LONGEST_SENTENCE))
    script = F.when(F.col("n_letters") == 0, "other").when(2 * F.col("_l") > F.col("n_letters"), "latin").otherwise("armenian")
    return d.withColumn("n_sentences", least).withColumn("n_syllables", F.greatest("n_syllables", "n_words")).withColumn("script", script).drop("n_marks", "_l")


def grade() -> Column:
    """The median of five formulas over the columns of ``counts``; null without running text."""
    w, s = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_sentences"), F.lit(0))
    wps, spw, lpw = w / s, F.col("n_syllables") / w, F.col("n_letters") / w
    formulas = [
        0.39 * wps + 11.8 * spw - 15.59,  # Flesch-Kincaid
        0.4 * (wps + 100 * F.col("n_hard") / w),  # Gunning fog
        4.71 * lpw + 0.5 * wps - 21.43,  # automated readability
        5.88 * lpw - 29.6 / wps - 15.8,  # Coleman-Liau
        1.043 * F.sqrt(30 * F.col("n_hard") / s) + 3.1291,  # SMOG
    ]
    return F.when(w.isNotNull() & s.isNotNull(), F.array_sort(F.array(*formulas))[2])


def graded(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``script`` and ``grade``. Texts are read whole; null, empty and list-only texts have a null grade."""
    return counts(docs, text).withColumn("grade", grade())


def borders(grades: DataFrame, labels: DataFrame) -> DataFrame:
    """Per script the grades that part basic | middle | advanced.

    A border lies as many quartile ranges above the median grade of the level
    below as it lies under the median of the level above. ``grades`` has doc_id,
    script, grade; ``labels`` doc_id, reading_level (every rating counts, ratings
    of unknown documents do not). Medians and quartiles hold out against raters
    that err. A script without labels on both sides of a border takes
    ``DEFAULT_BORDERS``. Beyond ``MAX_RATINGS`` ratings the fit takes those of
    documents whose hash lies below a bar, so its state stays bounded.
    """
    n = labels.count()
    if n > MAX_RATINGS:
        labels = labels.filter(F.pmod(F.xxhash64(F.lit("rating"), "doc_id"), F.lit(1 << 32)) < int((1 << 32) * MAX_RATINGS / n))
    x = labels.join(grades, "doc_id").filter(F.col("grade").isNotNull() & F.col("reading_level").isin(*LEVELS))
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    m = x.groupBy("script").agg(*[F.percentile(F.when(F.col("reading_level") == v, F.col("grade")), q).alias(v) for v in LEVELS])

    def border(a: str, b: str, default: float) -> Column:
        wa, wb = F.col(a)[2] - F.col(a)[0] + 1e-6, F.col(b)[2] - F.col(b)[0] + 1e-6
        return F.coalesce((F.col(a)[1] * wb + F.col(b)[1] * wa) / (wa + wb), F.lit(default))

    return m.select("script", border("basic", "middle", DEFAULT_BORDERS[0]).alias("to_middle"), border("middle", "advanced", DEFAULT_BORDERS[1]).alias("to_advanced"))


def levels(grades: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds ``reading_level`` ('none' without running text); ``cut`` has one row a script."""
    d = grades.join(F.broadcast(cut), "script", "left")
    lo, hi = F.coalesce("to_middle", F.lit(DEFAULT_BORDERS[0])), F.coalesce("to_advanced", F.lit(DEFAULT_BORDERS[1]))
    level = F.when(F.col("grade").isNull(), "none").when(F.col("grade") >= hi, "advanced").when(F.col("grade") >= lo, "middle").otherwise("basic")
    return d.withColumn("reading_level", level).drop("to_middle", "to_advanced")


def reading_levels(docs: DataFrame, labels: DataFrame, scratch, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, script, grade, reading_level) of every document."""
    g = scratch.cut(graded(docs.select("doc_id", "text", *keep)).select("doc_id", *keep, "script", F.round("grade", 6).alias("grade")))
    return levels(g, borders(g.select("doc_id", "script", "grade"), labels.select("doc_id", "reading_level")))


def profile(found: DataFrame, by: str) -> DataFrame:
    """Documents and mean grade per value of ``by`` and level."""
    n = [F.count_if(F.col("reading_level") == v).alias(f"n_{v}") for v in (*LEVELS, "none")]
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), *n, F.round(F.avg("grade"), 4).alias("mean_grade"))


__all__ = ["borders", "counts", "grade", "graded", "levels", "profile", "reading_levels", "running_text"]
