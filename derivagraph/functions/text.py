"""Column expressions over words and wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

TITLE_LETTERS = "Ա-֏"


def is_proper_or_invalid(word: str = "word") -> Column:
    """Empty, shorter than 2, with a digit, or starting with an Armenian capital; null counts as empty."""
    w = F.coalesce(F.col(word), F.lit(""))
    return (F.length(w) < 2) | w.rlike(r"\p{Nd}") | w.rlike(f"^[{rules.UPPER_CASE}]")


def is_affix(word: str = "word") -> Column:
    return F.col(word).isin(rules.AFFIXES)


def ends_with_any(word: str, endings: list[str]) -> Column:
    return F.col(word).rlike(f"(?:{'|'.join(endings)})$")


def animacy(word: str = "word", pos: str = "pos") -> Column:
    human = F.col(word).isin(rules.HUMAN_STEMS.split()) | ends_with_any(word, rules.HUMAN_SUFFIXES.split())
    return F.when(F.col(pos) == "noun", F.when(human, "+human").otherwise("-human")).otherwise("")


def _ordered(word: str, table: str, default: str) -> Column:
    out = None
    for ending, label in rules.entries(table):
        hit = F.col(word).endswith(ending)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def declension(word: str = "word", pos: str = "pos") -> Column:
    return F.when(F.col(pos) == "noun", _ordered(word, rules.DECLENSIONS, "consonant-decl")).otherwise("")


def transitivity(word: str = "word", pos: str = "pos") -> Column:
    kind = F.when(ends_with_any(word, rules.CAUSATIVE_ENDINGS.split()), "causative").when(ends_with_any(word, rules.INTRANSITIVE_ENDINGS.split()), "intransitive").otherwise("transitive")
    return F.when(F.col(pos) == "verb", kind).otherwise("")


def action_kind(word: str = "word", pos: str = "pos") -> Column:
    return F.when(F.col(pos) == "verb", _ordered(word, rules.ACTIONS, "")).otherwise("")


def suffix_pos(df: DataFrame, word: str = "word", out: str = "guess") -> DataFrame:
    """Part of speech by ending (the first in order of precedence), 'unknown' without one; endings meet the table by equi-join."""
    longest = max(len(s) for s in rules.SUFFIXES)
    t = F.broadcast(df.sparkSession.createDataFrame(rules.SUFFIX_POS, "_key string, _pos string, _rank int"))
    w = df.select(word).distinct().filter(F.length(word) > 0)
    k = w.withColumn("_key", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(word), F.lit(longest))), lambda n: F.right(F.col(word), n))))
    best = k.join(t, "_key").groupBy(word).agg(F.min_by("_pos", "_rank").alias(out))
    return df.join(best, word, "left").withColumn(out, F.coalesce(out, F.lit("unknown")))


def strip_bridge(stem: str) -> Column:
    """The stem without a final bridge vowel where three letters or more stay... null where there is none."""
    s = F.col(stem)
    return F.coalesce(*[F.when(s.endswith(v) & (F.length(s) > len(v) + 2), F.substring(s, F.lit(1), F.length(s) - len(v))) for v in rules.BRIDGE_VOWELS.split()])


def clean_word(word: str, alphabet: str = "Ա-Ֆա-և-") -> Column:
    """The first run of letters of ``alphabet``; without one, the word without what surrounds its letters."""
    w = F.coalesce(F.col(word), F.lit(""))
    run = F.regexp_extract(w, f"([{alphabet}]+)", 1)
    return F.when(run != "", run).otherwise(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))


def trigrams(word: str) -> Column:
    """Character trigrams of #word#, in order; none for a null word."""
    p = F.concat(F.lit("#"), F.col(word), F.lit("#"))
    n = F.length(p)
    return F.when(F.col(word).isNotNull() & (n >= 3), F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(p, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def prompt(word: str, definition: str, width: int = 120) -> Column:
    """word: definition, the definition cut at a word border with an ellipsis beyond ``width``; the word alone without one."""
    d = F.coalesce(F.col(definition), F.lit(""))
    cut = F.concat(F.regexp_replace(F.left(d, F.lit(width)), r"\s\S*$", ""), F.lit("…"))
    d = F.when(F.length(d) > width, cut).otherwise(d)
    return F.when(d == "", F.col(word)).otherwise(F.concat(F.col(word), F.lit(": "), d))


def file_name(text: str) -> Column:
    return F.regexp_replace(F.col(text), r"[^\p{L}\p{N}_-]", "_")


def stable_hash(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def page_pos(page: str) -> Column:
    """Part of speech of a page: the first template it contains, else the first section head."""
    c = F.col(page)
    ways = [F.when(c.contains(t), p) for t, p in rules.lines(rules.POS_TEMPLATES)]
    ways += [F.when(c.rlike(rf"={{2,4}}\s*{h}\s*={{2,4}}"), p) for h, p in rules.lines(rules.POS_HEADS)]
    return F.coalesce(*ways, F.lit("unknown"))


# Wiki syntax. A link to a page (its title is the group), a template, the blocks and marks around words.
_LINK = r"\[\[([^\]|#:]+)(?:\|[^\]]*)?\]\]"
MARKUP = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]|\{\{[^}]+\}\}|'{2,3}"
DERIVED_BLOCK = r"(?s)\{\{der-top\}\}(.*?)\{\{der-bottom\}\}"
COMPOUND_HEAD, COMPOUND_TEMPLATE = "Բաղադրյալ բառեր", "բաղ"


def first_definition(page: str, width: int = 300) -> Column:
    """The first line that starts with '# ' as plain text: one pass leaves a link's page and drops templates and bold marks; '' without such a line."""
    line = F.regexp_extract(F.col(page), r"(?:^|[\r\n])[^\S\r\n]*# ([^\r\n]*)", 1)
    return F.coalesce(F.left(F.trim(F.regexp_replace(line, MARKUP, "$1")), F.lit(width)), F.lit(""))


def section(page: str, head: str, level: str = "{2,4}") -> Column:
    return F.regexp_extract(F.col(page), rf"(?s)={level}\s*{head}\s*={level}\s*(.*?)(?=\n={{2,4}}|\z)", 1)


def _groups(texts: Column, pattern: str) -> Column:
    """What the first group of ``pattern`` holds, over all texts of an array, in order."""
    return F.flatten(F.transform(texts, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))))


def compound_links(page: str, title: str, head: str = COMPOUND_HEAD, template: str = COMPOUND_TEMPLATE) -> Column:
    """Compounds a page lists: links of the section of compounds, members of its templates, links of derived-word blocks.

    Each once, in this order; only words of two letters or more wholly in the
    Armenian alphabet (hyphens allowed) count, and never the page's own title.
    """
    whole = F.array(F.col(page))
    listed = F.array(section(page, head))
    members = F.flatten(F.transform(_groups(listed, rf"\{{\{{{template}\|([^}}]+)\}}\}}"), lambda x: F.split(x, r"\|")))
    words = F.concat(_groups(listed, _LINK), members, _groups(_groups(whole, DERIVED_BLOCK), _LINK))
    clean = F.transform(words, lambda x: F.trim(x))
    return F.array_distinct(F.filter(clean, lambda x: x.rlike(rf"^[{TITLE_LETTERS}-]{{2,}}\z") & (x != F.col(title))))


# What a component of an etymology may look like; a hyphen stands at one of the two words at most.
ETYMOLOGY_FORMS = (rf"{_LINK}\s*\+\s*{_LINK}", rf"{_LINK}-\s*\+\s*{_LINK}", rf"{_LINK}\s*\+\s*-{_LINK}")


def etymology_parts(page: str, title: str, head: str = "Ստուգաբանություն") -> Column:
    """Components of [[a]] + [[b]], [[a]]- + [[b]] and [[a]] + -[[b]] in the etymology section, sorted; each form is searched by itself."""
    sec = F.regexp_extract(F.col(page), rf"(?s)==\s*{head}\s*==\s*(.*?)(?=\n=|\z)", 1)
    found = F.flatten(F.array(*[F.regexp_extract_all(sec, F.lit(p), F.lit(g)) for p in ETYMOLOGY_FORMS for g in (1, 2)]))
    kept = F.filter(found, lambda x: (F.length(x) > 1) & (x != F.col(title)) & ~x.contains("Կատեգորիա"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.trim(x))))
