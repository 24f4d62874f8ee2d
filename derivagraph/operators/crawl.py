"""Crawling as a fixpoint over a table of pages: one relational round per generation of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compound_links, etymology_parts, is_affix, is_proper_or_invalid
from ..scratch import Scratch
from .derive import EDGE, Lexicon, analyze, edges_of, inverse_edges, unique_edges


def frontier_rounds(links: DataFrame, seeds: DataFrame, scratch: Scratch, max_rounds: int | None = None) -> DataFrame:
    """(word, round): words reached over (word, to) links from the seeds; each is visited once, in the first round that reaches it."""
    links = scratch.cut(links.select("word", "to").distinct())
    seen = scratch.cut(seeds.select("word").distinct().withColumn("round", F.lit(0)), "seen")
    r = 0
    while max_rounds is None or r < max_rounds:
        new = seen.filter(F.col("round") == r).join(links, "word").select(F.col("to").alias("word")).distinct().join(seen.select("word"), "word", "left_anti")
        new = scratch.cut(new.withColumn("round", F.lit(r + 1)), "new")
        if new.limit(1).count() == 0:
            break
        seen = scratch.cut(seen.unionByName(new), "seen")
        r += 1
    return seen


def crawl_round(words: DataFrame, pages: DataFrame, lex: Lexicon) -> tuple[DataFrame, DataFrame]:
    """(edges with inverses, words to visit next) of one generation.

    Links of the section of compounds and the word itself are analysed; a word
    that gives no edge falls back on the components of its etymology.
    ``pages``: word, page (null where the page is missing).
    """
    p = words.select("word").join(pages, "word", "left").join(lex.words, "word", "left").withColumn("pos", F.coalesce("pos", F.lit("unknown")))
    linked = p.filter(F.col("page").isNotNull()).select(F.explode(compound_links("page", "word")).alias("word")).distinct().filter(~is_proper_or_invalid("word"))
    linked = linked.join(lex.words, "word", "left").withColumn("pos", F.coalesce("pos", F.lit("unknown")))
    found = analyze(p.select("word", "pos").unionByName(linked.select("word", "pos")), lex)
    bare = p.join(found.select(F.col("target").alias("word")).distinct(), "word", "left_anti").filter(F.col("page").isNotNull())
    parts = bare.select("word", "pos", F.explode(etymology_parts("page", "word")).alias("base"))
    comp = edges_of(lex.hits(parts), "compound_component")
    e = unique_edges(found.unionByName(comp))
    both = unique_edges(e.unionByName(inverse_edges(e)))
    nxt = linked.select("word").union(e.select("source")).union(parts.select("base")).distinct()
    return both.select(*EDGE), nxt.filter(~is_proper_or_invalid("word") & ~is_affix("word"))


def crawl(pages: DataFrame, seeds: DataFrame, lexicon: DataFrame, scratch: Scratch, max_rounds: int | None = None, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds until no new word appears: (edges, visited words). ``done`` words of an earlier run are not visited again; words left after ``max_rounds`` are an error."""
    lex = Lexicon(scratch.cut(lexicon.select("word", "pos")))
    lex.written(scratch)
    pages = scratch.cut(pages.select("word", "page"))
    todo = seeds.select("word").distinct().filter(~is_proper_or_invalid("word"))
    seen = scratch.cut(done.select("word").distinct() if done is not None else todo.limit(0), "seen")
    todo = scratch.cut(todo.join(seen, "word", "left_anti"), "todo")
    edges = None
    r = 0
    while todo.limit(1).count():
        if r == max_rounds:
            raise RuntimeError(f"words are still queued after {r} rounds")
        r += 1
        e, nxt = crawl_round(todo, pages, lex)
        e = scratch.cut(e)
        edges = e if edges is None else edges.unionByName(e)
        seen = scratch.cut(seen.unionByName(todo), "seen")
        todo = scratch.cut(nxt.join(seen, "word", "left_anti"), "todo")
    edges = edges if edges is not None else pages.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in EDGE))
    return unique_edges(edges), seen
