"""Evaluation texts inside training text: a BM25 index of the test items with block-max WAND.

Every document is read as passages of 2 * RUN - 1 words, a new one every RUN
words, so any RUN words in a row lie whole in one passage. A passage is a query
against an inverted index of the items. The impact of a term is its BM25 weight
divided by the item's own threshold, the least score that RUN words in a row of
that item can have, so every item that a passage holds scores 1 or more and none
can be missed. The lists of a passage's terms are put in order, longest first, and
their largest impacts added up: the pivot is where the sum reaches 1, and an item
in no list from the pivot on cannot score 1. Items met there are bounded by the
maxima of their blocks, then scored, and what passes is verified word by word. All
of it is sparse: an index takes room for its words, not for terms times items.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spelling import PLAIN_FORM, to_plain

RUN, BLOCK = 12, 8
#: Words of items in one index at most (some 40 bytes each, sent to every executor once); more items take another scan of the documents.
MAX_WORDS = 4_000_000
#: Passages of a document looked up together.
TOGETHER = 2_000
K1, B = 1.2, 0.75
_INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"(?:[^\W_]|[̀-ͯ])+")
_SIMPLE = re.compile("[ա-ֆև]+|[a-z]+|[0-9]+")


def words_of(text: str, memo: dict[str, str] | None = None) -> list[str]:
    """Runs of letters and digits in plain spelling, ignoring case."""
    out = []
    for w in _WORD.findall(_INVISIBLE.sub("", text).lower()):
        if _SIMPLE.fullmatch(w) and "եւ" not in w:
            out.append(w)
            continue
        p = memo.get(w) if memo is not None else None
        if p is None:
            p = to_plain(w).lower()
            if memo is not None and len(memo) < 200_000:
                memo[w] = p
        if p:
            out.extend(p.split(" "))
    return out


def _run_hash(ids: np.ndarray, run: int) -> np.ndarray:
    """A hash of every ``run`` ids in a row."""
    n = len(ids) - run + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(run):
        h = (h ^ (ids[k : k + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _with_item(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    return (h ^ (item.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)


def _values(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value at each wanted key, 0 where it is not there; ``keys`` are sorted."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


class ItemIndex:
    """Inverted index of some items: normalised BM25 impacts by term and item, with their maxima by block of items and by term."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, block: int = BLOCK):
        self.run, self.block = run, block
        memo: dict[str, str] = {}
        kept = [(i, w) for i, t in sorted(items) if len(w := words_of(t or "", memo)) >= run]
        self.ids = [i for i, _ in kept]
        self.terms: dict[str, int] = {}
        self.tok = np.array([self.terms.setdefault(x, len(self.terms)) for _, w in kept for x in w], np.int32)
        n = self.n = len(kept)
        if not n:
            return
        size = np.array([len(w) for _, w in kept])
        item = np.repeat(np.arange(n), size)
        place = np.arange(len(self.tok)) - np.repeat(np.cumsum(size) - size, size)
        keys, inverse, tf = np.unique(self.tok.astype(np.int64) * n + item, return_inverse=True, return_counts=True)
        term, of = keys // n, keys % n
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[of] / size.mean()))
        # the least score of RUN words in a row: a word counts where it stands in the run for the first time
        order = np.lexsort((place, inverse))
        last = np.full(len(self.tok), -1)
        again = inverse[order][1:] == inverse[order][:-1]
        last[order[1:][again]] = order[:-1][again]
        starts = np.flatnonzero(place + run <= size[item])
        score = np.zeros(len(starts))
        for k in range(run):
            score += np.where(last[starts + k] < starts, weight[inverse[starts + k]], 0.0)
        least = np.full(n, np.inf)
        np.minimum.at(least, item[starts], score)
        self.keys, self.impact = keys, weight / least[of] * (1 + 1e-9)
        self.ptr = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.top = np.maximum.reduceat(self.impact, self.ptr[:-1])
        blocks = self.n_blocks = -(-n // block)
        at = term * blocks + of // block
        self.block_keys, first = np.unique(at, return_index=True)
        self.block_top = np.maximum.reduceat(self.impact, first)
        grams = _with_item(_run_hash(self.tok, run)[starts], item[starts])
        order = np.argsort(grams, kind="stable")
        self.grams, self.gram_at = grams[order], starts[order].astype(np.int64)

    def candidates(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of every item that scores 1 or more for the distinct terms of a row (-1 for none)."""
        t = np.sort(rows, axis=1)
        t[:, 1:][t[:, 1:] == t[:, :-1]] = -1
        long = np.where(t >= 0, self.ptr[t + 1] - self.ptr[t], 0)
        order = np.argsort(-long, axis=1, kind="stable")
        t, long = np.take_along_axis(t, order, 1), np.take_along_axis(long, order, 1)
        sure = 1.0 - 1e-9
        behind = (np.cumsum(np.where(t >= 0, self.top[t], 0.0), 1) >= sure) & (t >= 0)  # from the pivot on
        i, j = np.nonzero(behind)
        k = long[i, j]
        post = np.repeat(self.ptr[t[i, j]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        met = np.unique(np.repeat(i, k) * self.n + self.keys[post] % self.n)
        row, item = met // self.n, met % self.n
        for size, keys, tops in ((self.n_blocks, self.block_keys, self.block_top), (self.n, self.keys, self.impact)):
            at = item // self.block if keys is self.block_keys else item
            q = t[row].astype(np.int64)
            score = np.where(q >= 0, _values(keys, tops, q * size + at[:, None]), 0.0).sum(1)
            row, item = row[score >= sure], item[score >= sure]
        return row, item

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """Term ids (-1 for words of no item) to sorted (place, item position) of all verified runs; several texts may follow each other with a -1 between them."""
        run, n = self.run, len(ids)
        none = np.zeros((0, 2), np.int64)
        if not self.n or n < run:
            return none
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        whole = known[run:] - known[:-run] == run  # runs of words that some item has
        if not whole.any():
            return none
        hashes = _run_hash(ids, run)
        padded = np.concatenate([ids, np.full(2 * run, -1, ids.dtype)])
        passages = np.unique(np.flatnonzero(whole) // run)
        hits: list[np.ndarray] = []
        for c in range(0, len(passages), TOGETHER):
            p = passages[c : c + TOGETHER] * run
            row, item = self.candidates(padded[p[:, None] + np.arange(2 * run - 1)])
            s = p[row][:, None] + np.arange(run)
            ok = (s < len(whole)) & whole[np.minimum(s, len(whole) - 1)]
            s, item = s[ok], np.repeat(item[:, None], run, 1)[ok]
            key = _with_item(hashes[s], item)
            at = np.searchsorted(self.grams, key)
            while len(s):  # equal hashes lie in a row; each is compared word by word
                there = (at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == key)
                s, item, key, at = s[there], item[there], key[there], at[there]
                same = (self.tok[self.gram_at[at][:, None] + np.arange(run)] == ids[s[:, None] + np.arange(run)]).all(1)
                hits.append(np.stack([s[same], item[same]], 1))
                s, item, key, at = s[~same], item[~same], key[~same], at[~same] + 1
        return np.unique(np.concatenate(hits), axis=0) if hits else none

    def leaks(self, ids: np.ndarray) -> dict[int, int]:
        """Term ids of one text to {item position: words covered by verified runs}."""
        found: dict[int, set[int]] = {}
        for s, item in self.runs(ids).tolist():
            found.setdefault(item, set()).update(range(s, s + self.run))
        return {i: len(c) for i, c in found.items()}


#: Words of documents looked up together.
STREAM = 200_000


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_words): items of which at least ``run`` words in a row stand in the document.

    Items are collected for an index of at most ``MAX_WORDS`` words; beyond that
    they are parted by hash into several and the documents are read again for
    each. Null and empty texts hold nothing, items shorter than ``run`` words
    cannot be found, repeated rows are reported for each id, texts are read whole.
    """
    spark = documents.sparkSession
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"\s+")) + 1).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // MAX_WORDS))
    out = None
    for b in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == b)
        index = spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in part.collect()], run))  # bounded by MAX_WORDS

        def scan(batches, index=index):
            memo: dict[str, str] = {}
            ix = index.value
            get = ix.terms.get

            def search(ids, starts, docs):
                """(doc_id, item_id, n_words) of texts that follow each other, a -1 after each."""
                hits: dict[tuple[int, int], set[int]] = {}
                r = ix.runs(np.array(ids, np.int32))
                at = np.searchsorted(starts, r[:, 0], "right") - 1
                for d, (s, item) in zip(at.tolist(), r.tolist(), strict=True):
                    hits.setdefault((d, item), set()).update(range(s, s + run))
                return pd.DataFrame({"doc_id": np.array([docs[d] for d, _ in hits], np.int64), "item_id": np.array([ix.ids[i] for _, i in hits], np.int64), "n_words": np.array([len(c) for c in hits.values()], np.int64)})

            for batch in batches:
                ids, starts, docs = [], [], []
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    starts.append(len(ids)), docs.append(doc)
                    ids.extend(get(w, -1) for w in words_of(text, memo))
                    ids.append(-1)
                    if len(ids) > STREAM:
                        yield search(ids, starts, docs)
                        ids, starts, docs = [], [], []
                if docs:
                    yield search(ids, starts, docs)

        hit = documents.filter(F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(scan, "doc_id long, item_id long, n_words long")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that hold a part of it and the most words of it that one holds; items that did not leak have 0."""
    by = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("most_words"))
    return items.select("item_id", "split").join(by, "item_id", "left").select("item_id", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_words", F.lit(0)).alias("most_words"))


__all__ = ["ItemIndex", "leak_report", "leaked_items", "words_of", "PLAIN_FORM"]
