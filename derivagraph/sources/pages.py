"""Pages of a wiki for a table of words: requests in batches on the executors, answers parsed as a DataFrame; offline from a table of pages."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curate import dense_ids

BATCH, TIMEOUT = 50, 15.0
#: Seconds to wait before the second and the third try.
WAITS = (5.0, 10.0)
# The request's fields, and the shape of the answer as far as it is read.
REQUEST = {"action": "query", "format": "json", "prop": "revisions", "rvprop": "content", "rvslots": "main"}
ANSWER = (
    "struct<query: struct<normalized: array<struct<`from`: string, `to`: string>>, pages: map<string, struct<title: string, ns: int, missing: string,"
    " revisions: array<struct<`*`: string, slots: struct<main: struct<`*`: string>>>>>>>>"
)


def ask(url: str, words: list[str], opener=urllib.request.urlopen, sleep=time.sleep) -> str | None:
    """The answer for some titles as text; None where every try fails."""
    address = f"{url}?{urllib.parse.urlencode(REQUEST | {'titles': '|'.join(words)})}"
    for wait in (0.0, *WAITS):
        if wait:
            sleep(wait)
        try:
            with opener(address, timeout=TIMEOUT) as reply:
                return reply.read().decode()
        except OSError:  # no connection, a refusal, a time-out
            continue
    return None


def answers(words: DataFrame, url: str, opener=urllib.request.urlopen, sleep=time.sleep) -> DataFrame:
    """(words ARRAY, answer) of distinct words in word order, ``BATCH`` to a request; the requests run on the executors."""
    batches = dense_ids(words.filter(F.col("word").isNotNull())).groupBy(F.floor(F.col("id") / BATCH).alias("batch")).agg(F.sort_array(F.collect_list("word")).alias("words"))

    def run(parts):
        for b in parts:
            yield pd.DataFrame({"words": b["words"], "answer": [ask(url, list(w), opener, sleep) for w in b["words"]]})

    return batches.select("words").mapInPandas(run, "words array<string>, answer string")


def parsed(found: DataFrame) -> DataFrame:
    """(words, answer) to (word, page, answered): a word's page is the one under its normalised title in the main namespace, null where there is none.

    ``answered`` is false where the request failed, so that such words can be
    asked for again instead of counting as missing.
    """
    q = F.from_json("answer", ANSWER)["query"]
    x = found.select("words", F.col("answer").isNotNull().alias("answered"), F.coalesce(q["normalized"], F.array().cast("array<struct<`from`: string, `to`: string>>")).alias("names"), F.map_values(q["pages"]).alias("pages"))
    x = x.select(F.explode("words").alias("word"), "answered", "names", "pages")
    title = F.coalesce(F.get(F.filter("names", lambda n: n["from"] == F.col("word")), F.lit(0))["to"], F.col("word"))
    page = F.get(F.filter("pages", lambda p: (p["title"] == title) & (p["ns"] == 0) & p["missing"].isNull()), F.lit(0))
    revision = F.get(page["revisions"], F.lit(0))
    return x.select("word", F.coalesce(revision["slots"]["main"]["*"], revision["*"]).alias("page"), "answered")


def wiki_pages(words: DataFrame, url: str) -> DataFrame:
    """(word, page, answered) of a table of words."""
    return parsed(answers(words, url))


def stored_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(word, page) from a table of pages (title, ns, text): null where missing or in another namespace."""
    p = pages.filter("ns = 0").groupBy(F.col("title").alias("word")).agg(F.max("text").alias("page"))
    return words.select("word").join(p, "word", "left")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Words of a spelling dictionary: the part before '/', trimmed; the count in the first line is no word."""
    w = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("/"), F.lit(1))).alias("word"))
    return w.filter((F.col("word") != "") & ~F.col("word").rlike(r"^\d+$")).distinct()
