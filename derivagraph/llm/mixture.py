"""Mixing sources to target shares by Pfair scheduling.

Documents are sized in tokens of a public tokenizer. What each source can give
is fixed first: its target share of the total, or its tokens times its cap on
repeats where that is less, the others making up for it in proportion. Every
source's stream of documents is then cut to blocks of equal size; block i of a
source of weight w is released at floor(i / w) and due at ceil((i + 1) / w), and
the earliest deadline among the released goes first. The mixture is scheduled in
frames of at most ``FRAME`` slots, each by itself and on any executor: a frame
gets whole blocks of each source so that at its ends each has the floor of its
share, the largest source what is left. Inside a frame each source is less than
one block from the frame's own line, so at every point of the mixture it is less
than two blocks from its share (the largest less than one more for each other
source), whatever the size; with one frame, less than one block.
"""

from __future__ import annotations

import base64
import heapq
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import running_sums
from ..scratch import Scratch, bounded_broadcast

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Tokens of a block, and slots of a frame at most.
BLOCK, FRAME = 2_048, 20_000
# Fixed value: how the vocabulary's pre-tokens are parted.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(doc_id, source, n_tokens) of documents with a source; case and outer spaces of it are ignored, null texts have 0 tokens.

    Special tokens in a text are ordinary text; texts are read whole.
    """

    def count(batches):
        for b in batches:
            enc = _encoding(path).encode_ordinary
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": pd.Series([len(enc(x)) if x else 0 for x in b["text"]], dtype="int64")})

    source = F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    d = docs.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", source.alias("source"), "text")
    return d.filter(F.col("source") != "").mapInPandas(count, "doc_id long, source string, n_tokens long")


def contributions(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens each source gives: shares of ``total`` (default: all tokens of the named sources), capped at tokens x repeats.

    What capped sources cannot give the rest gives in proportion to its shares;
    if every source is capped the mixture is as large as they allow.
    """
    names = [s for s in share if have.get(s, 0) > 0 and share[s] > 0 and repeats[s] > 0]
    cap = {s: float(have[s] * repeats[s]) for s in names}
    left = float(sum(have[s] for s in names)) if total is None else float(total)
    out: dict[str, float] = {}
    open_ = set(names)
    while open_:
        w = sum(share[s] for s in open_)
        over = {s for s in open_ if left * share[s] / w >= cap[s]}
        if not over:
            out.update({s: left * share[s] / w for s in open_})
            break
        for s in over:
            out[s] = cap[s]
        left = max(0.0, left - sum(cap[s] for s in over))
        open_ -= over
    return out


def pfair(weights: dict[str, float], slots: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of ``slots`` blocks; weights sum to 1. Earliest deadline first among the released, ties to the heavier source."""
    order = sorted(weights, key=lambda s: (-weights[s], s))
    due: list[tuple[int, int, str, int]] = []
    wait: list[tuple[int, int, str, int]] = [(0, i, s, 0) for i, s in enumerate(order) if weights[s] > 0]
    heapq.heapify(wait)
    out = []
    eps = 1e-9
    for t in range(slots):
        while wait and wait[0][0] <= t:
            _, i, s, k = heapq.heappop(wait)
            heapq.heappush(due, (math.ceil((k + 1) / weights[s] - eps), i, s, k))
        if not due:  # rounding left a slot without a released block: the next to be released goes early
            _, i, s, k = heapq.heappop(wait)
            heapq.heappush(due, (0, i, s, k))
        _, i, s, k = heapq.heappop(due)
        out.append((s, k, t))
        heapq.heappush(wait, (math.floor((k + 1) / weights[s] + eps), i, s, k + 1))
    return out


def schedule(spark: SparkSession, blocks: dict[str, int], frame: int = FRAME) -> DataFrame:
    """(source, block, slot) of all blocks of the mixture, one row each: frames are scheduled in parallel."""
    total = sum(blocks.values())
    n = max(1, -(-total // frame))
    names = sorted(blocks, key=lambda s: (-blocks[s], s))

    def had(f: int) -> dict[str, int]:
        c = {s: blocks[s] * f // n for s in names[1:]}
        return {names[0]: total * f // n - sum(c.values())} | c

    def run(batches):
        for b in batches:
            for f in b["id"].tolist():
                first, last = had(f), had(f + 1)
                take = {s: last[s] - first[s] for s in names if last[s] > first[s]}
                slots = sum(take.values())
                plan = pfair({s: k / slots for s, k in take.items()}, slots)
                yield pd.DataFrame({"source": [s for s, _, _ in plan], "block": [first[s] + k for s, k, _ in plan], "slot": [total * f // n + t for _, _, t in plan]})

    frames = spark.range(n if total else 0)
    return frames.mapInPandas(run, "source string, block long, slot long")


class Mixture:
    """The mixture of ``docs`` (doc_id, text, source) for ``targets`` (source, target_share, max_repeats: one row a source)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, scratch: Scratch | None = None, total: float | None = None, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}", block: int = BLOCK, frame: int = FRAME):
        spark = docs.sparkSession
        sc = self.sc = scratch or Scratch(spark)
        self.block, self.frame = block, frame
        rows = targets.filter(F.col("source").isNotNull() & F.col("target_share").isNotNull()).collect()  # one row a source
        self.share = {r["source"].strip().lower(): float(r["target_share"]) for r in rows}
        self.repeats = {r["source"].strip().lower(): int(r["max_repeats"] or 1) for r in rows}
        named = spark.createDataFrame([(s,) for s in self.share], "source string")
        self.sizes = sc.cut(count_tokens(docs, path).join(F.broadcast(named), "source"))
        self.sizes = self.sizes.filter("n_tokens > 0")
        self.have = {r["source"]: int(r["n"]) for r in self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        self.gives = contributions(self.have, self.share, self.repeats, total)

    def rows(self) -> DataFrame:
        """(slot, source, doc_id, copy, n_tokens): every use of a document; the mixture is these rows by slot, then copy and doc_id.

        A document's place in its source is a running total over hashed order,
        over range partitions. Copies are whole passes over the source, the last
        of them cut off where the source has given its tokens.
        """
        spark = self.sc.spark
        d = self.sizes.filter(F.col("source").isin(list(self.gives))).withColumn("h", F.xxhash64(F.lit("mix"), "doc_id"))
        d = running_sums(d, F.struct("source", "h", "doc_id"), {"upto": "n_tokens"})
        base, facts = 0, []
        for s in sorted(self.gives):  # sources in the order of the running totals
            facts.append((s, float(self.gives[s]), self.have[s], self.repeats[s], base))
            base += self.have[s]
        facts = spark.createDataFrame(facts, "source string, gives double, have long, cap int, base long")
        d = d.join(F.broadcast(facts), "source").withColumn("at", F.col("upto") - F.col("n_tokens") - F.col("base"))
        d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("cap") - 1)))
        # half of the document at least must lie within what the source gives
        d = d.withColumn("at", F.col("at") + F.col("copy") * F.col("have")).filter(F.col("at") + F.col("n_tokens") / 2 <= F.col("gives"))
        d = d.withColumn("block", F.floor(F.col("at") / self.block).cast("long"))
        plan = schedule(spark, {s: math.ceil(g / self.block) for s, g in self.gives.items()}, self.frame)
        return d.join(bounded_broadcast(plan), ["source", "block"]).select("slot", "source", "doc_id", "copy", "n_tokens")

    def report(self) -> DataFrame:
        """Per target source: target share, tokens it has, cap, passes used, tokens given and the share reached."""
        spark = self.sc.spark
        got = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("n_used"), F.max("copy").alias("last"))
        t = spark.createDataFrame([(s, self.share[s], self.repeats[s], self.have.get(s, 0)) for s in self.share], "source string, target_share double, max_repeats int, n_tokens long")
        r = t.join(got, "source", "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)))
        return r.select("source", "target_share", "n_tokens", "max_repeats", F.coalesce(F.col("last") + 1, F.lit(0)).alias("n_passes"), "n_used", F.round(F.col("n_used") / F.sum("n_used").over(Window.partitionBy()), 6).alias("actual_share"))
