"""References to keys that do not exist, by as-of matching against runs of existing keys.

Words become integers: within a hashed block the words of both sides are ranked
in word order. The integers of existing parents are compressed into contiguous
runs; each referenced integer is matched as of the run that starts at or before it
and is an orphan beyond the run's end. Blocks follow the session's shuffle
partitions, so ranking, compressing and matching are windows over one
partitioning, never a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spelling import plain_spelling
from ..scratch import Scratch


def parse_instant(col) -> F.Column:
    """An ISO-8601 string with any offset (none: UTC) as UTC ``TIMESTAMP_NTZ``; null where it is none."""
    c = F.col(col) if isinstance(col, str) else col
    zoned = F.when(c.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})\s*$") & c.contains(":"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.try_to_timestamp(zoned).cast("timestamp_ntz")


def runs_of(ids: DataFrame) -> DataFrame:
    """Integers (block, id) to their contiguous runs (block, start, end)."""
    w = Window.partitionBy("block").orderBy("id")
    d = ids.select("block", "id").distinct()
    return d.withColumn("island", F.col("id") - F.row_number().over(w)).groupBy("block", "island").agg(F.min("id").alias("start"), F.max("id").alias("end")).drop("island")


def beyond_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``refs`` (block, id and columns of its own) that no run (block, start, end) holds."""
    own = [c for c in refs.columns if c not in ("block", "id")]
    kinds = dict(refs.dtypes)
    r = refs.select("block", "id", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), *own)
    s = runs.select("block", F.col("start").alias("id"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"), *[F.lit(None).cast(kinds[c]).alias(c) for c in own])
    w = Window.partitionBy("block").orderBy("id", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    m = r.unionByName(s).withColumn("_upto", F.last("_end", ignorenulls=True).over(w))
    return m.filter((F.col("_kind") == 1) & (F.col("_upto").isNull() | (F.col("id") > F.col("_upto")))).select(*refs.columns)


def order_ids(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``id``: integers in word order, contiguous inside each sorted partition. ``word`` must be unique."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.cut(words.repartitionByRange(n, "word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()))


def find_orphans(refs: DataFrame, parents: DataFrame, dead: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``refs`` whose key does not exist when they refer to it, with a ``reason``.

    ``refs`` has ``word`` and ``seen_at`` beside any columns of its own;
    ``parents`` has ``word`` and ``exists_from`` (null: always there), ``dead``
    has ``word``. Reasons: ``missing``, ``deleted``, ``early`` (``seen_at`` lies
    before every ``exists_from`` of the key). References with a null or empty
    word are left out, a null ``seen_at`` is never early; repeated parents count
    once; empty tables are allowed on either side.
    """
    sc = scratch or Scratch(refs.sparkSession)
    asked = refs.filter(F.col("word").isNotNull() & (F.col("word") != ""))
    there = parents.filter(F.col("word").isNotNull() & (F.col("word") != "")).groupBy("word").agg(F.when(F.max(F.col("exists_from").isNull()), F.lit(None)).otherwise(F.min("exists_from")).cast("timestamp_ntz").alias("_from"))
    if dead is not None:
        there = there.join(dead.select("word", F.lit(True).alias("_dead")).distinct(), "word", "left").withColumn("_dead", F.coalesce("_dead", F.lit(False)))
    else:
        there = there.withColumn("_dead", F.lit(False))
    rows = there.select("word", "_from", "_dead", F.lit(False).alias("_ref")).unionByName(asked.select("word").distinct().select("word", F.lit(None).cast("timestamp_ntz").alias("_from"), F.lit(False).alias("_dead"), F.lit(True).alias("_ref")))
    blocks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)))
    keys = sc.cut(rows.withColumn("id", F.dense_rank().over(Window.partitionBy("block").orderBy("word"))))
    wanted, live = keys.filter("_ref").select("block", "id", "word"), keys.filter("NOT _ref AND NOT _dead")
    gone = sc.cut(beyond_runs(wanted, runs_of(live)))
    if dead is not None:
        missing = beyond_runs(gone, runs_of(keys.filter("NOT _ref AND _dead")))
        gone = gone.select("word").join(missing.select("word", F.lit("missing").alias("_m")), "word", "left").select("word", F.coalesce("_m", F.lit("deleted")).alias("_why"))
    else:
        gone = gone.select("word", F.lit("missing").alias("_why"))
    # of words that exist, those that came at a known time
    late = live.filter(F.col("_from").isNotNull()).select("block", "id", F.col("_from").alias("_late")).join(wanted, ["block", "id"]).select("word", "_late")
    none = F.lit(None)
    verdict = gone.select("word", "_why", none.cast("timestamp_ntz").alias("_late")).unionByName(late.select("word", none.cast("string").alias("_why"), "_late"))
    out = asked.join(verdict, "word")
    early = F.col("_why").isNull() & (F.col("seen_at").cast("timestamp_ntz") < F.col("_late"))
    return out.filter(F.col("_why").isNotNull() | early).withColumn("reason", F.coalesce("_why", F.lit("early"))).drop("_why", "_late")


def edge_refs(edges: DataFrame) -> DataFrame:
    """(edge_id, side, word, seen_at): both plain endpoints of each edge; one pass over the table."""
    both = edges.select("edge_id", F.col("added_at").alias("seen_at"), F.posexplode(F.array("source", "target")).alias("_i", "_w")).filter(F.col("_w").isNotNull() & (F.col("_w") != ""))
    return both.select("edge_id", F.when(F.col("_i") == 0, "source").otherwise("target").alias("side"), plain_spelling("_w").alias("word"), "seen_at")


def node_keys(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("word").isNotNull() & (F.col("word") != "")).select(plain_spelling("word").alias("word"), parse_instant("scraped_at").alias("exists_from"))


def deleted_words(log: DataFrame) -> DataFrame:
    """Words whose latest row by ``ts`` says ``deleted``; of equally late rows the one ingested last counts."""
    last = log.filter(F.col("word").isNotNull()).groupBy("word").agg(F.max_by("status", F.struct(parse_instant("ts").alias("ts"), F.col("ingested_at"), F.col("status"))).alias("status"))
    return last.filter(F.col("status") == "deleted").select(plain_spelling("word").alias("word"))


def edge_orphans(edges: DataFrame, nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Orphan references of ``edges`` per endpoint field, with their reason."""
    return find_orphans(edge_refs(edges), node_keys(nodes), deleted_words(log))


def orphans_by_period(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Counts per side, period of ``seen_at`` (null kept as its own) and reason."""
    return orphans.groupBy("side", F.date_trunc(period, F.col("seen_at").cast("timestamp")).cast("timestamp_ntz").alias("period"), "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("word").alias("n_words"))
