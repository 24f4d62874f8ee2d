"""Cutting lineage with tables in the shared checkpoint folder, and bounded broadcasts.

Iterative plans (components, pointer doubling, propagation) must not grow their
lineage without end, and must survive the loss of any executor. ``Scratch.cut``
writes a DataFrame once as Parquet into the folder every executor shares and
reads it back. A table superseded under its name is dropped at once; the rest
stays while results may still read it, until ``Scratch.close``, ``close_all`` or
the end of the program.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN: dict[str, SparkSession] = {}
#: Drops the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset: a folder of our own on a single machine, an error on a cluster."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named:
        master = conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="derivagraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def close_all() -> None:
    """Drops the tables of all runs; results that read them are void then."""
    for root, spark in list(_OPEN.items()):
        try:
            _remove(spark, root)
        except Exception:  # the context may be gone already
            pass
    _OPEN.clear()


class Scratch:
    """Tables of one operator run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.made = 0
        self.at: dict[str, str] = {}
        _OPEN[self.root] = spark

    def cut(self, df: DataFrame, name: str | None = None, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and read it back; the write's shuffle files go with it. A table cut before under the same ``name`` is dropped after."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression=codec)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        if name:
            self.drop(name)
            self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.at.pop(name, None)
            if path:
                _remove(self.spark, path)

    def close(self) -> None:
        """Drops all tables of the run, once its result has been written or read."""
        _remove(self.spark, self.root)
        _OPEN.pop(self.root, None)


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows (they are counted); else leave the join to Catalyst."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
