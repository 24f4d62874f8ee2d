"""Run folders, tables and sinks of a run."""

from __future__ import annotations

import hashlib
import json
import platform
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.curate import content_hash, empty_to_blank

NODE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("word", "pos", "definition_hy", "animacy", "declension_class", "verb_transitivity", "aktionsart", "scraped_at")])
EDGE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "source_pos", "relation", "relation_class", "target", "target_pos")])


def run_dir(base: str, resume: bool = False, prefix: str = "scrape_run_") -> Path:
    """A new time-stamped folder, or the latest by name."""
    root = Path(base)
    old = sorted(p for p in root.glob(f"{prefix}*") if p.is_dir())
    if resume and old:
        return old[-1]
    d = root / f"{prefix}{datetime.now(UTC):%Y%m%d_%H%M%S_%f}"
    d.mkdir(parents=True)
    return d


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header, all fields by the schema; a byte-order mark is no part of the first name; null is ''."""
    return empty_to_blank(spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=True, escape='"', enforceSchema=True))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def append_log(df: DataFrame, path: str) -> None:
    """word, status, n_edges, ts as JSON lines."""
    df.select("word", "status", "n_edges", "ts").write.mode("append").json(path)


def save_crawl_state(processed: DataFrame, queued: DataFrame, path: str) -> None:
    processed.select("word", F.lit("processed").alias("state")).unionByName(queued.select("word", F.lit("queued").alias("state"))).write.mode("overwrite").partitionBy("state").parquet(path)


def load_crawl_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    s = spark.read.parquet(path)
    return s.filter("state = 'processed'").select("word"), s.filter("state = 'queued'").select("word")


def save_results(results: dict, path: str) -> None:
    """Nested results to JSON; numpy values become plain, NaN becomes null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, np.ndarray)):
            return [plain(v) for v in x]
        if isinstance(x, np.generic):
            x = x.item()
        return None if isinstance(x, float) and x != x else x

    Path(path).write_text(json.dumps(plain(results), ensure_ascii=False, indent=1), encoding="utf-8")


def flatten(results: dict, prefix: str = "") -> list[tuple[str, float]]:
    """Leaves of nested results with numeric values, names joined by '/'."""
    out = []
    for k, v in results.items():
        name = f"{prefix}/{k}" if prefix else str(k)
        if isinstance(v, dict):
            out += flatten(v, name)
        elif isinstance(v, (int, float, np.number)) and not isinstance(v, bool):
            out.append((name, float(v)))
    return out


def artefacts(edges: DataFrame, config: dict) -> dict:
    """Configuration, versions and a hash of the graph's content that no order changes."""
    h = content_hash(edges).first()
    return {"config": config, "config_hash": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "versions": {"spark": pyspark.__version__, "python": platform.python_version()}, "n_rows": h["n_rows"], "hash_sum": h["hash_sum"]}


def load_config(path: str, overrides: dict | None = None) -> dict:
    """A two-level ``key: value`` configuration with the given keys replaced; lists in brackets."""
    out: dict = {}
    stack = [(-1, out)]
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        key, _, val = body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if val.strip():
            stack[-1][1][key] = _scalar(val.strip())
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    out.update({k: v for k, v in (overrides or {}).items() if v is not None})
    return out


def _scalar(x: str):
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(v.strip()) for v in x[1:-1].split(",") if v.strip()]
    if x.lower() in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(x.lower())
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x.strip("'\"")
