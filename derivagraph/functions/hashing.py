"""Reproducible draws: the same value on every engine, partitioning and run."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: str | Column) -> Column:
    """60 bits of md5 over the seed and the keys, as BIGINT."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def unit(seed: int | str, *keys: str | Column) -> Column:
    """A draw in [0, 1)."""
    return draw(seed, *keys) / F.lit(float(1 << 60))
