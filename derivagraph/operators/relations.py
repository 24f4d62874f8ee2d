"""Labels of edges against the relation dimension, and parent-child links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spelling import filled, plain_spelling
from ..scratch import bounded_broadcast


def relation_key(col: str = "relation"):
    """A label ignoring case and outer white space."""
    return F.lower(F.regexp_replace(F.col(col), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def with_relation(edges: DataFrame, names: DataFrame, how: str = "left") -> DataFrame:
    """Adds ``_canonical``, ``_class`` and ``_inverse_of`` of the label; null for a label that is not listed."""
    dim = names.select(
        F.lower(F.trim("label_name")).alias("_label"), F.col("canonical").alias("_canonical"), F.col("relation_class").alias("_class"), F.col("inverse_of").alias("_inverse_of")
    ).dropDuplicates(["_label"])
    return edges.withColumn("_label", relation_key()).join(bounded_broadcast(dim), "_label", how)


def parent_child_links(edges: DataFrame, names: DataFrame, excluded_class: str = "compounding") -> DataFrame:
    """Distinct (parent, child) pairs of plain words.

    Edges with an empty endpoint or label, a label that is not listed or the
    excluded class give no link; an inverse relation runs from child to parent.
    """
    e = with_relation(edges.filter(filled("source", "target", "relation")).select("source", "target", "relation"), names, "inner").filter(F.col("_class") != excluded_class)
    e = e.select(plain_spelling("source").alias("s"), plain_spelling("target").alias("t"), F.col("_inverse_of").isNotNull().alias("inv"))
    return e.select(F.when(F.col("inv"), F.col("t")).otherwise(F.col("s")).alias("parent"), F.when(F.col("inv"), F.col("s")).otherwise(F.col("t")).alias("child")).distinct()
