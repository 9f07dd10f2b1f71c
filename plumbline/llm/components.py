"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round every root hooks onto the least root among its neighbours' roots, and every node then
    follows its root's new root. Rounds are logarithmic in practice; each is a written table. Empty
    edges give no rows; loops and repeated edges change nothing.
    """
    both = edges.where("a is not null and b is not null")
    both = materialize(both.select("a", "b").union(both.select(F.col("b"), F.col("a"))).distinct(), name)
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    label = materialize(label, name)
    while True:
        # over edges between roots: the least root that each root sees
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select("a", "rb")
        seen = near.join(label.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.min("rb").alias("least")).where("least < root")
        hooks = materialize(seen, name)
        if hooks.isEmpty():
            return _jump(label, name)
        label = label.join(hooks, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
        label = _jump(materialize(label, name), name)


def _jump(label: DataFrame, name: str) -> DataFrame:
    """Replaces roots by their roots until nothing changes."""
    while True:
        up = label.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = materialize(label.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.coalesce("top", "root") != F.col("root")).alias("moved")), name)
        label = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return label
