"""Connected components by alternating large and small stars, entirely in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(id, component) for every id in an edge; component is the smallest id reachable.

    A round hangs every node's larger neighbours on its smallest, then its smaller ones; the number of rounds
    is logarithmic. The state is a table of edges in the shared folder, never on the driver.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _least(large)
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = materialize(small, "edges")
        changed = following.exceptAll(now).limit(1).count()
        discard(now)
        now = following
        if not changed:
            break
    else:
        raise RuntimeError("connected components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
