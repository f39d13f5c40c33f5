"""Connected components of an edge table, without bringing edges to the driver.

Alternates large-star and small-star rounds: every node hangs its larger (smaller) neighbours on the
least node it knows. Rounds are joins and grouped minima; each round's edges are written below the
shared folder, so a lost executor costs one round. A hub with many edges is one key on the side
of the minima, which hold one row per node; adaptive execution splits it on the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    """Fingerprint of an edge set."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(least, F.col("u") == F.col("k"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root of every node that has an edge; root is the least node of its component.

    `edges` has columns u and v; direction, repeats and loops do not matter. Nulls are ignored.
    """
    now = stored(
        edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges"
    )
    before = _state(now)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        now = stored(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
