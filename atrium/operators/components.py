"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.storage import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _own_exchange(df: DataFrame, key: str) -> DataFrame:
    """Make Spark forget how ``df`` is partitioned by ``key``, so that a join can split a skewed key."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, root)`` for every node with an edge; ``root`` is the component's smallest node.

    ``edges`` holds BIGINT pairs in any direction; loops, repeats and nulls add nothing. Each round is
    two grouped minima and two joins, with the edges written to the shared folder in between.
    Hubs are safe: minima are combined before the shuffle and the joins may split a skewed key.
    """
    a, b = F.col(src), F.col(dst)
    e = stored(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.selectExpr("hi AS u", "lo AS v").unionByName(e.selectExpr("lo AS u", "hi AS v"))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(_own_exchange(m, "u"), "u").selectExpr("v AS hi", "m AS lo").distinct()
        m2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(_own_exchange(m2, "hi"), "hi").where("lo <> m").selectExpr("lo AS hi", "m AS lo")
        e = stored(small.unionByName(m2.selectExpr("hi", "m AS lo")).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.selectExpr("hi AS node", "lo AS root")
    return stars.unionByName(e.selectExpr("lo AS node", "lo AS root").distinct())
