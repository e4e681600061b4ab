"""Greedy choices in an order: of two that conflict the later one goes, unless the earlier one is gone itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators.components import connected_components
from atrium.operators.grids import FLOOR, large_floors
from atrium.operators.numbering import numbered
from atrium.storage import ship, stored


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(plan_id, floor_id, node)`` of those that go, for rows with one unit's conflicts in order of the later one."""
    for batch in batches:
        at, gone = [], []
        for k, pairs in enumerate(batch.column(2)):
            beaten: set[int] = set()
            for a, b in zip(pairs.values.field("a").to_pylist(), pairs.values.field("b").to_pylist(), strict=True):
                if a not in beaten:
                    beaten.add(b)
            at += [k] * len(beaten)
            gone += beaten
        keys = [batch.column(i).take(pa.array(at, pa.int64())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(gone, pa.int64())], names=[*FLOOR, "node"])


def beaten(conflicts: DataFrame, rank: list[str], most: int = 50_000) -> DataFrame:
    """``(plan_id, floor_id, node)``: those that the greedy choice drops.

    ``conflicts``: ``(plan_id, floor_id, a, b, ...)`` with BIGINT ids, ``a`` before ``b``; the columns ``rank`` order ``b``
    among all of its floor. A floor of up to ``most`` conflicts is settled in one go. Of a larger one each connected
    component is; of a component that is larger still, the first ``most`` conflicts are settled, what they decide is taken
    out, and the rest is looked at again.
    """
    ship(conflicts.sparkSession)
    conflicts = stored(conflicts.select(*FLOOR, "a", "b", *rank))
    kinds = dict(conflicts.dtypes)
    schema = f"plan_id {kinds['plan_id']}, floor_id {kinds['floor_id']}, node bigint"
    in_order = F.sort_array(F.collect_list(F.struct(*rank, "b", "a"))).alias("pairs")
    settle = lambda rows, *unit: rows.groupBy(*FLOOR, *unit).agg(in_order).select(*FLOOR, "pairs").mapInArrow(_walk, schema)
    large = large_floors(conflicts, most)
    if large is None:
        return settle(conflicts)
    found = settle(conflicts.join(large, FLOOR, "left_anti"))
    left = stored(conflicts.join(large, FLOOR, "left_semi"))
    # Numbers for the members of large floors: components need one number for each.
    nodes = left.select(*FLOOR, F.col("a").alias("id")).unionByName(left.select(*FLOOR, F.col("b").alias("id"))).distinct()
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    for side in "ab":
        left = left.join(nodes.select(*FLOOR, F.col("id").alias(side), F.col("node").alias(f"n{side}")), [*FLOOR, side])
    left = stored(left)
    while not left.isEmpty():
        roots = connected_components(left, "na", "nb").withColumnRenamed("node", "na")
        rows = stored(left.join(roots, "na"))
        sizes = stored(rows.groupBy("root").agg(F.count("*").alias("n")))
        found = found.unionByName(settle(rows.join(sizes.where(F.col("n") <= most), "root", "left_semi"), "root"))
        rest = rows.join(sizes.where(F.col("n") > most), "root", "left_semi")
        if rest.isEmpty():
            break
        rest = stored(numbered(rest, ["root"], [*rank, "nb", "na"], "at"))
        early = rest.groupBy("root", "nb").agg(F.min("at").alias("first")).where(F.col("first") < most).select("root", "nb")
        decided = stored(early)
        head = rest.join(decided, ["root", "nb"], "left_semi")
        gone = stored(settle(head, "root"))
        # Of the rest: whom a kept one of these beats is gone; what a gone one would have beaten is free of it.
        tail = stored(rest.join(decided, ["root", "nb"], "left_anti"))
        known = decided.select(F.col("nb").alias("na")).unionByName(head.select("na")).distinct()
        out = gone.select(*FLOOR, F.col("node").alias("a"), F.lit(True).alias("out"))
        tail = tail.join(out, [*FLOOR, "a"], "left").where("out IS NULL").drop("out")
        tail = stored(tail.join(known.withColumn("known", F.lit(True)), "na", "left"))
        hit = stored(tail.where("known").select(*FLOOR, F.col("b").alias("node")).distinct())
        found = found.unionByName(gone).unionByName(hit)
        free = tail.where("known IS NULL").select(*FLOOR, "a", "b", *rank, "na", "nb")
        for side in "ab":
            free = free.join(hit.withColumnRenamed("node", side), [*FLOOR, side], "left_anti")
        left = stored(free)
    return found
