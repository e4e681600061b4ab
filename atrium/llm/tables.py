"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.storage import ship

#: Spark regex for the separators between words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: other columns, whatever their names, are left behind."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, stem: str, n: int = 1) -> list[str]:
    """``n`` column names that ``df`` does not have, whatever its columns are called (case set aside)."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"{stem}_{k}") not in taken:
            out.append(name)
        k += 1
    return out
