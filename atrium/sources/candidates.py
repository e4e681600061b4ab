"""Candidate maps of sections and filter statistics: text tables with bars between fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.functions.text import section_number


def _bars(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.csv(path, sep="|", header=True, schema=names, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True, quote="")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``(section_n, image_split_name, ocr, tok)``, tok an array of tokens, empty where there are none."""
    rows = _bars(spark, path, "section_n string, image_split_name string, ocr string, tok string")
    tok = F.array_remove(F.split(F.coalesce("tok", F.lit("")), r"\s*,\s*"), "")
    return rows.withColumn("tok", tok).withColumn("ocr", F.coalesce("ocr", F.lit("")))


def read_filter_stats(spark: SparkSession, path: str) -> DataFrame:
    """``(filter_name, raw_line_segments, merged_line_groups, contour_count)``; rules and notes are left out."""
    rows = _bars(spark, path, "filter_name string, raw_line_segments string, merged_line_groups string, contour_count string")
    whole = rows.select("filter_name", *[F.col(c).try_cast("int").alias(c) for c in rows.columns[1:]])
    return whole.where("raw_line_segments IS NOT NULL AND merged_line_groups IS NOT NULL")


def rank_filters(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("merged_line_groups"), F.desc("raw_line_segments"), "filter_name")


def with_section(candidates: DataFrame, name: str = "base_name") -> DataFrame:
    """``section_n`` from the name of the image that a candidate was cut from."""
    return candidates.withColumn("section_n", section_number(F.col(name)))


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Append candidate rows; bars and line ends inside fields are replaced."""
    clean = lambda c: F.btrim(F.translate(F.col(c), "\n|", " /"))
    rows = candidates.select("section_n", "image_split_name", clean("ocr").alias("ocr"), F.array_join("tok", ", ").alias("tok"))
    rows.write.mode("append").option("header", True).option("emptyValue", "").csv(path, sep="|", quote="")
