"""A training corpus from raw documents: five stages, each on all that the one before kept.

Toxic documents go; of near-duplicates one document stays; contaminated documents go; secrets are overwritten in
the documents that hold them; the rest is packed into sequences. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atrium.llm import decontaminate, packing, secret_scan, simhash, toxicity
from atrium.llm.tables import table
from atrium.storage import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents among ``docs``, drop those whose expected severity is too high.

    Null and empty texts have no features and stay unless the model finds even those too severe. Rows are judged where
    they stand, so null and repeated ids are no trouble.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints, the smallest by doc_id; empty and null texts are one component."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is in windows of ``benchmark``; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets overwritten and ``n_chars`` of the new text; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its sequence and place there; null texts are empty."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order, each to the table that the one before has stored.

    Rows are the pieces of the last stage. Null ids, texts and repeated rows have the results that the stages state; an
    empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
