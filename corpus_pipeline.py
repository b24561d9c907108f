"""A corpus pipeline: each stage takes (spark, docs, sf_dir), and its rows are written and read as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wideframe.llm import lang_id, near_dedup, packing, secrets
from wideframe.llm.common import step, table, written

STAGES = [
    ("language_id", lang_id.keep_known),
    ("near_dedup", near_dedup.keep_one),
    ("secrets", secrets.redact_secrets),
    ("packing", packing.pack_all),
]

#: None: language ID, near-duplicate classes and packing can't be said in SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself goes as soon as its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with step(spark) as leave:
            found = stage(spark, docs, sf_dir)
            leave()
            docs = written(found, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
