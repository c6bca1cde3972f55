"""A corpus pipeline of five operators; each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import materialize, small_batches, table
from loomwright.llm.decontam import BATCH_ROWS, decontaminate
from loomwright.llm.jaccard import drop_near_copies
from loomwright.llm.mixing import mix
from loomwright.llm.quality import quality
from loomwright.llm.tokens import token_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their host's frequent lines; n_chars follows the text."""
    out = quality(docs)
    name = out.columns[-1]
    # the verdict is worked out once, not again for the filter that would be pushed below it
    out = out.select(*[F.col(c) for c in docs.columns], F.explode(F.array(F.col(name))).alias(name))
    v = F.col(name)
    text = v["text"]
    new = {"text": text, "n_chars": F.when(v["lines_removed"] > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))}
    return out.where(v["kept"]).select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written in the stage itself: whole rows go to the workers and back, in small Arrow batches."""
    with small_batches(spark, BATCH_ROWS):
        return materialize(decontaminate(docs, table(spark, sf_dir, "benchmark")), "decontamination")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read from the files written."""
    return token_files(docs)


STAGES = [("quality rules", quality_rules), ("near copies", near_copies), ("decontamination", decontamination), ("source mixing", mixing), ("token output", token_output)]

#: Stages whose results are in a table already.
WRITTEN = {"decontamination"}

#: Token ids can't be made in SQL; the stages are tested one by one against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1 and name not in WRITTEN:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
