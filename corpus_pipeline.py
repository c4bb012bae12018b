"""The corpus pipeline: documents through the operators of ``prepkit.llm``, stage by stage.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm import decontamination, lang_id, line_dedup, near_copies, packing
from prepkit.sources.scratch import release, scratch_path, scratch_scope

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
REMEMBERED = 60_000  # words whose ids a Python worker keeps, as it serves the other stages too
MIN_SCORE = 0.5  # least probability of the likeliest language


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a likeliest language stay, in effect all that have letters; learnt from the labelled two thirds."""
    model = lang_id.train(docs.where(~lang_id.held_out()))
    return lang_id.keep_identified(docs, model, MIN_SCORE)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in five documents or more stay in one; ``n_chars`` follows the text."""
    with near_copies.small_batches(spark):
        changed = line_dedup.drop_shared_lines(docs)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) the smallest id's document stays.

    SimHash fingerprints in pigeonhole blocks propose pairs, a prefix-filtered join those that lie more bits apart;
    all are verified on whole shingle sets.
    """
    return near_copies.keep_first(docs, width=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of up to 1024 tokens, a row per piece of a document."""
    return packing.pack_documents(docs, RANK_FILE, remembered=REMEMBERED)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models, hashes and tokens of the stages are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage wrote for itself goes when its result is written, the result when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
