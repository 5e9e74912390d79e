"""Corpus cleaning in stages, each written as Parquet and read again by the next.

Edge cases: the first stage drops null and empty texts and those without a letter; an identifier that several texts have
brings no dropped text back in the exact stage, and is one document in the near stage; rows with a null identifier are
never near copies; rows that repeat in full stay together or go together; an empty table gives no rows; all stages but
the last give back every column of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from foliant.llm import content_sort, langid_ppm, minhash_fss, packing
from foliant.llm.common import checkpoint_dir


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose text has a letter and is coded by some language's tree in fewer bits than it has plain."""
    return langid_ppm.accepted(docs)


def exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the row with the largest doc_id stays."""
    return content_sort.drop_copies(docs, keep="largest")


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least doc_id stays."""
    return minhash_fss.drop_near_copies(docs)


def best_fit_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of all documents and the sequences that they are packed into."""
    return packing.pack(docs, packing.byte_tokens())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the byte models of the first stage nor the search of the last; a brute-force version is tested.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
