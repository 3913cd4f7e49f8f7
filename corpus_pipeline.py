"""A corpus pipeline: quality, near-duplicates, repeated passages, personal data, packing.

Every stage works on all rows its predecessor kept. All but the last return the columns of
`documents`; a stage that changes texts also sets n_chars anew. run() writes each stage's result
as Parquet in the shared folder and reads it again for the next, which cuts lineage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.llm import common
from kvstrata.llm.importance import selected_rows
from kvstrata.llm.packing import pack
from kvstrata.llm.pii import redacted
from kvstrata.llm.simhash_dedup import near_copies
from kvstrata.llm.substring_dedup import deduplicated_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling selects; texts unlike labelled good ones go."""
    return selected_rows(_whole(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word similarity of 0.8 or more): the one with the smallest id.

    Of rows that are equal in id and text one stays; rows without an id can't be told apart and
    stay. Rows of one id with different texts stay or go with the component that the id names.
    """
    docs = _whole(docs)
    found = near_copies(docs).filter("doc_id is not null").groupBy("doc_id")
    found = found.agg(F.min(F.col("doc_id") != F.col("component_id")).alias("__gone"), (F.count("*") > 1).alias("__again"))
    # Only ids to drop or to look at again travel; the texts stay where they are.
    marks = common.cut(found.filter("__gone or __again").withColumnRenamed("doc_id", "__id"))
    marked = docs.join(common.broadcast_if_small(marks, marks.count()), F.col("doc_id") == F.col("__id"), "left")
    kept = marked.filter("__gone is null").select(*COLUMNS)
    return kept.union(marked.filter("not __gone").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that occur more than once go; texts without any such window stay as they are."""
    return _recounted(deduplicated_rows(_whole(docs)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans with personal data become labels."""
    return _recounted(redacted(_whole(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and offset."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicate),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: Fingerprints, models and tokenizers have no SQL; a test works out all stages plainly on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}_{name}")
        docs = spark.read.parquet(f"{base}/{i}_{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
