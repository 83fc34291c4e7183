"""A corpus is cleaned and packed: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame.  All but the last return the columns
of ``documents``: rows that a stage rejects are gone, and texts that it changes are changed.  A stage
works on all that the stage before it kept.  The last returns the pieces of the packed sequences.

The result depends on trained models, so no SQL states it; the tests hold each stage against a
brute-force version of its decisions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracelight.llm.common import cut, table
from tracelight.llm.ngram_jaccard import one_of_each
from tracelight.llm.packing import pack
from tracelight.llm.pii import redact
from tracelight.llm.quality import keep_good
from tracelight.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur elsewhere are cut out."""
    return without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut into binary pieces and packed into sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None


def _write(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Path of ``df`` written as Parquet in the folder that the cluster shares."""
    cut(spark.range(1))  # sees to it that there is such a folder
    path = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``.

    A table between two stages is deleted once the next one is written; the last of them stays, since the
    result is read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = _write(spark, stage(spark, docs, sf_dir), name)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
