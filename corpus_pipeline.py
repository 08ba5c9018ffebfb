"""Training-corpus pipeline: each stage takes what its predecessor wrote and returns the documents that go on.

Stages keep the columns of documents; the last adds the token ids. No stage can be expressed as SQL
as a whole, so ORACLE_SQL is None; tests hold stages against brute-force versions, the library or labels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sphera.llm import jaccard_join, mixing, passages, pieces, toxicity
from sphera.operators.lineage import shared_folder

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("ngram_jaccard_join", jaccard_join.keep_one),
    ("substring_dedup", passages.without_repeats),
    ("mixing", mixing.ordered),
    ("sentencepiece", pieces.encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again.

    What a stage read goes as soon as its rows are written, so that no more than two stages' rows lie there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    read = None
    for _, stage in before:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read is not None:
            _delete(spark, read)
        read = path
    return last(spark, docs, sf_dir)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
