"""A corpus from documents: five stages, each on all that the one before it kept.

Language ID drops what no language model explains, line dedup takes repeated lines out of the texts,
SimHash keeps one document of each group of near-duplicates, PII masks personal data, and packing
lays the tokens out in sequences. Each stage's result is written as Parquet in the folder that the
cluster shares and read again as the next one's input.

In every stage columns may hold nulls, texts may be of any length, rows may repeat, columns beyond those
of documents are left out whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cyclecast import session
from cyclecast.llm import langid, linededup, packing, pii, simhash
from cyclecast.llm.common import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter (null and empty texts, too) or that all language models reject.

    Repeated rows stay or go together; of languages that explain a text alike the first by name counts.
    """
    prepare(spark)
    return langid.keep_identified(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one within one edit, and documents that consist of such.

    Earlier is by doc_id, then by line. Rows with a null id keep all lines, null and empty texts stay.
    Rows with one doc_id keep the same lines.
    """
    prepare(spark)
    return linededup.keep_new_lines(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more: the smallest doc_id.

    Texts without a word and rows with a null id stay; rows with one doc_id stay or go together.
    """
    prepare(spark)
    return simhash.keep_first(docs.select(*COLUMNS), words=5)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data and what discloses it masked; every row stays, null and empty texts as they are."""
    prepare(spark)
    return pii.sanitise(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; null texts have the end token alone, repeated
    rows are packed as often."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, public_tokenizers.PATTERN, window=1024)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("private", private), ("pack", pack)]

#: Most stages can't be told in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``; only the last one's table is left."""
    session.workers_see_package(spark)
    prepare(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = session.table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{at}-{name}")
        docs = spark.read.parquet(f"{shared}/{at}-{name}")
        if at:
            _remove(spark, f"{shared}/{at - 1}-{STAGES[at - 1][0]}")
    return docs
