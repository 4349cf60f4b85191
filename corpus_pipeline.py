"""A training-corpus pipeline: each stage works on all that its predecessor kept.

Documents are known by their doc_id: a decision on an id holds for all its rows, and
rows with a null id are never dropped. All stages but the last return the columns
they were given; the last returns each document's token ids and their digests.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from opsdelta.llm import decontaminate as clean
from opsdelta.llm import exact_dedup as exact
from opsdelta.llm import jaccard_join as near
from opsdelta.llm import language, pieces
from opsdelta.llm.common import documents, staged, without

#: What a Python worker and a scan are handed at a time; an executor holds it several times over, on both sides.
#: Spark's own 10,000 rows of Arrow are more than a whole split of the documents.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with BATCHES set in the session, also for the write of its result and when it is called alone."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (`und`) go; texts of several languages stay."""
    found = language.predict(docs, language.fitted(docs), with_spans=False)
    return without(docs, found.where("lang_pred = 'und'"))


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts the one with the largest doc_id stays."""
    return without(docs, exact.exact_dedup(docs).where("not kept"))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-identical texts the one with the least doc_id stays."""
    return without(docs, near.jaccard_join(docs)[0].where("doc_id != class_id"))


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too large a share of benchmark passages go."""
    return without(docs, clean.decontaminate(docs, documents(spark, sf_dir, "benchmark")).where("contaminated"))


@in_small_batches
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256, covered_bytes) of every document left."""
    from public_tokenizers import path

    return pieces.digests(docs, path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language id", identify),
    ("exact dedup", drop_copies),
    ("near-duplicate join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", tokenise),
]
#: Language models and similarity groups are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
