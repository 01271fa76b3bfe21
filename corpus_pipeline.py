"""The corpus pipeline: five operators of ``tessera.llm`` one after the other over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and the next stage reads it again. All stages
but the last return the columns of documents, whatever other columns there are.

Every stage asks Spark for Arrow batches of at most ``ARROW_ROWS`` rows (a session setting, left at that;
a smaller one of the caller stands): whole texts lie in them, in the executor and in its Python worker.

Defined cases: a null text is empty, has a score like any other and packs as its end
id alone; rows with a null id are scored as others, are never near duplicates
or benchmark copies (they cannot be named) and pack under a null id; a document is an id with
a text, so different texts of one id are judged apart and equal rows are one; without
labels nothing is rejected, without benchmark items nothing is taken out; empty documents
give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, packing, quality_classifier, secret_scan
from tessera.llm.common import persist_table, read_table


ARROW_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _small_batches(spark)
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    _small_batches(spark)
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark text go."""
    _small_batches(spark)
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    _small_batches(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024."""
    _small_batches(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]

#: The first, second, fourth and last stage are beyond SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
