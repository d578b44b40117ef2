"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, encoding.

Every stage is written as Parquet and read again as the next one's input, so each starts from a short plan and survives
the loss of executors. All stages but the last return the columns of ``documents``. Defined cases are those of the
operators; rows without ``doc_id`` can't be judged by the stages that compare documents and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import decontaminate, langid, linededup, pieces, simhash
from vecspark.llm import text as X


#: ids that are shipped to the executors (8 bytes each); more are joined
SHIPPED_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``ids.doc_id``. Texts are moved only where the ids, which are counted, are too many to ship."""
    gone = X.stored(ids.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    few = gone.count() <= SHIPPED_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it is fitted on a bounded sample of ``docs``."""
    return docs.where(langid.identified(docs)["accepted"])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines cut; a document of which nothing is left is dropped."""
    cut = linededup.cleaned(docs)
    left = (F.col("__cut_lines") == 0) | F.col("text").rlike(r"\S")
    cut = cut.where(left).drop("__cut_lines")
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id."""
    return _without(docs, simhash.removed(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless): each text's sampled segmentation."""
    return pieces.encoded(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("encoding", encoding)]
#: Language models and sampling can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = X.stored(docs, f"pipeline-{name}")
            X.discard(before)
    return docs
