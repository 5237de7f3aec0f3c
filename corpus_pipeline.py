"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents
go, personal data is masked, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, jaccard, packing, pii, toxicity
from lodestone.llm.common import pick, released, removed, row_key, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of an Arrow batch: what a task holds twice, in the JVM beside its heap and in its Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES, or less where the session asks for less; the session keeps this setting, as the
    stage runs after its function has returned."""
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scored = toxicity.scores(pick(docs, *COLUMNS), table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = pick(docs, *COLUMNS)
    kept = jaccard.join(docs).groupBy("class_key").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    keyed = docs.withColumn("row", row_key("doc_id", "text"))
    return keyed.join(kept, "row").dropDuplicates(["row"]).select(*COLUMNS)  # equal rows are copies too


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, *COLUMNS)
    found = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark")).select("row").distinct()
    return docs.withColumn("row", row_key("doc_id", "text")).join(found, "row", "left_anti").select(*COLUMNS)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    masked = pii.mask(pick(docs, *COLUMNS), keep=COLUMNS)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic_out), ("jaccard_join", near_duplicates_out), ("decontamination", contaminated_out), ("pii", personal_data_masked), ("packing", packed)]

#: A learned score, similarity classes and tokenization are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = written(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        released(spark)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
