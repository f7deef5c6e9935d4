"""Corpus pipeline: documents in, sampled piece sequences of clean, distinct, uncontaminated, secret-free documents out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, pieces, secret_scan, simhash, toxicity
from shelfspark.plans.scratch import materialize

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of a shingle, and the bits in which the fingerprints of near copies may differ.
SHINGLE, RADIUS = 4, 4


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB at most from here on, so that a task holds little beside its own work, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below one half; learnt from the training rows of `labels` among `docs`."""
    _small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id; texts without words are copies of each other."""
    _small_batches(spark)
    return simhash.keep_one(docs, SHINGLE, RADIUS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of `benchmark`."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the sampled pieces of each text."""
    _small_batches(spark)
    return pieces.encode(docs, pieces.load_pieces(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: SQL expresses neither the scores nor the sampling; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
