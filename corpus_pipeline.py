"""The corpus pipeline: language ID, near-dedup, decontamination, secret masking, BPE ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), and all but
the last return the columns of their ``docs``, whatever these are named; what a stage needs
for itself stands in a column of a fresh name meanwhile. ``run`` applies them in order,
each written as Parquet in the shared folder and read again; the files of a stage are
deleted when the next one stands.

Repeated documents are judged each by the language, benchmark and secret stages. The
near-duplicate stage keeps one document of a group, and every row that has its id; a row
without an id is always kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm import bpe, decontaminate, language_id, near_dup, secret_scan
from msgloom.llm.common import fresh, named, staged, table

#: A document whose language is less sure than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is sure enough; rejects go."""
    model = language_id.train_on_documents(docs.select("doc_id", "text", "lang"))
    own = fresh(docs, "language")
    found = language_id.predict(docs, model, into=own)
    sure = (F.col(f"{own}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{own}.score") >= MIN_LANGUAGE_SCORE)
    return found.where(sure).select(*named(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    groups = near_dup.classes_with_components(docs.select("doc_id", "text"), words=5, percent=80)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return near_dup.without_ids(docs, gone, "doc_id")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    own = fresh(docs, "benchmark_hits")
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark"), hits_col=own)
    return found.where(F.size(own) == 0).select(*named(docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind; n_chars counts the new text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*named(docs.columns))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text; ``decodes`` says that their bytes are the text's again."""
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decodes")


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode_bpe),
]

#: SQL cannot express the stages; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), docs)
    return docs
