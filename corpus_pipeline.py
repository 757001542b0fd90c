"""A corpus pipeline of five text operators; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigvane.llm import contamination, ngram_join, pii, quality, sentencepiece_codec
from rigvane.llm.common import read


# Every stage keeps all columns of the documents, whatever they are (n_chars is brought up to date if it is there), and gives
# an empty table for an empty one; texts of any length are worked on whole.  Names that begin with `__rv_` are reserved.


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample leaves out go.  Null and empty texts have weight 0; rows that agree in id
    and text stay or go together; without good labels all stay."""
    return quality.resample(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sets of five words at a similarity of 0.8 or more, the one with the smallest id stays.  Null texts and
    texts without words are linked with nothing; rows without an id stay; of rows that agree in id and text one stays."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.  Null texts and texts without words stay; an empty benchmark leaves all."""
    return contamination.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked; n_chars follows.  A null text stays null, and so does its n_chars."""
    masked = pii.mask(docs, pii.train(pii.labelled_table(spark)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids, their number, and whether decoding gives the text back; columns of the documents that
    are named like these are replaced.  A null text has null ids, no number, and counts as given back."""
    both = sentencepiece_codec.encode(docs, sentencepiece_codec.load(), out="piece_ids", round_trip="round_trip")
    return both.withColumn("n_pieces", F.when(F.col("piece_ids").isNotNull(), F.size("piece_ids")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the trained models; the pipeline is tested against its stages' brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
