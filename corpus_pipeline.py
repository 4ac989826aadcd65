"""The corpus pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Each stage works on all that the one before kept; its result is written as Parquet to the shared folder and read again, so
that a lost executor costs a stage's tasks at most. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.exact_dedup import drop_copies
from siftlake.llm.ngram_join import drop_near_copies
from siftlake.llm.packing import pack
from siftlake.llm.shared import tables_dir, written
from siftlake.llm.substring_dedup import substring_dedup, whole_characters
from siftlake.llm.toxicity import toxicity, train_on


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity tagger predicts to be toxic. It is trained on the labelled rows of docs."""
    tagger = train_on(docs.select("doc_id", "text"), tables_dir(spark, sf_dir, "labels"))
    return toxicity(docs, tagger, with_text=True).where("predicted = 0").select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of equal texts: the one with the largest doc_id."""
    return drop_copies(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class of near copies: the one with the least doc_id."""
    return drop_near_copies(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the bytes of passages of 200 bytes that stand elsewhere; characters cut in part go, documents left empty too."""
    cut = substring_dedup(docs).withColumn("text", whole_characters("kept"))
    cut = cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut
    return cut.where("n_removed = 0 OR text != ''").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in windows of 4096 tokens, at the corpus's own mixture of sources."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids").withColumnRenamed("queue", "source_queue")


STAGES = [("toxicity", clean), ("exact_dedup", unique), ("ngram_join", distinct_enough), ("substring_dedup", without_passages), ("packing", packed)]

#: Training a tagger, MinHash candidates and a tokenizer's ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables_dir(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
