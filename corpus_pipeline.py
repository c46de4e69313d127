"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockfold.llm import decontamination, linededup, packing, quality, simhash
from blockfold.llm.common import table, work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Overlap of five-word shingles (Jaccard) from which documents are near-duplicates.
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which no word is left by that."""
    cut = linededup.without_runs(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked by SimHash or by an overlap of at least SIMILARITY, the row of least doc_id stays.

    Rows count one by one, whatever their doc_ids: texts that share a doc_id
    are kept or dropped each for itself, and of repeated rows one stays. All
    texts without words are one group.
    """
    docs = docs.select(*COLUMNS)
    return simhash.one_of_each(docs, simhash.near_duplicates(docs, words=5, similarity=SIMILARITY)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark passages go, with what stands between them."""
    found = decontamination.search(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), extra=("lang", "source"), cut=True)
    return found.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Tokenizing and SimHash are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
