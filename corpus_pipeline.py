"""From documents to token files: quality, near-duplicates, leaks, mix, token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet in the shared folder and read again, so a lost
executor costs at most the stage that is running. All stages but the last return
the columns of documents, further columns of any name included.

Defined results: null, empty and wordless texts are rejected by the first stage;
of equal rows, and of texts of one class, the second keeps the smallest doc_id
(nulls last); a null lang, source or n_chars stays null but for n_chars of mixed
texts, which is set where the column exists; rows with a null doc_id go through
all stages; a benchmark without usable items removes nothing; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemill.llm import common, decontaminate, mixing, quality, simhash, tokenstore


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return quality.keep_good(docs, quality.labels_of(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.keep_one_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's index, read back from its files."""
    return tokenstore.store_and_read(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("mixing sources", to_weights),
    ("token-ID output", to_tokens),
]

#: Training, fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.parted(docs, f"stage{k}")
    return docs
