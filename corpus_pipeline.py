"""From raw documents to token files: five stages, each an operator of ``plantwatch.llm``.

Each stage works on all that the one before kept, as read back from Parquet. Nulls, ties, repeated rows, long texts, empty tables and
extra columns are as each operator's docstring says; a stage keeps the columns of its documents, the last gives a row per
document of the files.
"""

from plantwatch.llm import decontaminate, minhash_dedup, mixing, quality, token_files
from plantwatch.llm.queries import vocabulary
from plantwatch.llm.store import ship, written

#: Of the words that are left, the share that the mixture keeps; each document is used once.
MIX_SHARE = 0.9


def good_quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it learns from the labels of rows that aren't held out."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one with the least id."""
    return minhash_dedup.deduplicated(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents that hold a test item go."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark, docs, sf_dir):
    """The documents of one epoch of the mixture to target weights."""
    return mixing.chosen(docs, share=MIX_SHARE)


def tokens(spark, docs, sf_dir):
    """Token files of what is left, read back: a row per document with its place, length and checksum."""
    return token_files.token_files(docs, vocabulary())


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mixture", mixture), ("token_files", tokens)]
#: Sampling, a classifier and a tokenizer are not SQL; tests hold the rows against a version without Spark.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, from the documents of ``sf_dir``; each stage is written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", spark)
    return STAGES[-1][1](spark, docs, sf_dir)
