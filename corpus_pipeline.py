"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` is what the stage before it kept, written as
Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, packing, pii, simhash, toxicity
from quillspark.llm.encoding import vocabulary
from quillspark.llm.shared import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic; learns from the labelled ones among ``docs``.

    Null texts count as empty; rows without doc_id and repeated rows are scored like others;
    without labels of both kinds all rows get one verdict; an empty table gives an empty one.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like texts (five-word shingles, similarity 0.8): that with the least doc_id.

    Null and empty texts are alike; rows without doc_id stay; rows that share a doc_id stay or
    go together; an empty table gives an empty one.
    """
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item or half of one.

    Null texts hold nothing; rows without doc_id stay; rows that share a doc_id stay or go
    together; an empty table or benchmark drops nothing.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; ``n_chars`` follows. Null texts stay null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Null texts give the end id alone; every row is a document of its own."""
    return packing.piece_digest(packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 2))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learnt scores, graph components and token ids aren't expressible in SQL; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
