"""From raw documents to token ids: filter, deduplicate, decontaminate, encode.

Every stage takes the documents its predecessor kept, with all their columns; the last one gives
the encoded texts. A stage's result is written and read again before the next one, so a lost
executor costs at most one stage's tasks.

Every stage takes an empty table (and gives an empty one), nulls in any column and further columns
of any name, which the stages but the last hand on as they are. Whole texts are judged, of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import chunk_bpe, decontaminate, exact_dedup, jaccard
from tagloom.llm import quality as votes
from tagloom.llm.common import set_checkpoint_dir
from tagloom.llm.queries import HELD_OUT, HELD_OUT_PARTS, table, tokenizer_path

#: The quality model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality votes accept. Learns from the labels op6 learns from.

    Equal texts fare alike, repeated rows stay repeated; a score of exactly one half is accepted.
    Null, empty and wordless texts score the labelled sample's share of good rows, and one half
    where nothing is labelled.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    seen = labels.where(votes.remainder(F.col("doc_id"), HELD_OUT_PARTS) != HELD_OUT)
    space = votes.fit_votes(docs.select("doc_id", "text"), seen, votes.VoteParams())
    return votes.keep_good(docs, space)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id, a null id after all others.

    Null counts as empty, hence one of the null and empty texts stays; of repeated rows one stays.
    """
    return exact_dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard of 0.8 or more over five-word shingles the document with
    the smallest id, a null id after all others.

    Texts without words, null ones included, are linked with nothing and stay; texts of fewer than
    five words are one shingle. Rows of one id are told apart by their text, of repeated rows one
    stays.
    """
    return jaccard.one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: fewer than one word in twenty is hit, or none.

    Null, empty and wordless texts are clean, as all are where the benchmark is empty. Rows of one
    text fare alike; repeated rows stay repeated.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes and the ids of every document left, one row per row.

    Null and empty texts have no ids; a null doc_id stays null.
    """
    texts = docs.select("doc_id", "text")
    return chunk_bpe.encode_texts(texts, tokenizer_path(), with_decoded=False, keep=["doc_id"])


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents table."""
    set_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
