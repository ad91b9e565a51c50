"""The dealt operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.chunk_bpe import encode_texts
from tagloom.llm.decontaminate import benchmark_hits
from tagloom.llm.exact_dedup import exact_duplicates
from tagloom.llm.jaccard import jaccard_join
from tagloom.llm.language_model import held_in, score_texts
from tagloom.llm.licenses import scan_licenses
from tagloom.llm.oracle import ALL
from tagloom.llm.personal_data import KINDS, find_personal_data
from tagloom.llm.quality import VoteParams, fit_votes, remainder, score_quality
from tagloom.llm.ranking import rank_documents
from tagloom.llm.repeats import repeated_bytes
from tagloom.llm.token_count import count_tokens
from tagloom.llm.urls import judge_urls
from tagloom.llm.variants import spelling_variants

TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, tokenizer_path(), keep=["doc_id"])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_personal_data(docs, keep=["doc_id"])
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


HELD_OUT_PARTS, HELD_OUT = 3, 1


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    seen = labels.where(remainder(F.col("doc_id"), HELD_OUT_PARTS) != HELD_OUT)
    space = fit_votes(docs, seen, VoteParams())
    held_out = remainder(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT
    return score_quality(docs.withColumn("held_out", held_out), space, keep=["doc_id", "held_out"])


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_texts(docs, held_in(F.col("doc_id"), 10, 0))
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_texts(docs, tokenizer_path(), with_ids=False, with_decoded=False, keep=["doc_id"])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_join(docs, width=3, percent=90).drop("set_hash")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan_licenses(docs, with_spans=False, keep=["doc_id"])


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return repeated_bytes(docs).drop("starts", "ends")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return rank_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_token_count": op1_token_count,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_decontamination": op4_decontamination,
        "op5_personal_data": op5_personal_data,
        "op6_quality": op6_quality,
        "op7_language_model": op7_language_model,
        "op8_chunk_bpe": op8_chunk_bpe,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_licenses": op10_licenses,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle() -> dict[str, str]:
    return dict(ALL)
