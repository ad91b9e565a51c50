from __future__ import annotations

import duckdb
import public_tokenizers
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def texts():
    rows = duckdb.sql(f"select text from read_parquet('{SMALL}/documents.parquet') order by doc_id")
    return [r[0] for r in rows.fetchall()]


@pytest.fixture
def odd_docs(spark):
    """Nulls everywhere, empty and blank texts, copies, repeated rows, one long text, and columns
    named like those the operators add or use."""
    long = " ".join(f"word{i % 700}" for i in range(30_000)) + " " + "x" * 5000
    rows = [
        (1, "Alpha beta gamma delta.", "a", 0.5),
        (2, "Alpha  beta\tgamma\ndelta.", "b", None),
        (2, "Alpha  beta\tgamma\ndelta.", "b", None),
        (3, "", None, 1.0),
        (4, None, "c", 2.0),
        (None, "Alpha beta gamma delta.", "d", 3.0),
        (None, None, None, None),
        (5, " \n ", "e", 4.0),
        (6, long, "f", 5.0),
        (7, long + " end", "g", 6.0),
        (8, "mail a@b.co, +1 202 555 0147 and é 漢字", "h", 7.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, score double")
