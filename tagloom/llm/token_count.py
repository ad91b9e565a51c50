"""Token counts by byte-pair merging; no ids are made."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import add_columns, fields, text_bytes
from tagloom.llm.merges import FieldReader, MergeTable, merge_table


def token_counter(table: MergeTable) -> FieldReader:
    """Text to its number of tokens: the symbols of each piece less the merges made in it."""

    def of_piece(piece: bytes) -> int:
        return len(piece) - table.merge(piece)[1]

    return FieldReader(table, of_piece, lambda special: 1, sum)


def count_tokens(
    df: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    limit: int = 2048,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    Pure map: no shuffle. Null and empty texts have 0 tokens. Repeated rows and ties are counted
    row by row, an empty table stays empty. Input columns of the names added are replaced. Very
    long words take time n log n; remembered words are bounded in number and length.
    """

    def setup():
        count = token_counter(merge_table(tokenizer_path))

        def work(texts):
            raw = text_bytes(texts)
            counts = [count(t.as_py().decode()) for t in raw]
            return pc.binary_length(raw), counts, [n > limit for n in counts]

        return work

    outputs = fields(n_bytes="long", n_tokens="long", over_limit="boolean")
    return add_columns(df.withColumn(text, F.col(text).cast("string")), [text], outputs, setup, keep)
