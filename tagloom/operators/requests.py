"""What chunks of rows ask tables for, by key.

The rows are written once, with a number that puts neighbours into chunks of bounded size. A chunk
asks for each of its distinct keys once, however often it holds them, so no key is hot; the answers
to a chunk come back together and its rows are filled from them, in order. Rows move once, whole
and unexploded, and never meet a group of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from tagloom.sources.staging import staged

ROWS_PER_CHUNK = 2048


@dataclass(frozen=True, eq=False)
class Made:
    """What `of` makes of a chunk's filled lists, one item of the type for each."""

    of: Callable[[pa.Array], pa.Array]
    type: DataType


@dataclass(frozen=True, eq=False)
class Asked:
    """The values of an array's keys in a table (`_key`, `_value`), to be added as array `out`; or
    what is `made` of them by the task that fills them, so that large values need not leave it."""

    keys: Column
    pairs: DataFrame
    out: str
    made: Made | None = None


def _taken(values: pa.Array, at: pa.Array) -> pa.Array:
    """The values at these places, null for none. Lists of one length are taken as blocks, which
    costs a tenth."""
    if pa.types.is_list(values.type) and len(values) and not values.null_count:
        ends = pc.min_max(values.value_lengths()).as_py()
        if ends["min"] == ends["max"] > 0:
            blocks = pa.FixedSizeListArray.from_arrays(values.flatten(), ends["max"])
            return blocks.take(at).cast(values.type)
    return values.take(at)


def _filled(lists: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
    """For each list the values of its keys; null for unknown and null keys and null lists."""
    at = pc.index_in(lists.flatten(), value_set=keys, skip_nulls=True)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(offsets, _taken(values, at), mask=mask)


def with_answers(
    df: DataFrame, asked: Sequence[Asked], rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """`df` with the `out` column of each list; keys of a table are unique and of one type, and so
    are the values of all tables. An `out` replaces a column of its name."""
    tables = list(dict.fromkeys(a.pairs for a in asked))
    n, n_tables = len(asked), len(tables)
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
    lists = {f"k{i}": a.keys for i, a in enumerate(asked)}
    stored = staged(
        df.select(whole.alias("row"), *(k.alias(c) for c, k in lists.items()), F.monotonically_increasing_id().alias("at")),
        "asking",
    ).withColumn("chunk", F.floor(F.col("at") / rows_per_chunk))

    def asks(number: int) -> DataFrame:
        mine = [F.coalesce(F.col(f"k{i}"), F.array()) for i, a in enumerate(asked) if a.pairs is tables[number]]
        key = F.explode(F.concat(*mine)).alias("key")
        return stored.select(F.col("chunk").alias("asking"), F.lit(number).alias("table"), key).where("key is not null").distinct()

    def told(number: int) -> DataFrame:
        pairs = tables[number].select(F.col("_key").alias("key"), F.col("_value").alias("value"))
        return asks(number).join(pairs, "key").select("asking", "table", "key", "value")

    answers = reduce(DataFrame.unionAll, (told(i) for i in range(n_tables)))
    numbers = [next(i for i, t in enumerate(tables) if t is a.pairs) for a in asked]
    value_type = ArrayType(answers.schema["value"].dataType)
    row_fields = [StructField(f.name, f.dataType) for f in stored.schema["row"].dataType]
    makers = [a.made for a in asked]
    out_fields = [StructField(f"o{i}", value_type if m is None else m.type) for i, m in enumerate(makers)]
    schema = StructType(row_fields + out_fields)

    def fill(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return to_arrow_schema(schema).empty_table()
        columns = _whole(rows.column("row")).flatten()
        told = []
        table = answers.column("table").to_numpy()
        for number in range(n_tables):
            some = answers.filter(pa.array(table == number))
            told.append([_whole(some.column(c)) for c in ("key", "value")])
        filled = [_filled(_whole(rows.column(f"k{i}")), *told[numbers[i]]) for i in range(n)]
        made = [f if m is None else m.of(f) for f, m in zip(filled, makers, strict=True)]
        return pa.Table.from_arrays([*columns, *made], names=schema.names)

    found = stored.drop("at").groupBy("chunk").cogroup(answers.groupBy("asking")).applyInArrow(fill, schema)
    made = {c: F.col(f"c{i}") for i, c in enumerate(df.columns)} | {a.out: F.col(f"o{i}") for i, a in enumerate(asked)}
    return found.select(*(column.alias(c) for c, column in made.items()))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)
