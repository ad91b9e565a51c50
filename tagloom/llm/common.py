"""Helpers the operators of this folder share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows worked on at once; bounds what a worker holds beside the Arrow batch.
PART_ROWS = 512

Worker = Callable[..., Sequence]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else untouched."""
    return F.translate(text, UPPER, LOWER)


def whole_text(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, stored in the folder all executors share, without lineage."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def set_checkpoint_dir(spark: SparkSession) -> None:
    """The folder named by spark.checkpoint.dir; an own one only in a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)


def text_key(text: Column, *more: Column) -> Column:
    """256-bit hash of a text, and of further values if given; null counts as empty."""
    parts = [F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)]
    parts += [F.coalesce(m.cast("string"), F.lit("")) for m in more]
    return F.unhex(F.sha2(F.encode(F.concat_ws(" ", *parts), "UTF-8"), 256))


def keep_rows(
    docs: DataFrame, key: Column, keys: DataFrame, how: str = "left_semi", one_each: bool = False
) -> DataFrame:
    """The rows of docs whose key is among (left_semi) or not among (left_anti) those of `keys`,
    its only column; columns as they are, whatever their names. One row per key if so wished."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    found = docs.select(row.alias("_row"), key.alias("_key")).join(keys.toDF("_key"), "_key", how)
    if one_each:
        found = found.groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return found.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def text_bytes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string array, empty where null."""
    return texts.cast(pa.large_binary()).fill_null(b"")


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: StructType,
    setup: Callable[[], Worker],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns `keep` (default: all) and the outputs, computed from Arrow batches.

    `setup` runs once per task and gives a function from Arrow arrays, one per input, to one
    sequence per output. An output replaces an input column of the same name.
    """
    names = [f.name for f in outputs]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = StructType([df.schema[c] for c in kept] + list(outputs.fields))
    types = [to_arrow_type(f.dataType) for f in outputs]
    read = list(dict.fromkeys([*kept, *inputs]))
    places = {c: f"c{i}" for i, c in enumerate(read)}  # names in Arrow need not be unique

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS)):
            work = work or setup()
            made = work(*(batch.column(places[c]) for c in inputs))
            arrays = [
                m.cast(t) if isinstance(m, pa.Array) else pa.array(m, type=t)
                for m, t in zip(made, types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(places[c]) for c in kept] + arrays, names=[f.name for f in schema]
            )

    renamed = df.select(*(F.col(f"`{c}`").alias(p) for c, p in places.items()))
    return renamed.mapInArrow(run, schema)


_KINDS = {
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
}


def fields(**kinds: str) -> StructType:
    """A schema from names and kinds, `array<...>` of one included; needs no session."""
    found = StructType()
    for name, kind in kinds.items():
        inner = kind.removeprefix("array<").removesuffix(">")
        found.add(name, _KINDS[kind] if inner == kind else T.ArrayType(_KINDS[inner]))
    return found


class Memo(dict):
    """Remembers a function's results, in two generations of at most `limit` keys each.

    Keys beyond `longest` are computed each time, so memory is bounded whatever the texts hold.
    """

    def __init__(self, compute: Callable, limit: int = 100_000, longest: int = 200) -> None:
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
