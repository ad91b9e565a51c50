"""Resolving every item of one or more lists against key -> value tables.

Two ways to the same rows, whichever the tables' size:

* Small tables become a literal inside the column expression, so lists are resolved where they
  are and posts are not shuffled. Spark scans a map entry by entry, hence the table is cut into
  many tiny maps picked by the hash of the key.
* Of a larger table each chunk of rows asks for its distinct keys (`requests`): one use of the
  input, rows that move once and whole, and no hot key.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.requests import Asked, with_answers

#: Up to so many entries a table is a literal; the most that ever reach the driver.
MAX_LITERAL_ENTRIES = 20_000
_ENTRIES_PER_BUCKET = 2


@dataclass(frozen=True, eq=False)
class Lookup:
    """A key -> value table usable inside any column expression, also within lambdas."""

    buckets: Column
    n_buckets: int

    def get(self, key: Column) -> Column:
        """The value of the key, null where the key is unknown or null."""
        slot = F.pmod(F.xxhash64(key), F.lit(self.n_buckets)).cast("int")
        return F.try_element_at(F.get(self.buckets, slot), key)


def _literal(pairs: DataFrame, size: int, value_type: str) -> Lookup:
    n_buckets = max(1, size // _ENTRIES_PER_BUCKET)
    slot = F.pmod(F.xxhash64("_key"), F.lit(n_buckets)).cast("int")
    maps: list[dict] = [{} for _ in range(n_buckets)]
    for bucket, key, value in pairs.select(slot, "_key", "_value").collect():
        maps[bucket][key] = value
    text = json.dumps(maps, ensure_ascii=False, separators=(",", ":"))
    # from_json over a literal is folded to a constant before the job runs.
    return Lookup(F.from_json(F.lit(text), f"array<map<string,{value_type}>>"), n_buckets)


@dataclass(frozen=True, eq=False)
class TagTable:
    """A table of unique keys (`_key`) and their values (`_value`); a small one also as literal."""

    pairs: DataFrame
    literal: Lookup | None

    def resolve(self, df: DataFrame, keys: str, out: str) -> DataFrame:
        """Add `out`: for each key in the string array column `keys` its value, or null."""
        return resolve_all(df, [Wanted(F.col(keys), self, out)])


@dataclass(frozen=True, eq=False)
class Wanted:
    """The values of a string array's keys in a table, to be added as the array column `out`."""

    keys: Column
    table: TagTable
    out: str


def resolve_all(df: DataFrame, wanted: Sequence[Wanted]) -> DataFrame:
    """Add the `out` column of each wanted list; null for a null list.

    The tables of one call have values of one type. Every row stays as it is, whatever its id.
    """
    if all(w.table.literal is not None for w in wanted):
        return df.withColumns({w.out: F.transform(w.keys, w.table.literal.get) for w in wanted})
    return with_answers(df, [Asked(w.keys, w.table.pairs, w.out) for w in wanted])


def tag_table(
    table: DataFrame,
    key: str,
    value: str,
    value_type: str = "int",
    max_entries: int = MAX_LITERAL_ENTRIES,
) -> TagTable:
    """Prepare `table` for lookups. A key listed twice is an error at every size; null keys are
    never found. At most `max_entries` rows reach the driver.
    """
    pairs = table.select(
        F.col(key).cast("string").alias("_key"), F.col(value).cast(value_type).alias("_value")
    ).where(F.col("_key").isNotNull())
    per_key = pairs.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    twice = F.min(F.when(F.col("n") > 1, F.col("_key"))).alias("twice")
    checked = per_key.agg(twice, F.count(F.lit(1)).alias("size")).first()
    if checked["twice"] is not None:
        raise ValueError(f"duplicate keys: {[checked['twice']]}")
    small = checked["size"] <= max_entries
    return TagTable(pairs, _literal(pairs, checked["size"], value_type) if small else None)
