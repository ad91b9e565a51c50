"""Exact numbers of rows: a random test split, and the head of a table."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.draws import hash32
from tagloom.sources.staging import staged

Survivors = Callable[[DataFrame], DataFrame]
_BUCKETS = 65_536
_DRAWS = 1 << 32


def split_draw(seed: int) -> Column:
    return hash32(seed, "split_rows")


@dataclass(frozen=True)
class SplitCut:
    """The test set is every row whose (draw, id) is not above this pair; None means all rows."""

    draw: int | None
    id: int | None
    seed: int

    def column(self) -> Column:
        """test or train."""
        return self.named(split_draw(self.seed))

    def named(self, draw: Column) -> Column:
        return F.when(self.holds(draw), F.lit("test")).otherwise(F.lit("train"))

    def holds(self, draw: Column) -> Column:
        """True for test rows."""
        if self.draw is None:
            return F.lit(True)
        return (draw < self.draw) | ((draw == self.draw) & (F.col("id") <= self.id))


def _histogram(keyed: DataFrame, n: int, width: int):
    """The bucket the n-th row falls into, its rank in there, and how many rows there are."""
    counts = keyed.groupBy(F.floor(F.col("draw") / width).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most _BUCKETS rows.
    upto, edge = 0, None
    for bucket, count in sorted(map(tuple, counts.collect())):
        if edge is None and upto + count >= n:
            edge = bucket, n - upto
        upto += count
    return edge, upto


def _at(keyed: DataFrame, edge: tuple[int, int], width: int, seed: int) -> SplitCut:
    """The row of a rank within a bucket; only the bucket is ordered."""
    first = edge[0] * width
    near = keyed.where((F.col("draw") >= first) & (F.col("draw") < first + width))
    at = near.orderBy("draw", "id").limit(edge[1]).agg(F.max(F.struct("draw", "id")).alias("at")).first()["at"]
    return SplitCut(at["draw"], at["id"], seed)


def draw_bound(wanted: int, of: int) -> int:
    """A bound on draws below which `wanted` of so many rows lie, all but surely."""
    needed = wanted + 5 * math.isqrt(wanted) + 20
    return min(_DRAWS, -(-_DRAWS * needed // max(1, of)))


def cut_among(draws: DataFrame, test_size: int, seed: int = 0) -> SplitCut | None:
    """Where to cut rows whose `draw` and `id` are stored columns; None if there are too few."""
    if test_size <= 0:
        return SplitCut(-1, -1, seed)
    width = _DRAWS // _BUCKETS
    edge, _ = _histogram(draws, test_size, width)
    return None if edge is None else _at(draws, edge, width, seed)


def find_cut(
    rows: DataFrame, test_size: int, seed: int, survivors: Survivors = lambda df: df
) -> SplitCut:
    """Where to cut so that exactly `test_size` of the surviving rows are test. Ids are unique.

    The test rows are those of the smallest draws, so `survivors` runs only on rows drawn below a
    bound, somewhat more than the test set at first. If too few of them survive, the bound is
    widened by the share that did. A histogram of the draws finds the bucket the last test row
    falls into, and only that bucket is ordered. For rows that are costly to make see `split_once`.
    """
    if test_size <= 0:
        return SplitCut(-1, -1, seed)
    draw = split_draw(seed)
    bound = draw_bound(test_size, rows.count())
    while True:
        below = survivors(rows.where(draw < bound)).select("id", draw.alias("draw"))
        width = max(1, bound // _BUCKETS)
        edge, total = _histogram(below, test_size, width)
        if edge is not None:
            break
        if bound == _DRAWS:
            return SplitCut(None, None, seed)
        # Half as much again as the share that survived calls for, and twice the bound at least.
        needed = bound * 3 * test_size // (2 * max(1, total))
        bound = min(_DRAWS, max(2 * bound, needed))
    first = edge[0] * width
    near = survivors(rows.where((draw >= first) & (draw < first + width)))
    return _at(near.select("id", draw.alias("draw")), edge, width, seed)


def split_once(rows: DataFrame, test_size: int, seed: int) -> DataFrame:
    """All rows with a `split` column, exactly `test_size` of them test; the rows are made once.

    They are written with their draws to the folder all executors share. The cut is sought in two
    narrow columns of what was written, and what is returned reads it.
    """
    name = "_draw"
    while name in rows.columns:
        name += "_"
    stored = staged(rows.withColumn(name, split_draw(seed)), "split")
    cut = cut_among(stored.select("id", F.col(name).alias("draw")), test_size, seed) or SplitCut(None, None, seed)
    return stored.withColumn("split", cut.named(F.col(name))).drop(name)


def head(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by id. Every task keeps its n first, whatever the ids' distribution."""
    return rows.orderBy("id").limit(n)


def train_test_split(rows: DataFrame, test_size: int, seed: int = 12345) -> DataFrame:
    """All rows with a `split` column; exactly `test_size` of them are test."""
    return rows.withColumn("split", find_cut(rows, test_size, seed).column())


def train_only(rows: DataFrame, test: DataFrame) -> DataFrame:
    """All rows minus the test rows, by id."""
    return rows.join(test.select("id"), "id", "left_anti")
