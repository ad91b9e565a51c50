"""Exact cosine top-k that skips what cannot be among the k best.

Vectors are dealt to the nearest of some pivots, which k-means finds. What lies around a pivot is a
shard with a radius, the largest angle to the pivot in it. By the triangle inequality of angles no
vector of a shard is closer to a query than the query's angle to the pivot less the radius. A query
first searches the nearest shards that together hold k vectors; their k-th best similarity tells
which of the other shards it has to visit at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import held
from tagloom.operators.kmeans import fit_clusters
from tagloom.operators.vectors import nearest, unit
from tagloom.sources.staging import staged

#: More than the rounding of angles and of similarities can make up.
_ANGLE_MARGIN, _COSINE_MARGIN = 1e-6, 1e-8
_FOUND = "query string, token_id bigint, token string, similarity double"


@dataclass(frozen=True)
class Shards:
    """Unit pivots, radius and size of each shard. The last one holds the vectors of length zero."""

    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.pivots.T, -1.0, 1.0))

    def first(self, units: np.ndarray, k: int) -> list[np.ndarray]:
        """Per query the shards to search first: the nearest that hold k vectors together."""
        found = []
        for angle in self.angles(units):
            if np.isnan(angle).any():  # a query of length zero has no nearest ones
                found.append(np.arange(len(self.size)))
                continue
            order = np.argsort(angle - self.radius[:-1], kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.size[:-1][order]), k)) + 1
            # Vectors of length zero come last: they matter if all others are too few.
            found.append(order[:enough] if enough <= len(order) else np.arange(len(self.size)))
        return found

    def others(self, units: np.ndarray, worst: np.ndarray, k: int) -> list[np.ndarray]:
        """Per query the shards not searched first that may hold one better than `worst`."""
        found = []
        for angle, least, done in zip(self.angles(units), worst, self.first(units, k), strict=True):
            reach = np.cos(np.maximum(angle - self.radius[:-1] - _ANGLE_MARGIN, 0.0))
            near = np.flatnonzero(reach >= least - _COSINE_MARGIN)
            found.append(np.setdiff1d(near, done))
        return found


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def sharded(vectors: DataFrame, n_pivots: int, max_iter: int = 10, seed: int = 12345) -> tuple[DataFrame, Shards]:
    """token_id, token, embedding, shard, stored; and what the shards are. Centres of at most
    `n_pivots` shards are the only thing that reaches the driver."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # The length is held, or every component would compute it again.
    scaled = held(length, lambda n: F.transform("embedding", lambda x: F.try_divide(x.cast("double"), n).cast("float")))
    units = vectors.where(length > 0).select("token_id", "token", scaled.alias("embedding"))
    centres = fit_clusters(units, n_pivots, 1, max_iter, seed).centres
    pivots = unit(centres)
    pivots = pivots[~np.isnan(pivots).any(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = unit(_matrix(batch.column(2)))
            zero = np.isnan(matrix).any(axis=1)
            if len(pivots):
                angle = np.arccos(np.clip(np.nan_to_num(matrix) @ pivots.T, -1.0, 1.0))
                shard, least = angle.argmin(axis=1), angle.min(axis=1)
            else:
                shard, least = np.zeros(len(matrix), np.int64), np.zeros(len(matrix))
            shard = np.where(zero, len(pivots), shard)
            made = [pa.array(shard, pa.int32()), pa.array(np.where(zero, 0.0, least))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["token_id", "token", "embedding", "shard", "angle"])

    schema = "token_id bigint, token string, embedding array<float>, shard int, angle double"
    rows = vectors.select(F.col("token_id").cast("bigint").alias("token_id"), "token", F.col("embedding").cast("array<float>").alias("embedding"))
    stored = staged(rows.mapInArrow(run, schema), "shards")
    radius, size = np.zeros(len(pivots) + 1), np.zeros(len(pivots) + 1, np.int64)
    for r in stored.groupBy("shard").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["shard"]], size[r["shard"]] = r["radius"], r["n"]
    return stored.drop("angle"), Shards(pivots, radius, size)


def _visits(asked: DataFrame, choose) -> DataFrame:
    """query, wanted, shard of every shard a query has to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shards = choose(batch)
                at = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
                shard = pa.array(np.concatenate(shards), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), shard], ["query", "wanted", "shard"])

    return asked.mapInArrow(run, "query string, wanted array<float>, shard int")


def _searched(visits: DataFrame, stored: DataFrame, k: int, block_queries: int) -> DataFrame:
    """The k best of each shard visited. A shard is met by blocks of its queries."""
    counts = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks"))
    left = visits.join(counts, "shard").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    right = stored.join(counts, "shard").select("token_id", "token", "embedding", F.col("shard").alias("of"), each)
    return (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("of", "block"))
        .applyInPandas(lambda some, others: nearest(some, others, k), _FOUND)
    )


def similar_tags_pruned(
    queries: DataFrame, vectors: DataFrame, k: int = 30, n_pivots: int = 16, block_queries: int = 4096, visited: list | None = None
) -> DataFrame:
    """query, rank, token_id, token, similarity, as `similar_tags` gives them, without comparing a
    query with shards out of reach. `visited` receives the frames (query, shard) of both rounds.

    Zero vectors have no similarity and come last; a zero query visits all. A query without a
    vector gets one row of nulls.
    """
    stored, shards = sharded(vectors, n_pivots)
    wanted = queries.select("token").distinct()
    asked = staged(stored.join(wanted, "token", "left_semi").select(F.col("token").alias("query"), F.col("embedding").alias("wanted")), "asked")
    nothing = F.lit(None)
    unknown = wanted.join(stored, "token", "left_anti").select(
        F.col("token").alias("query"),
        nothing.cast("int").alias("rank"),
        nothing.cast("bigint").alias("token_id"),
        nothing.cast("string").alias("token"),
        nothing.cast("double").alias("similarity"),
    )
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc_nulls_last(), "token_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = _visits(asked, lambda batch: shards.first(unit(_matrix(batch.column(1))), k))
    found = staged(ranked(_searched(first, stored, k, block_queries)).drop("rank"), "nearest")
    # With fewer than k so far, or with one without similarity among them, every shard was visited.
    worst = found.groupBy("query").agg(
        F.when((F.count("similarity") == k), F.min("similarity")).otherwise(F.lit(2.0)).alias("worst")
    )
    more = _visits(
        asked.join(worst, "query").select("query", "wanted", "worst"),
        lambda batch: shards.others(unit(_matrix(batch.column(1))), batch.column(2).to_numpy(), k),
    )
    if visited is not None:
        visited.extend(v.select("query", "shard") for v in (first, more))
    both = found.unionByName(_searched(more, stored, k, block_queries))
    return ranked(both).select("query", "rank", "token_id", "token", "similarity").unionByName(unknown)
