"""k-means with all restarts in one scan of the vectors per step.

A task multiplies each Arrow batch with the centres of all restarts that still move and adds up
sums, counts and costs per centre. These are added per centre over all tasks; only the new centres,
as many as there are restarts times clusters, come back. Starts are drawn by k-means||: a few scans
in which far points are likely to be chosen, then k-means++ among the few that were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.draws import uniform
from tagloom.sources.staging import staged

_START_ROUNDS = 2
_PER_ROUND = 2  # times the clusters
_TOLERANCE = 1e-4
#: Cells of the distances of one slice of a batch.
_CELLS = 1 << 22

_SUMS = "run int, cluster int, task int, n bigint, cost double, total array<double>"


@dataclass(frozen=True)
class Clusters:
    """The centres of the cheapest run, and what every run costs."""

    centres: np.ndarray
    costs: tuple[float, ...]

    @property
    def cost(self) -> float:
        return min(self.costs)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """token, cluster_id: the nearest centre, the first of equally near ones."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = [d.argmin(axis=1) for d in _distances(_matrix(batch.column(1)), centres)]
                ids = pa.array(np.concatenate(near) if near else [], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["token", "cluster_id"])

        return vectors.select("token", "embedding").mapInArrow(run, "token string, cluster_id int")


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _distances(points: np.ndarray, centres: np.ndarray) -> Iterator[np.ndarray]:
    """Squared distances of slices of points to all centres."""
    norms = (centres * centres).sum(axis=1)
    step = max(1, _CELLS // max(1, len(centres)))
    for at in range(0, len(points), step):
        some = points[at : at + step]
        found = (some * some).sum(axis=1)[:, None] + norms - 2.0 * (some @ centres.T)
        yield np.maximum(found, 0.0)


def _sums(points: DataFrame, runs: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per run: counts and sums of the points nearest to each centre, and what the run costs."""
    shared = points.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs = shared.value
        every = np.concatenate(list(runs.values()))
        ends = np.cumsum([len(c) for c in runs.values()])
        n, cost, total = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(every.shape)
        for batch in batches:
            matrix, at = _matrix(batch.column(0)), 0
            for distances in _distances(matrix, every):
                some = matrix[at : at + len(distances)]
                at += len(distances)
                for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                    part = distances[:, begin:end]
                    near = part.argmin(axis=1)
                    n[begin:end] += np.bincount(near, minlength=end - begin)
                    cost[begin:end] += np.bincount(near, part[np.arange(len(near)), near], end - begin)
                    hits = np.zeros((end - begin, len(near)))
                    hits[near, np.arange(len(near))] = 1.0
                    total[begin:end] += hits @ some
        task = TaskContext.get().partitionId()
        columns = [
            np.repeat(list(runs), np.diff(np.append(0, ends))),
            np.concatenate([np.arange(len(c)) for c in runs.values()]),
            np.full(len(every), task),
        ]
        arrays = [pa.array(c, pa.int32()) for c in columns] + [pa.array(n), pa.array(cost), pa.array(list(total), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["run", "cluster", "task", "n", "cost", "total"])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")  # so that sums do not depend on the order of arrival
        total = _matrix(rows.column("total").combine_chunks()).sum(axis=0)
        first = rows.slice(0, 1).select(["run", "cluster", "task"])
        sums = [pa.array([rows.column("n").to_numpy().sum()]), pa.array([rows.column("cost").to_numpy().sum()]), pa.array([total.tolist()], pa.list_(pa.float64()))]
        for name, column in zip(("n", "cost", "total"), sums, strict=True):
            first = first.append_column(name, column)
        return first

    parts = points.select("embedding").mapInArrow(run, _SUMS)
    rows = parts.groupBy("run", "cluster").applyInArrow(add, _SUMS).collect()
    shared.unpersist()
    found = {}
    for number, centres in runs.items():
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        mine = [r for r in rows if r["run"] == number]
        for r in mine:
            n[r["cluster"]], total[r["cluster"]] = r["n"], r["total"]
        found[number] = n, total, sum(r["cost"] for r in sorted(mine, key=lambda r: r["cluster"]))
    return found


def _starts(points: DataFrame, k: int, seeds: list[int]) -> dict[int, np.ndarray]:
    """Centres to start from, per run."""
    names = [f"_first_{i}" for i in range(len(seeds))]
    draws = points.withColumns({n: uniform(s, "kmeans_first", "token_id") for n, s in zip(names, seeds, strict=True)})
    least = draws.agg(*(F.min_by("embedding", F.struct(n, "token_id")).alias(n) for n in names)).first()
    chosen = {i: np.array([least[n]], np.float64) for i, n in enumerate(names)}
    for step in range(_START_ROUNDS):
        costs = {i: found[2] for i, found in _sums(points, chosen).items()}
        drawn = points.withColumns({n: uniform(s, f"kmeans_{step}", "token_id") for n, s in zip(names, seeds, strict=True)})
        shared = points.sparkSession.sparkContext.broadcast((chosen, costs))

        def pick(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            chosen, costs = shared.value
            for batch in batches:
                matrix, ids = _matrix(batch.column(1)), batch.column(0)
                for i, centres in chosen.items():
                    least = [d.min(axis=1) for d in _distances(matrix, centres)]
                    least = np.concatenate(least) if least else np.zeros(0)
                    draw = batch.column(2 + i).to_numpy()
                    at = pa.array(np.flatnonzero(draw * costs[i] < _PER_ROUND * k * least))
                    run = pa.array([i] * len(at), pa.int32())
                    yield pa.RecordBatch.from_arrays([run, ids.take(at), batch.column(1).take(at)], ["run", "token_id", "embedding"])

        schema = f"run int, token_id {points.schema['token_id'].dataType.simpleString()}, embedding array<float>"
        # Some 2 k points of each run are expected.
        far = drawn.select("token_id", F.col("embedding").cast("array<float>"), *names).mapInArrow(pick, schema).collect()
        for i in chosen:
            mine = [r["embedding"] for r in sorted((r for r in far if r["run"] == i), key=lambda r: r["token_id"])]
            if mine:
                chosen[i] = np.concatenate([chosen[i], np.array(mine, np.float64)])
    weights = {i: found[0] for i, found in _sums(points, chosen).items()}
    return {i: _plus_plus(chosen[i], weights[i], k, seed) for i, seed in enumerate(seeds)}


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted points, far ones likelier; all if there are no more."""
    points, first = np.unique(points, axis=0, return_index=True)
    weights = weights[first].astype(np.float64)
    draw = np.random.default_rng(seed)
    picked = [int(draw.choice(len(points), p=weights / weights.sum()))] if weights.sum() else [0]
    least = np.full(len(points), np.inf)
    while len(picked) < min(k, len(points)):
        least = np.minimum(least, ((points - points[picked[-1]]) ** 2).sum(axis=1))
        odds = least * np.maximum(weights, 1.0)
        picked.append(int(draw.choice(len(points), p=odds / odds.sum())))
    return points[picked]


def fit_clusters(
    vectors: DataFrame, n_clusters: int, n_init: int = 10, max_iter: int = 1000, seed: int = 12345
) -> Clusters:
    """The cheapest of `n_init` runs; run i starts from `seed + i`, whatever the others do.

    A run ends when no centre moves further than a ten-thousandth. Centres that lose all points
    stay where they are; fewer distinct vectors than clusters give fewer centres.
    """
    points = staged(vectors.select("token_id", "token", "embedding"), "vectors")
    if points.isEmpty():
        return Clusters(np.zeros((1, 0)), (0.0,) * n_init)
    centres = _starts(points, n_clusters, [seed + i for i in range(n_init)])
    moving = dict(centres)
    for _ in range(max_iter):
        for i, (n, total, _) in _sums(points, moving).items():
            there = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[i])
            moved = np.sqrt(((there - centres[i]) ** 2).sum(axis=1)).max()
            centres[i] = there
            if moved <= _TOLERANCE:
                del moving[i]
            else:
                moving[i] = there
        if not moving:
            break
    costs = {i: found[2] for i, found in _sums(points, centres).items()}
    best = min(costs, key=lambda i: (costs[i], i))
    return Clusters(centres[best], tuple(costs[i] for i in sorted(costs)))
