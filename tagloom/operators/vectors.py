"""Tag vectors: clusters, similar tags, transfer to another vocabulary, lookup for id lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.draws import digest_sql
from tagloom.operators.kmeans import fit_clusters
from tagloom.operators.requests import Asked, Made, with_answers

# Numbers of one vector times rows of a chunk that asks for vectors.
_CHUNK_NUMBERS = 1 << 17
_ROUND = 9
_QUERY_CHUNK = 512
_VECTOR_CHUNK = 4096
# Of vectors in one block of queries or one shard; their product is taken 512 queries and 4,096
# vectors at a time, of which each query's k best are kept.
_BLOCK_BYTES = 16 << 20


def tag_vectors(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """token_id, token, embedding, joined by id: row i of the matrix belongs to token i.

    Tokens without a vector stay, with null; see `known_vectors`.
    """
    return vocab.select("token_id", "token").join(
        vectors.select("token_id", "embedding"), "token_id", "left"
    )


def known_vectors(vectors: DataFrame) -> DataFrame:
    """The tokens that have a vector."""
    return vectors.where(F.col("embedding").isNotNull())


def train_clusters(
    vectors: DataFrame,
    n_clusters: int = 32,
    n_init: int = 10,
    max_iter: int = 1000,
    seed: int = 12345,
) -> DataFrame:
    """token, cluster_id of the cheapest of `n_init` k-means runs."""
    return fit_clusters(vectors, n_clusters, n_init, max_iter, seed).assign(vectors)


def cluster_members(cluster_map: DataFrame) -> DataFrame:
    """cluster_id, tags (sorted), n. A list per cluster is the result, so it must fit a row."""
    return cluster_map.groupBy("cluster_id").agg(
        F.sort_array(F.collect_list("token")).alias("tags"), F.count(F.lit(1)).alias("n")
    )


def same_cluster(queries: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """token, cluster_id, member: one row per tag in the cluster of each asked token.

    Tokens without a cluster keep one row of nulls.
    """
    asked = queries.select("token").join(cluster_map, "token", "left")
    members = cluster_map.select("cluster_id", F.col("token").alias("member"))
    return asked.join(members, "cluster_id", "left").select("token", "cluster_id", "member")


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of length zero become not-a-number."""
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norm


def _first_k(sim: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k best: highest similarity, then lowest place, undefined last."""
    level = np.where(np.isnan(sim), -1.0, np.round((sim + 1.0) * 10**_ROUND))
    # Similarity level and id in one distinct whole number, so that a partition is exact.
    key = place - level.astype(np.int64) * 2**24
    if k >= key.shape[1]:
        return np.argsort(key, axis=1)
    nearest = np.argpartition(key, k - 1, axis=1)[:, :k]
    order = np.argsort(np.take_along_axis(key, nearest, axis=1), axis=1)
    return np.take_along_axis(nearest, order, axis=1)


def _best(units: np.ndarray, shard: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the rows of its k best in the shard, and their similarities."""
    sims, rows = [], []
    for at in range(0, len(shard), _VECTOR_CHUNK):
        sim = units @ shard[at : at + _VECTOR_CHUNK].T
        best = _first_k(sim, place[at : at + _VECTOR_CHUNK], k)
        sims.append(np.take_along_axis(sim, best, axis=1))
        rows.append(best + at)
    sim, row = np.concatenate(sims, axis=1), np.concatenate(rows, axis=1)
    best = _first_k(sim, place[row], k)
    return np.take_along_axis(row, best, axis=1), np.take_along_axis(sim, best, axis=1)


def nearest(asked: pd.DataFrame, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one shard of vectors for each query of one block."""
    parts = []
    if len(asked) and len(found):
        units = unit(np.stack(asked["wanted"].to_numpy()).astype(np.float64))
        shard = unit(np.stack(found["embedding"].to_numpy()).astype(np.float64))
        names = asked["query"].to_numpy(object)
        ids = found["token_id"].to_numpy(np.int64)
        tokens = found["token"].to_numpy(object)
        place = np.empty(len(ids), dtype=np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        for start in range(0, len(names), _QUERY_CHUNK):
            best, sim = _best(units[start : start + _QUERY_CHUNK], shard, place, k)
            value = np.round(sim, _ROUND).ravel()
            parts.append(
                pd.DataFrame(
                    {
                        "query": np.repeat(names[start : start + _QUERY_CHUNK], best.shape[1]),
                        "token_id": ids[best].ravel(),
                        "token": tokens[best].ravel(),
                        "similarity": np.where(np.isnan(value), None, value),
                    }
                )
            )
    columns = ["query", "token_id", "token", "similarity"]
    return pd.concat(parts) if parts else pd.DataFrame(columns=columns)


def similar_tags(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 30,
    max_bytes: int = _BLOCK_BYTES,
) -> DataFrame:
    """query, rank, token_id, token, similarity: the k tags closest by cosine, itself included.

    Queries are dealt into blocks and vectors into shards of about `max_bytes`. Every task
    multiplies one block with one shard and returns k rows per query, and only those are ranked;
    pairs are never written out and no vector reaches the driver. Zero vectors have no similarity
    and come last. A query without a vector gets one row of nulls.
    """
    wanted = queries.select("token").distinct()
    asked = vectors.join(wanted, "token", "left_semi")
    nothing = F.lit(None)
    unknown = wanted.join(vectors, "token", "left_anti").select(
        F.col("token").alias("query"),
        nothing.cast("int").alias("rank"),
        nothing.cast("bigint").alias("token_id"),
        nothing.cast("string").alias("token"),
        nothing.cast("double").alias("similarity"),
    )

    def parts(table: DataFrame) -> int:
        size = table.agg(F.sum(F.size("embedding").cast("bigint")).alias("n")).first()["n"]
        return max(1, -(-8 * (size or 0) // max_bytes))

    n_blocks, n_shards = parts(asked), parts(vectors)

    def dealt(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    block, shard = dealt("token", n_blocks), dealt("token_id", n_shards)
    # Renamed, as both sides come from one table.
    left = asked.select(
        F.col("token").alias("query"),
        F.col("embedding").alias("wanted"),
        block.alias("block"),
        each(n_shards).alias("shard"),
    )
    right = vectors.select(
        "token_id", "token", "embedding", each(n_blocks).alias("block"), shard.alias("shard")
    )
    found = (
        left.groupBy("block", "shard")
        .cogroup(right.groupBy("block", "shard"))
        .applyInPandas(
            lambda some, others: nearest(some, others, k),
            "query string, token_id bigint, token string, similarity double",
        )
    )
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc_nulls_last(), "token_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query", "rank", "token_id", "token", "similarity")
        .unionByName(unknown)
    )


def _normals(seed: int, key: str, size: int, spread: float) -> Column:
    """Normal draws per (key, position), each from two uniform ones of one digest."""

    def u(begin: int) -> str:
        return f"(cast(conv(substring(d, {begin}, 8), 16, 10) as bigint) + 1) / {float(2**32)}D"

    normal = f"sqrt(-2D * ln({u(1)})) * cos({2 * np.pi!r}D * ({u(9)}))"
    digests = f"transform(sequence(0, {size - 1}), i -> {digest_sql(seed, 'init', key, 'i')})"
    return F.expr(f"transform({digests}, d -> cast({float(spread)!r}D * ({normal}) as float))")


def transfer_vectors(
    vocab: DataFrame,
    vectors: DataFrame,
    hidden_size: int,
    initializer_range: float = 0.02,
    seed: int = 12345,
) -> DataFrame:
    """token_id, token, copied, embedding for a new vocabulary.

    Tokens the vectors know keep theirs, the others get normal draws of the given spread. A
    vector of another size raises.
    """
    old = vectors.select("token", F.col("embedding").alias("_old"))
    drawn = _normals(seed, "token", hidden_size, initializer_range)
    wrong = F.raise_error(F.concat(F.lit("vector size differs for "), F.col("token")))
    kept = F.when(F.size("_old") == hidden_size, F.col("_old")).otherwise(wrong.cast("array<float>"))
    return (
        vocab.select("token_id", "token")
        .join(old, "token", "left")
        .select(
            "token_id",
            "token",
            F.col("_old").isNotNull().alias("copied"),
            F.when(F.col("_old").isNull(), drawn).otherwise(kept).alias("embedding"),
        )
    )


def lookup_vectors(
    rows: DataFrame,
    ids: str,
    vectors: DataFrame,
    out: str = "embeddings",
    made: Made | None = None,
) -> DataFrame:
    """id, `ids` and `out`: the vector of every id in order, null where there is none; or what is
    `made` of these, where they are put together.

    One way for matrices of any size: every chunk of rows asks for the vectors of its distinct ids.
    Chunks are the smaller the longer the vectors.
    """
    length = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    pairs = vectors.select(F.col("token_id").cast("int").alias("_key"), F.col("embedding").alias("_value"))
    asked = Asked(F.col(ids).cast("array<int>"), pairs, out, made)
    return with_answers(rows.select("id", ids), [asked], max(16, min(2048, _CHUNK_NUMBERS // length)))


def exclude_special(vectors: DataFrame, special: Sequence[str]) -> DataFrame:
    """Vectors of proper tags only."""
    return vectors.where(~F.col("token").isin(*special))
