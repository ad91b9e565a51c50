"""Jobs around tag vectors: their training set, and the cluster map made from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.draws import shuffled
from tagloom.functions.text import has_text
from tagloom.operators.clean import rename_to_text
from tagloom.operators.encode import Encoder
from tagloom.operators.select import select_where
from tagloom.operators.split import split_once
from tagloom.operators.vectors import train_clusters
from tagloom.sources.revisions import Dataset


@dataclass(frozen=True)
class VectorSetParams:
    shuffle: bool = True
    longer_than: int = 10
    test_size: int = 10_000
    seed: int = 12345


def vector_rows(posts: DataFrame, encoder: Encoder, params: VectorSetParams) -> DataFrame:
    """id, ids of the known general tags in order, for posts with enough of them."""
    texts = rename_to_text(posts).where(has_text(F.col("text")))
    found = encoder.known_ids(texts, "text", "found")
    known = found.select("id", F.filter("found", lambda i: i.isNotNull()).alias("known"))
    return select_where(known, F.size("known") > params.longer_than, "id", "known")


def vector_set(
    posts: DataFrame, encoder: Encoder, params: VectorSetParams = VectorSetParams()
) -> DataFrame:
    """id, input_ids, split."""
    ids = shuffled("known", params.seed, "ids") if params.shuffle else F.col("known")
    rows = vector_rows(posts, encoder, params).select("id", ids.alias("input_ids"))
    return split_once(rows, params.test_size, params.seed)


def cluster_map(
    spark: SparkSession, path: str, vectors: Callable[[], DataFrame], n_clusters: int, **training
) -> DataFrame:
    """token, cluster_id: the map kept at `path`; trained and kept there first if there is none.

    It is a published revision, so a folder that a failed write left is no map. Of two that were
    trained at the same time the first one published is everybody's.
    """
    kept = Dataset(spark, path)
    if not kept.revisions():
        kept.write("clusters", {"all": train_clusters(vectors(), n_clusters, **training)})
    return kept.read_from(kept.revisions()[0], "all")
