"""Posts, vocabulary, clusters and vectors derived from the driver's tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.encode import Encoder, encoder
from tagloom.operators.lookup import TagTable, tag_table
from tagloom.operators.organize import TagGroups, cluster_key
from tagloom.operators.vectors import known_vectors, tag_vectors
from tagloom.operators.vocabulary import VocabularyParams, build_vocabulary
from tagloom.schemas import POSTS
from tagloom.sources.staging import shared_folder, staged

GROUPS = TagGroups(
    people=("economy", "large", "medium", "promo", "small", "standard"),
    focus=("flag a", "flag n", "flag r"),
    watermark=("line 7",),
    artistic_error=("line 6",),
)
SCORE_FLOORS = (("g", 20), ("s", 20), ("q", 25), ("e", 30))
CALIBRATION_FLOORS = (("g", 60), ("s", 62), ("q", 70), ("e", 75))
FIRST_YEAR = 1998
TEST_SHARE = 50
STRICT_CLUSTERS = 5


def derive_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per order, its tags taken from the order's lines."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def sorted_text(tags: Column) -> Column:
        return F.array_join(F.sort_array(tags), ", ")

    # The narrow sides are hashed, so that no wide rows are sorted or moved twice.
    parts = table("part").select(
        "p_partkey", "p_name", F.lower("p_type").alias("type"), F.lower("p_brand").alias("brand")
    )
    lines = table("lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.concat(F.lit("flag "), F.lower("l_returnflag")).alias("flag"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("line"),
    )
    named = lines.join(parts.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    listed = named.groupBy("l_orderkey").agg(
        F.collect_list(F.struct("p_name", "type", "flag", "line", "brand")).alias("lines")
    )
    general = F.flatten(F.array(*(F.col(f"lines.{n}") for n in ("p_name", "type", "flag", "line"))))
    tags = listed.select(
        "l_orderkey",
        sorted_text(general).alias("general"),
        sorted_text(F.col("lines.brand")).alias("copyright"),
    )
    key = F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    customers = table("customer").select("c_custkey", "c_name").hint("shuffle_hash")
    orders = (
        table("orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .hint("shuffle_hash")
    )
    return (
        orders.join(tags, key == F.col("l_orderkey"), "left")
        .select(
            key.alias("id"),
            "general",
            F.when(F.col("o_orderstatus") != "P", F.lower("c_name")).alias("character"),
            "copyright",
            F.when(priority == "1-URGENT", "e")
            .when(priority == "2-HIGH", "q")
            .when(priority == "3-MEDIUM", "s")
            .otherwise("g")
            .alias("rating"),
            F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"),
            (key * 37 % 1793 + 256).cast("int").alias("image_width"),
            (key * 101 % 1793 + 256).cast("int").alias("image_height"),
            F.concat(
                F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.000-05:00")
            ).alias("created_at"),
        )
    )


class Corpus:
    """The derived tables of one directory. Posts and vocabulary are written once and read back:
    they are what every job starts from, as columns to prune and filters to push down."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def posts(self) -> DataFrame:
        return staged(derive_posts(self.spark, self.sf_dir), "posts", POSTS)

    @cached_property
    def n_posts(self) -> int:
        return self.posts.count()

    @property
    def test_size(self) -> int:
        return self.n_posts // TEST_SHARE

    @property
    def min_count(self) -> dict[str, int]:
        """Thresholds that grow with the corpus: 6 % and an eighth of the posts; 8 posts."""
        n = self.n_posts
        return {"general": -(-6 * n // 100), "copyright": -(-n // 8), "character": 8}

    def vocabulary_params(
        self, special: str = "main", kinds: tuple[str, ...] = ("general", "copyright", "character")
    ) -> VocabularyParams:
        return VocabularyParams(special, kinds, {k: self.min_count[k] for k in kinds})

    @cached_property
    def vocab(self) -> DataFrame:
        return staged(build_vocabulary(self.posts, self.vocabulary_params()), "vocab")

    @cached_property
    def encoder(self) -> Encoder:
        return encoder(self.vocab)

    @property
    def vectors(self) -> DataFrame:
        """Token i of the vocabulary has vector i."""
        return known_vectors(self.all_vectors)

    @property
    def all_vectors(self) -> DataFrame:
        """Tokens without a vector have null."""
        embeddings = self.table("embeddings").select(
            F.col("vec_id").cast("int").alias("token_id"), "embedding"
        )
        return tag_vectors(self.vocab, embeddings)

    def folder(self, name: str) -> str:
        """A new folder that all executors share."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    @property
    def cluster_map(self) -> DataFrame:
        """level, token, cluster_id of every token with a vector."""
        labels = self.table("embeddings").select(
            F.col("vec_id").cast("int").alias("token_id"), "label"
        )
        labeled = self.vocab.select("token_id", "token", "cnt").join(labels, "token_id")

        def at(level: str, cluster_id: Column) -> Column:
            return F.struct(F.lit(level).alias("level"), cluster_id.alias("cluster_id"))

        lax, strict = F.col("label"), F.col("label") % STRICT_CLUSTERS
        both = F.inline(F.array(at("lax", lax), at("strict", strict)))
        return labeled.select("token", "cnt", both)

    @cached_property
    def joined_encoder(self) -> Encoder:
        """As a vocabulary too large for a literal is treated."""
        return encoder(self.vocab, max_entries=0)

    @property
    def _keyed_clusters(self) -> DataFrame:
        return self.cluster_map.withColumn("key", cluster_key(F.col("level"), F.col("token")))

    @cached_property
    def clusters(self) -> TagTable:
        return tag_table(self._keyed_clusters, "key", "cluster_id")

    @cached_property
    def joined_clusters(self) -> TagTable:
        return tag_table(self._keyed_clusters, "key", "cluster_id", max_entries=0)


_corpora: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a directory, kept for as long as the Spark application lives."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _corpora:
        _corpora[key] = Corpus(spark, sf_dir)
    return _corpora[key]
