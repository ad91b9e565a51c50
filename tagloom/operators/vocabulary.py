"""Counting tags and numbering the popular ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import SPECIAL_TOKENS
from tagloom.functions.text import split_tags
from tagloom.sources.staging import staged

FIELDS = ("general", "copyright", "character")
# Places within a post are below 2^32, as arrays have no more items.
_POSITIONS = 1 << 32
# Of the numbers Spark gives rows, the lower bits are the place within a partition.
_PLACE_BITS = 33


def _popular_defaults() -> dict[str, int]:
    return {"general": 200, "copyright": 100, "character": 100}


@dataclass(frozen=True)
class VocabularyParams:
    """Special tokens, order of the tag kinds, and how often a tag must occur."""

    special: str = "main"
    kinds: tuple[str, ...] = FIELDS
    min_count: dict[str, int] = field(default_factory=_popular_defaults)


MAIN = VocabularyParams()
ENCODE = VocabularyParams("encode", ("general", "character", "copyright"))
MASKED = VocabularyParams("masked", ("general",), {"general": 1000})


def first_place(id_: Column, pos: Column) -> Column:
    """A number that orders places by post, then by position."""
    return (id_.cast("decimal(20,0)") * F.lit(_POSITIONS) + pos).cast("decimal(38,0)")


def tag_counts(posts: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field, tag, cnt, first_seen for every tag, all fields in one pass.

    first_seen orders tags by the post (then the place) of their first appearance: id * 2^32 +
    position, exact for every id. One decimal instead of a struct keeps the aggregation hashed and
    combined before the shuffle.
    """
    pairs = ", ".join(f"'{name}', `{name}`" for name in fields)
    stacked = posts.select("id", F.expr(f"stack({len(fields)}, {pairs}) as (field, text)"))
    exploded = stacked.where(F.col("text").isNotNull()).select(
        "id", "field", F.posexplode(split_tags(F.col("text"))).alias("pos", "tag")
    )
    seen = first_place(F.col("id"), F.col("pos"))
    return exploded.groupBy("field", "tag").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(seen).alias("first_seen")
    )


def most_frequent_first(counts: DataFrame) -> DataFrame:
    """Tags by falling count; equal counts keep the order of first appearance."""
    return counts.orderBy("field", F.col("cnt").desc(), "first_seen", "tag")


def popular(counts: DataFrame, min_count: dict[str, int]) -> DataFrame:
    """The counted tags that occur at least as often as their field demands."""
    keep = F.lit(False)
    for name, least in min_count.items():
        keep = keep | ((F.col("field") == name) & (F.col("cnt") >= least))
    return counts.where(keep)


def special_rows(spark: SparkSession, variant: str) -> DataFrame:
    """token_id, token, kind of the special tokens."""
    tokens = F.array(*[F.lit(t) for t in SPECIAL_TOKENS[variant]])
    return spark.range(1).select(F.posexplode(tokens).alias("token_id", "token")).select(
        "token_id", "token", F.lit("special").alias("kind"), F.lit(None).cast("bigint").alias("cnt")
    )


def _kind_rank(kinds: Sequence[str]) -> Column:
    rank = None
    for i, kind in enumerate(kinds):
        hit = F.col("field") == kind
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    return rank


def number_tokens(counts: DataFrame, kinds: Sequence[str], first_id: int) -> DataFrame:
    """Ids by kind, then count (most first), then first appearance.

    The tags are sorted once into ranges, one per task, and written as they lie; each knows its
    place in its range. A prefix sum over the sizes of the ranges, of which there are as many as
    shuffle partitions, gives where each range starts.
    """
    wanted = counts.where(F.col("field").isin(*kinds))
    order = [_kind_rank(kinds), F.col("cnt").desc(), "first_seen", "tag"]
    spark = counts.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row is its range times 2^33 and its place in there.
    placed = wanted.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()
    )
    stored = staged(placed, "numbered")
    within = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    in_range = F.shiftrightunsigned("_at", _PLACE_BITS)
    sizes = dict(stored.groupBy(in_range.alias("range")).count().collect())
    start, starts = first_id, []
    for number in range(max(sizes, default=-1) + 1):
        starts.append(start)
        start += sizes.get(number, 0)
    offset = F.get(F.lit(starts or [0]), in_range.cast("int"))
    return stored.select(
        (offset + within).cast("int").alias("token_id"), F.col("tag").alias("token"), F.col("field").alias("kind"), "cnt"
    )


def build_vocabulary(posts: DataFrame, params: VocabularyParams = MAIN) -> DataFrame:
    """token_id, token, kind, cnt: special tokens first, then the popular tags of each kind.

    A tag of two kinds, or one that is also a special token, is an error.
    """
    counts = popular(tag_counts(posts, params.kinds), params.min_count)
    numbered = number_tokens(counts, params.kinds, len(SPECIAL_TOKENS[params.special]))
    return check_unique(special_rows(posts.sparkSession, params.special).unionByName(numbered))


def duplicate_tokens(vocab: DataFrame) -> DataFrame:
    """Tokens listed more than once: a vocabulary with any is unusable."""
    return (
        vocab.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("kind")).alias("kinds"))
        .where(F.col("n") > 1)
    )


def check_unique(vocab: DataFrame) -> DataFrame:
    """The vocabulary itself, or an error naming some of its duplicate tokens."""
    found = [row["token"] for row in duplicate_tokens(vocab).select("token").limit(10).collect()]
    if found:
        raise ValueError(f"duplicate tokens: {found}")
    return vocab


def unreachable_tokens(vocab: DataFrame) -> DataFrame:
    """Tags no text can be encoded to: encoding lowers case and cuts at every comma."""
    token = F.col("token")
    reachable = (F.lower(token) == token) & ~token.contains(",") & (token != "")
    return vocab.where((F.col("kind") != "special") & ~reachable)


def vocabulary_sizes(vocab: DataFrame) -> DataFrame:
    """How many tokens each kind has, and all together."""
    return vocab.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("kind", F.lit("total")).alias("kind"), "n"
    )
