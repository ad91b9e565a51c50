"""Corpus statistics.

Order statistics are read off counts of distinct values: those are combined before the shuffle,
so a rating that holds a third of all posts still sends one row per distinct score and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.constants import BOUNDARY_RATIOS
from tagloom.functions.text import tag_count

QUARTILES = (0.25, 0.5, 0.75)


def rating_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def tags_per_post(posts: DataFrame, column: str = "general") -> DataFrame:
    """How many posts list how many tags; a null list counts as none."""
    return posts.groupBy(tag_count(F.col(column)).alias("n_tags")).agg(
        F.count(F.lit(1)).alias("n_posts")
    )


def histogram(
    values: DataFrame,
    column: str,
    low: int,
    high: int,
    bins: int,
    by: str | None = None,
    groups: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Counts in equal bins over whole-number values; the last bin includes its right edge.

    Values outside [low, high] are left out; empty bins are kept. With `by`, one histogram per
    listed group.
    """
    value = F.col(column)
    index = F.floor((value - low) * bins / F.lit(high - low))
    bin_ = F.least(index, F.lit(bins - 1)).cast("int").alias("bin")
    keys = [F.col(by)] if by else []
    inside = values.where(value.between(low, high))
    counted = inside.groupBy(*keys, bin_).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("n")
    )
    spark = values.sparkSession
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    on = ["bin"]
    if by:
        listed = F.explode(F.array(*[F.lit(g) for g in groups])).alias(by)
        spine, on = spine.select(listed, "bin"), [by, "bin"]
    width = (high - low) / bins
    return spine.join(counted, on, "left").select(
        *on,
        (F.lit(float(low)) + F.col("bin") * F.lit(width)).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def score_counts(posts: DataFrame) -> DataFrame:
    """rating, score, n: the base of the order statistics below."""
    known = posts.where(F.col("score").isNotNull())
    return known.groupBy("rating", "score").agg(F.count(F.lit(1)).alias("n"))


def _ranked(counts: DataFrame) -> DataFrame:
    """Add first and last, the zero-based ranks a value holds in its rating, and the total."""
    per_rating = Window.partitionBy("rating")
    upto = F.sum("n").over(per_rating.orderBy("score"))
    return counts.select(
        "rating",
        "score",
        "n",
        (upto - F.col("n")).alias("first"),
        (upto - 1).alias("last"),
        F.sum("n").over(per_rating).alias("total"),
    )


def _at_rank(rank: Column) -> Column:
    """Aggregate: the score holding a rank."""
    return F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("score")))


def boundary_scores(counts: DataFrame, ratios: Sequence[float] = BOUNDARY_RATIOS) -> DataFrame:
    """Per rating the score at zero-based rank floor(total * ratio), one column per ratio."""
    return (
        _ranked(counts)
        .groupBy("rating")
        .agg(
            *[
                _at_rank(F.floor(F.col("total").cast("double") * F.lit(r))).alias(f"b{i}")
                for i, r in enumerate(ratios)
            ]
        )
    )


def quality_bands(counts: DataFrame, ratios: Sequence[float] = BOUNDARY_RATIOS) -> DataFrame:
    """rating, band, n: posts by the first boundary their score does not pass. Empty bands stay."""
    bounds = boundary_scores(counts, ratios)
    names = [f"b{i}" for i in range(len(ratios))]
    band = None
    for i, name in enumerate(names):
        hit = F.col("score") <= F.col(name)
        band = F.when(hit, i) if band is None else band.when(hit, i)
    placed = (
        counts.join(bounds, "rating")
        .groupBy("rating", band.otherwise(len(ratios)).alias("band"))
        .agg(F.sum("n").alias("n"))
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(len(ratios)))).alias("band")
    return (
        bounds.select("rating", every)
        .join(placed, ["rating", "band"], "left")
        .select("rating", "band", F.coalesce("n", F.lit(0)).alias("n"))
    )


def score_boxplot(counts: DataFrame) -> DataFrame:
    """Per rating: quartiles, the whiskers within 1.5 interquartile ranges, and what lies beyond."""
    ranked = _ranked(counts)
    sides = []
    for i, r in enumerate(QUARTILES):
        place = (F.col("total") - 1).cast("double") * F.lit(r)
        sides += [
            _at_rank(F.floor(place)).alias(f"lo{i}"),
            _at_rank(F.ceil(place)).alias(f"hi{i}"),
            F.max(place - F.floor(place)).alias(f"part{i}"),
        ]
    at = ranked.groupBy("rating").agg(F.max("total").alias("n"), *sides)

    def quartile(i: int) -> Column:
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        return low + (high - low) * F.col(f"part{i}")

    box = at.select(
        "rating",
        "n",
        *[quartile(i).alias(name) for i, name in enumerate(("q1", "median", "q3"))],
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    score, weight = F.col("score"), F.col("n_score")
    spread = (
        counts.withColumnRenamed("n", "n_score")
        .join(box, "rating")
        .groupBy("rating", "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(score >= low, score)).alias("in_low"),
            F.max(F.when(score <= high, score)).alias("in_high"),
            F.sum(F.when((score < low) | (score > high), weight).otherwise(0)).alias("outliers"),
        )
    )
    return spread.select(
        "rating",
        "n",
        "q1",
        "median",
        "q3",
        F.least(F.coalesce("in_low", "q1"), F.col("q1")).alias("whisker_low"),
        F.greatest(F.coalesce("in_high", "q3"), F.col("q3")).alias("whisker_high"),
        "outliers",
    )
