"""One table of counts from one scan of the posts; all statistics of the corpus come from it.

Summaries add up: that of new posts, merged with a stored one, is the summary of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import split_tags, tag_count
from tagloom.operators.vocabulary import FIELDS, first_place

#: metric, the group it is counted in, the value counted, n, and where a tag was first seen.
SUMMARY = "metric string, grp string, value string, n bigint, first decimal(38,0)"
RATING, SCORE, LENGTH, TAG = "rating", "score", "length", "tag"


def summarize(posts: DataFrame) -> DataFrame:
    """metric, grp, value, n, first of all posts."""
    nothing = F.lit(None).cast("decimal(38,0)")

    def row(metric: str, group: Column, value: Column, first: Column = nothing) -> Column:
        return F.struct(F.lit(metric).alias("metric"), group.alias("grp"), value.alias("value"), first.alias("first"))

    def tags(field: str) -> Column:
        return F.transform(
            F.coalesce(split_tags(F.col(field)), F.array().cast("array<string>")),
            lambda tag, at: row(TAG, F.lit(field), tag, first_place(F.col("id"), at)),
        )

    one_each = F.array(
        row(RATING, F.lit(""), F.col("rating")),
        row(SCORE, F.col("rating"), F.col("score").cast("string")),
        row(LENGTH, F.lit("general"), tag_count(F.col("general")).cast("string")),
    )
    rows = posts.select(F.explode(F.concat(one_each, *(tags(field) for field in FIELDS))).alias("r")).select("r.*")
    return _added(rows.withColumn("n", F.lit(1).cast("bigint")))


def merged(*summaries: DataFrame) -> DataFrame:
    """The summary of all posts that the given ones are of."""
    every = summaries[0]
    for other in summaries[1:]:
        every = every.unionByName(other)
    return _added(every)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric", "grp", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _of(summary: DataFrame, metric: str) -> DataFrame:
    return summary.where(F.col("metric") == metric)


def rating_counts(summary: DataFrame) -> DataFrame:
    """rating, n."""
    return _of(summary, RATING).select(F.col("value").alias("rating"), "n")


def score_counts(summary: DataFrame) -> DataFrame:
    """rating, score, n: the base of the order statistics of `stats`."""
    scored = _of(summary, SCORE).where("value is not null")
    return scored.select(F.col("grp").alias("rating"), F.col("value").cast("int").alias("score"), "n")


def tags_per_post(summary: DataFrame) -> DataFrame:
    """n_tags, n_posts."""
    return _of(summary, LENGTH).select(F.col("value").cast("int").alias("n_tags"), F.col("n").alias("n_posts"))


def tag_counts(summary: DataFrame) -> DataFrame:
    """field, tag, cnt, first_seen."""
    return _of(summary, TAG).select(
        F.col("grp").alias("field"), F.col("value").alias("tag"), F.col("n").alias("cnt"), F.col("first").alias("first_seen")
    )
