"""Row filters over posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import has_text, iso_year, or_empty, split_tags


def rename_to_text(posts: DataFrame, column: str = "general") -> DataFrame:
    """Only the id and one tag column, called `text`."""
    return posts.select("id", F.col(column).alias("text"))


def with_general_tags(posts: DataFrame) -> DataFrame:
    """Posts that have general tags; missing copyright and character become empty."""
    return posts.where(has_text(F.col("general"))).withColumns(
        {name: or_empty(F.col(name)) for name in ("copyright", "character")}
    )


def above_score_floor(posts: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Posts scored above their rating's floor."""
    return posts.where(exceeds_floor(floors))


def exceeds_floor(floors: dict[str, int]) -> Column:
    """True above the floor of the rating. Plain comparisons, so they reach the scan."""
    keep = F.lit(False)
    for short, bound in floors.items():
        keep = keep | ((F.col("rating") == short) & (F.col("score") > bound))
    return keep


def from_year(posts: DataFrame, year: int) -> DataFrame:
    return posts.where(iso_year(F.col("created_at")) >= year)


def at_most(text: Column, n: int) -> Column:
    """True where a tag string lists no more than n tags."""
    return F.size(split_tags(text)) <= n


def within_caps(posts: DataFrame, copyright: int, character: int) -> DataFrame:
    """Posts listing no more copyright and character tags than allowed."""
    return posts.where(
        at_most(F.col("character"), character) & at_most(F.col("copyright"), copyright)
    )

