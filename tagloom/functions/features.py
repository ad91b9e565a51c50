"""Tokens that describe a post: aspect ratio, length, rating.

Arguments are column names or SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.constants import COARSE_RATING, EXACT_RATING, LENGTH_BOUNDS, LENGTH_OPEN
from tagloom.functions.draws import uniform


def aspect_ratio_token(width: str = "image_width", height: str = "image_height") -> Column:
    """Class of width / height; null where the height is zero."""
    ratio = f"try_divide(cast({width} as double), cast({height} as double))"
    return F.expr(
        f"""case
        when {ratio} <= 1D / 2 then '<|aspect_ratio:ultra_tall|>'
        when {ratio} <= 8D / 9 then '<|aspect_ratio:tall|>'
        when {ratio} < 9D / 8 then '<|aspect_ratio:square|>'
        when {ratio} < 2D then '<|aspect_ratio:wide|>'
        when {ratio} >= 2D then '<|aspect_ratio:ultra_wide|>' end"""
    )


def length_token(n_tags: str) -> Column:
    cases = " ".join(f"when {n_tags} < {bound} then '{name}'" for bound, name in LENGTH_BOUNDS)
    return F.expr(f"case {cases} else '{LENGTH_OPEN}' end")


def _by_rating(rating: str, table: dict[str, str]) -> Column:
    cases = " ".join(f"when '{short}' then '{name}'" for short, name in table.items())
    return F.expr(f"case {rating} {cases} end")


def exact_rating(rating: str = "rating") -> Column:
    """Exact rating token; null for an unknown rating."""
    return _by_rating(rating, EXACT_RATING)


def coarse_rating(rating: str = "rating") -> Column:
    """Safe / not safe token; null for an unknown rating."""
    return _by_rating(rating, COARSE_RATING)


def fuzzy_rating(rate: float, seed: int, rating: str = "rating", key: str = "id") -> Column:
    """The coarse token with probability `rate`, else the exact one."""
    fuzzy = uniform(seed, "fuzzy_rating", key) < float(rate)
    return F.when(fuzzy, coarse_rating(rating)).otherwise(exact_rating(rating))
