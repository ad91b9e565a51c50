"""Splitting a post's tags into a condition and a completion, and the texts made of them.

Inputs are the columns made by `organize`: people, focus and other (a list of tag lists), plus
the copyright and character tag lists. All draws are keyed by the post id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.constants import ORIGINAL
from tagloom.functions.draws import choose, random_index, shuffled, uniform
from tagloom.functions.features import aspect_ratio_token, fuzzy_rating, length_token
from tagloom.functions.text import join_tags
from tagloom.operators.organize import TagOf, plain


@dataclass(frozen=True)
class ComposeParams:
    """Rates of the random choices."""

    fuzzy_rating_rate: float = 0.25
    drop_people_rate: float = 0.1
    condition_rates: tuple[tuple[float, float], ...] = ((0.5, 1.0),)
    augmentation_rate: float = 1.25
    # Whether an empty copyright tag counts as naming a franchise.
    empty_copyright_counts: bool = True
    seed: int = 12345


def shown_tags() -> Column:
    """The general tags that may appear in a prompt."""
    return F.concat(F.col("people"), F.col("focus"), F.flatten(F.col("other")))


def with_common_tokens(df: DataFrame, params: ComposeParams) -> DataFrame:
    """Add length_token, rating_token and aspect_token."""
    n = F.size("people") + F.size("focus") + F.size(F.flatten(F.col("other")))
    return df.withColumn("_shown", n).withColumns(
        {
            "length_token": length_token("_shown"),
            "rating_token": fuzzy_rating(params.fuzzy_rating_rate, params.seed),
            "aspect_token": aspect_ratio_token(),
        }
    ).drop("_shown")


def names_franchise(copyright: Column, character: Column, empty_counts: bool = True) -> Column:
    """Whether a post shows a known character of a known work."""

    def counts(tag: Column) -> Column:
        named = tag != ORIGINAL
        return named if empty_counts else named & (tag != "")

    return F.exists(copyright, counts) & (F.size(character) > 0)


def condition_rate(params: ComposeParams) -> Column:
    return choose(params.seed, "condition_rate", params.condition_rates)


def _augmentation(params: ComposeParams) -> Column:
    franchise = names_franchise(
        F.col("copyright_tags"), F.col("character_tags"), params.empty_copyright_counts
    )
    return F.when(franchise, F.lit(float(params.augmentation_rate))).otherwise(F.lit(1.0))


def recompose(
    df: DataFrame, params: ComposeParams, augmentation: Column | None = None
) -> DataFrame:
    """Add `condition` and `completion`, whole clusters at a time.

    People and focus tags are always condition. The first clusters join them, how many is drawn
    from 0 up to the condition rate's share; a single cluster is cut inside instead. `composable`
    is false where there is no tag left to complete.
    """
    rate = condition_rate(params) / (F.lit(1.0) if augmentation is None else augmentation)
    other = F.col("other")
    single = F.size(other) == 1
    n = F.when(single, F.size(F.get(other, F.lit(0)))).otherwise(F.size(other))
    cut = random_index(params.seed, "split", "ceil(_n * _rate)")
    counted = df.withColumns({"_n": n, "_rate": rate}).withColumn("_cut", cut)

    def part(begin: Column, length: Column) -> Column:
        within = F.slice(F.get(other, F.lit(0)), begin, length)
        across = F.flatten(F.slice(other, begin, length))
        return F.when(single, within).otherwise(across)

    lead = F.concat(F.col("people"), F.col("focus"))
    parts = counted.withColumns(
        {
            "condition": F.concat(lead, part(F.lit(1), F.col("_cut"))),
            "completion": part(F.col("_cut") + 1, F.col("_n")),
            "composable": F.col("_n") > 0,
        }
    ).drop("_n", "_rate", "_cut")
    largest = max(rate for rate, _ in params.condition_rates)
    if largest <= 1.0 and params.augmentation_rate >= 1.0:
        return parts
    # Only rates above one can leave nothing to complete; then all becomes completion.
    spent = ~single & (F.size("completion") == 0)
    return parts.withColumns(
        {
            "condition": F.when(spent, F.slice("condition", 1, 0)).otherwise(F.col("condition")),
            "completion": F.when(spent, F.col("condition")).otherwise(F.col("completion")),
        }
    )


def _arranged(df: DataFrame, params: ComposeParams) -> DataFrame:
    """Shuffle the condition, the copyright and the character tags; sort the completion."""

    def mixed(column: str) -> Column:
        return shuffled(column, params.seed, column)

    return df.withColumns(
        {
            "condition": mixed("condition"),
            "completion": F.sort_array("completion"),
            "copyright_tags": mixed("copyright_tags"),
            "character_tags": mixed("character_tags"),
        }
    )


def condition_keeping_identity(df: DataFrame, params: ComposeParams) -> DataFrame:
    """Cluster-wise condition; posts of known characters get a smaller one."""
    return _arranged(recompose(df, params, _augmentation(params)), params)


def condition_free(df: DataFrame, params: ComposeParams) -> DataFrame:
    """Condition drawn tag by tag; people and focus tags now and then must be completed."""
    mixed = shuffled("flatten(other)", params.seed, "other")
    drop = uniform(params.seed, "drop_people") < float(params.drop_people_rate)
    lead = F.concat(F.col("people"), F.col("focus"))
    nothing = F.slice(F.col("people"), 1, 0)
    cut = (
        df.withColumn("_mixed", mixed)
        .withColumns({"_n": F.size("_mixed"), "_rate": condition_rate(params), "_drop": drop})
        .withColumn("_share", F.col("_n") * F.col("_rate") / _augmentation(params))
        .withColumn("_cut", random_index(params.seed, "split", "ceil(_share)"))
    )
    parts = cut.withColumns(
        {
            "condition": F.concat(
                F.slice(F.col("_mixed"), F.lit(1), F.col("_cut")),
                F.when(F.col("_drop"), nothing).otherwise(lead),
            ),
            "completion": F.concat(
                F.slice(F.col("_mixed"), F.col("_cut") + 1, F.col("_n")),
                F.when(F.col("_drop"), lead).otherwise(nothing),
            ),
            "composable": F.col("_n") > 0,
        }
    ).drop("_mixed", "_n", "_rate", "_share", "_cut", "_drop")
    return _arranged(parts, params)


def plain_condition(df: DataFrame) -> DataFrame:
    """No condition; every list sorted."""
    return df.withColumns(
        {
            "condition": F.slice(F.col("people"), 1, 0),
            "completion": F.sort_array(shown_tags()),
            "copyright_tags": F.sort_array("copyright_tags"),
            "character_tags": F.sort_array("character_tags"),
            "composable": F.lit(True),
        }
    )


def with_component_texts(df: DataFrame, tag_of: TagOf = plain) -> DataFrame:
    """Add the four tag lists as texts: copyright_text, character_text, condition_text,
    completion_text."""

    def text(column: str, of: TagOf) -> Column:
        return join_tags(of(F.col(column)))

    return df.withColumns(
        {
            "copyright_text": text("copyright_tags", plain),
            "character_text": text("character_tags", plain),
            "condition_text": text("condition", tag_of),
            "completion_text": text("completion", tag_of),
        }
    )


def components_plain(df: DataFrame, params: ComposeParams, tag_of: TagOf = plain) -> DataFrame:
    return with_component_texts(plain_condition(with_common_tokens(df, params)), tag_of)


def components_keeping_identity(
    df: DataFrame, params: ComposeParams, tag_of: TagOf = plain
) -> DataFrame:
    common = with_common_tokens(df, params)
    return with_component_texts(condition_keeping_identity(common, params), tag_of)


def components_free(df: DataFrame, params: ComposeParams, tag_of: TagOf = plain) -> DataFrame:
    return with_component_texts(condition_free(with_common_tokens(df, params), params), tag_of)


def identity_level(
    rates: Sequence[tuple[str, float]], seed: int
) -> Column:
    """How closely the completion must keep to the condition's character."""
    return choose(seed, "identity", rates)
