"""Prompt sets: plain ones for pretraining, condition / completion ones for fine-tuning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tagloom import constants as C
from tagloom.functions.prompts import finetune_prompt, pretrain_prompt
from tagloom.functions.text import iso_year, split_tags, tokenize, wide_commas
from tagloom.operators.clean import (
    exceeds_floor,
    with_general_tags,
    within_caps,
)
from tagloom.operators.compose import (
    ComposeParams,
    components_keeping_identity,
    components_plain,
    identity_level,
)
from tagloom.operators.encode import Encoder, known_pairs
from tagloom.operators.lookup import TagTable, Wanted, resolve_all
from tagloom.operators.organize import (
    TagGroups,
    among,
    as_one_cluster,
    by_cluster,
    by_own_cluster,
    cluster_key,
    named,
    organize_by_group,
)
from tagloom.operators.select import select_where
from tagloom.operators.split import split_once


@dataclass(frozen=True)
class Caps:
    """How many tags a post may list."""

    general: int = 100
    character: int = 10
    copyright: int = 5


@dataclass(frozen=True)
class PretrainParams:
    compose: ComposeParams = ComposeParams(fuzzy_rating_rate=0.25)
    caps: Caps = Caps()
    test_size: int = 10_000


@dataclass(frozen=True)
class FinetuneParams:
    """Floors a score must exceed, per rating; the earliest year; shares of identity levels."""

    score_floors: tuple[tuple[str, int], ...] = (("g", 1), ("s", 1), ("q", 4), ("e", 5))
    first_year: int | None = None
    identity_rates: tuple[tuple[str, float], ...] = (("lax", 0.6), ("strict", 0.4))
    compose: ComposeParams = ComposeParams(
        fuzzy_rating_rate=0.3, condition_rates=((0.75, 0.25), (0.5, 0.25), (0.25, 0.5))
    )
    caps: Caps = Caps()
    test_size: int = 10_000
    fail_fast: bool = False


FINETUNE = FinetuneParams()
CALIBRATION = FinetuneParams(
    score_floors=(("g", 14), ("s", 22), ("q", 53), ("e", 82)),
    first_year=2020,
    identity_rates=(("lax", 0.25), ("strict", 0.25), ("none", 0.5)),
    compose=ComposeParams(fuzzy_rating_rate=0.25, condition_rates=((0.5, 1.0),)),
)


def _section_keys() -> Column:
    """Every token the copyright and character sections can be cut into, in any order of tags.

    A tag with leading white space is another token at the front of its text than behind a comma.
    """

    def keys(column: str) -> Column:
        text = F.col(column)
        apart = F.concat(tokenize(text), F.flatten(F.transform(split_tags(text), tokenize)))
        # With plain commas the tags apart are those of the whole text.
        return F.when(wide_commas(text), apart).otherwise(tokenize(text))

    return F.array_distinct(F.concat(keys("copyright"), keys("character")))


def _within_caps(posts: DataFrame, caps: Caps) -> DataFrame:
    return within_caps(with_general_tags(posts), caps.copyright, caps.character)


def _kept_tokens(df: DataFrame, caps: Caps, id_of: Callable[[Column], Column]) -> DataFrame:
    """Rows whose copyright and character tags are known and whose `tokens` are within the cap,
    without the columns made along the way."""

    def unknown(column: str) -> Column:
        return F.exists(tokenize(F.col(column)), lambda t: id_of(t).isNull())

    keep = ~unknown("copyright") & ~unknown("character") & (F.size("tokens") <= caps.general)
    kept = [c for c in df.columns if c not in _ALONG]
    lists = {"copyright_tags": split_tags(F.col("copyright")), "character_tags": split_tags(F.col("character"))}
    return select_where(df.withColumns(lists), keep, *(F.col(f"`{c}`") for c in [*kept, *lists]))


_ALONG = ("_general_ids", "_section_ids", "_cluster_ids")


def _section_get(encoder: Encoder) -> Callable[[Column], Column]:
    """Id of a token of the copyright and character sections of a known post."""
    literal = encoder.table.literal
    return literal.get if literal is not None else lambda t: F.try_element_at("section_ids", t)


def known_posts(
    posts: DataFrame,
    encoder: Encoder,
    caps: Caps,
    clusters: TagTable | None = None,
    groups: TagGroups = TagGroups(),
) -> DataFrame:
    """Posts with general tags whose copyright and character tags are all known, within caps.

    Adds `tokens`, the known general tags with their ids, and the two raw tag lists. If a table is
    too large for a literal, all that will be wanted is looked up in one go: also `section_ids`,
    the ids of the section tokens, and with `clusters`, keyed by `cluster_key(level, tag)`, the
    `cluster_id` of each ungrouped token at the post's `level`.
    """
    cleaned = _within_caps(posts, caps)
    general = F.col("general")
    literal = encoder.table.literal
    if literal is not None and (clusters is None or clusters.literal is not None):
        ids = F.transform(tokenize(general), literal.get)
        found = cleaned.withColumn("tokens", known_pairs(tokenize(general), ids))
        return _kept_tokens(found, caps, literal.get)
    wanted = [
        encoder.wanted(general, "_general_ids"),
        Wanted(_section_keys(), encoder.table, "_section_ids"),
    ]
    items = {"tag": tokenize(general), "token_id": F.col("_general_ids")}
    if clusters is not None:
        grouped = [t for names in groups.disjoint().values() for t in names]

        def key(tag: Column) -> Column:
            return F.when(~among(tag, grouped), cluster_key(F.col("level"), tag))

        wanted.append(Wanted(F.transform(tokenize(general), key), clusters, "_cluster_ids"))
        items["cluster_id"] = F.col("_cluster_ids")
    found = resolve_all(cleaned, wanted)
    zipped = F.arrays_zip(*(c.alias(name) for name, c in items.items()))
    made = found.withColumns(
        {
            "tokens": F.filter(zipped, lambda t: t["token_id"].isNotNull()),
            "section_ids": F.map_from_arrays(_section_keys(), F.col("_section_ids")),
        }
    )
    return _kept_tokens(made, caps, lambda t: F.try_element_at("section_ids", t))


def clustered_posts(
    posts: DataFrame, encoder: Encoder, caps: Caps, clusters: TagTable, groups: TagGroups
) -> DataFrame:
    """Known posts with their tags in groups, and the ungrouped ones in the clusters of the
    post's `level`; only these are looked up there."""
    known = known_posts(posts, encoder, caps, clusters, groups)
    grouped = organize_by_group(known, "tokens", groups, named)
    if encoder.table.literal is not None and clusters.literal is not None:
        return by_cluster(grouped, clusters, named, F.col("level"))
    return by_own_cluster(grouped, F.col("level"))


def _ids(column: str) -> Column:
    return F.col(f"{column}.token_id")


def _head_ids(encoder: Encoder) -> list[Column]:
    return [
        encoder.mark(C.BOS, C.COPYRIGHT_START),
        F.col("_copyright_ids"),
        encoder.mark(C.COPYRIGHT_END, C.CHARACTER_START),
        F.col("_character_ids"),
        encoder.mark(C.CHARACTER_END),
        F.array(
            encoder.special_id("rating_token", C.RATING_TOKENS),
            encoder.special_id("aspect_token", C.ASPECT_RATIO_TOKENS),
            encoder.special_id("length_token", C.LENGTH_TOKENS),
        ),
        encoder.mark(C.GENERAL_START),
    ]


def _with_section_ids(df: DataFrame, encoder: Encoder) -> DataFrame:
    """Ids of the copyright and character texts as they stand in the prompt."""
    get = _section_get(encoder)

    def ids(text: str) -> Column:
        return F.transform(
            tokenize(F.col(text)),
            lambda t: F.coalesce(get(t), F.lit(encoder.unk_id)),
        )

    return df.withColumns(
        {"_copyright_ids": ids("copyright_text"), "_character_ids": ids("character_text")}
    )


def _head_texts() -> list[Column]:
    return [
        F.col(name)
        for name in (
            "copyright_text",
            "character_text",
            "rating_token",
            "aspect_token",
            "length_token",
        )
    ]


def _reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that fails, null when none does."""
    reason = None
    for name, failed in checks:
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    return reason


def _bad_tokens() -> list[tuple[str, Column]]:
    return [
        ("unknown_rating", F.col("rating_token").isNull()),
        ("no_aspect_ratio", F.col("aspect_token").isNull()),
    ]


def pretrain_rows(
    posts: DataFrame,
    encoder: Encoder,
    groups: TagGroups = TagGroups(),
    params: PretrainParams = PretrainParams(),
) -> DataFrame:
    """id, text, input_ids, reason for every post that passes the filters."""
    known = known_posts(posts, encoder, params.caps)
    organized = as_one_cluster(organize_by_group(known, "tokens", groups, named))
    composed = components_plain(organized, params.compose, named)
    ided = _with_section_ids(composed, encoder)
    ids = F.concat(
        *_head_ids(encoder), _ids("completion"), encoder.mark(C.GENERAL_END, C.EOS)
    )
    return ided.select(
        "id",
        pretrain_prompt(*_head_texts(), F.col("completion_text")).alias("text"),
        ids.alias("input_ids"),
        _reason(*_bad_tokens()).alias("reason"),
    )


def _scored(posts: DataFrame, params: FinetuneParams) -> DataFrame:
    """Recent enough, well enough scored posts; those without a known rating, score or readable
    date stay, to be reported later."""
    recent = posts
    if params.first_year is not None:
        year = iso_year(F.col("created_at"))
        recent = posts.where((year >= params.first_year) | year.isNull())
    floors = dict(params.score_floors)
    rating = F.col("rating")
    unsure = rating.isNull() | ~rating.isin(*floors) | F.col("score").isNull()
    return recent.where(exceeds_floor(floors) | unsure)


def _missing(params: FinetuneParams) -> list[tuple[str, Column]]:
    missing = [("no_score", F.col("score").isNull())]
    if params.first_year is not None:
        missing.append(("no_date", iso_year(F.col("created_at")).isNull()))
    return missing


def finetune_rows(
    posts: DataFrame,
    encoder: Encoder,
    clusters: TagTable,
    groups: TagGroups = TagGroups(),
    params: FinetuneParams = FINETUNE,
) -> DataFrame:
    """id, text, input_ids, reason and the posts' other columns for every post that passes the
    filters.

    `clusters` is keyed by `cluster_key(level, tag)`. A post whose tags cannot be organised or
    composed has a reason; with `fail_fast` it raises instead.
    """
    level = identity_level(params.identity_rates, params.compose.seed)
    leveled = _scored(posts, params).withColumn("level", level)
    organized = clustered_posts(leveled, encoder, params.caps, clusters, groups)
    composed = components_keeping_identity(organized, params.compose, named)
    cases = " ".join(f"when '{name}' then '{t}'" for name, t in C.IDENTITY_TOKEN.items())
    marked = composed.withColumn("identity_token", F.expr(f"case level {cases} end"))
    ided = _with_section_ids(marked, encoder)
    ids = F.concat(
        *_head_ids(encoder),
        _ids("condition"),
        F.array(encoder.special_id("identity_token", C.IDENTITY_TOKENS)),
        encoder.mark(C.INPUT_END),
        _ids("completion"),
        encoder.mark(C.GENERAL_END, C.EOS),
    )
    reason = _reason(
        *_bad_tokens(),
        *_missing(params),
        ("unclustered_tag", F.col("unclustered")),
        ("no_tags_to_complete", ~F.col("composable")),
    )
    if params.fail_fast:
        which = F.concat(F.lit("post "), F.col("id").cast("string"), F.lit(": "), reason)
        failure = F.raise_error(which)
        reason = F.when(reason.isNotNull(), failure.cast("string"))
    return ided.select(
        "id",
        finetune_prompt(
            *_head_texts(),
            F.col("condition_text"),
            F.col("identity_token"),
            F.col("completion_text"),
        ).alias("text"),
        ids.alias("input_ids"),
        reason.alias("reason"),
        *(c for c in posts.columns if c not in ("id", "text", "input_ids", "reason")),
    )


def accepted(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows without a reason against them; the columns asked for, by default all but the reason.
    What is not asked for is not computed."""
    wanted = columns or tuple(c for c in rows.columns if c != "reason")
    return select_where(rows, F.col("reason").isNull(), *wanted)


REASONS = (
    "unknown_rating",
    "no_aspect_ratio",
    "no_score",
    "no_date",
    "unclustered_tag",
    "no_tags_to_complete",
)


def write_accepted(rows: DataFrame, write: Callable[[DataFrame], object]) -> dict[str | None, int]:
    """Writes the accepted rows; how many failed for each reason, and under None how many did not.

    Counted while they are written: the rows are made once.
    """
    seen = Observation()
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]
    counted = rows.observe(seen, F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), *counts)
    write(accepted(counted))
    found = dict(seen.get)
    return {None: found.pop("accepted")} | found


def quarantined(rows: DataFrame) -> DataFrame:
    """Failed posts and why."""
    return select_where(rows, F.col("reason").isNotNull(), "id", "reason")


def pretrain_set(
    posts: DataFrame,
    encoder: Encoder,
    groups: TagGroups = TagGroups(),
    params: PretrainParams = PretrainParams(),
) -> DataFrame:
    """id, text, input_ids, split."""
    rows = accepted(pretrain_rows(posts, encoder, groups, params))
    return split_once(rows, params.test_size, params.compose.seed)


def finetune_set(
    posts: DataFrame,
    encoder: Encoder,
    clusters: TagTable,
    groups: TagGroups = TagGroups(),
    params: FinetuneParams = FINETUNE,
) -> DataFrame:
    """id, text, input_ids, split and the posts' other columns."""
    rows = accepted(finetune_rows(posts, encoder, clusters, groups, params))
    return split_once(rows, params.test_size, params.compose.seed)
