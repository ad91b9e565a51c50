"""Prompt texts, and the reverse: cutting a token list back into sections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom import constants as C
from tagloom.functions.text import held, strip


def _head(copyright: Column, character: Column, rating: Column, aspect: Column, length: Column):
    return [
        F.lit(C.BOS + C.COPYRIGHT_START),
        copyright,
        F.lit(C.COPYRIGHT_END + C.CHARACTER_START),
        character,
        F.lit(C.CHARACTER_END),
        rating,
        aspect,
        length,
        F.lit(C.GENERAL_START),
    ]


def pretrain_prompt(
    copyright: Column,
    character: Column,
    rating: Column,
    aspect: Column,
    length: Column,
    completion: Column,
) -> Column:
    return F.concat(
        *_head(copyright, character, rating, aspect, length),
        completion,
        F.lit(C.GENERAL_END + C.EOS),
    )


def finetune_prompt(
    copyright: Column,
    character: Column,
    rating: Column,
    aspect: Column,
    length: Column,
    condition: Column,
    identity: Column,
    completion: Column,
) -> Column:
    return F.concat(
        *_head(copyright, character, rating, aspect, length),
        condition,
        identity,
        F.lit(C.INPUT_END),
        completion,
        F.lit(C.GENERAL_END + C.EOS),
    )


def inference_prompt(
    layout: Column,
    copyright: Column,
    character: Column,
    general: Column,
    rating: Column,
    aspect: Column,
    length: Column,
    identity: Column,
) -> Column:
    """An open prompt to be continued; every layout but `pretrain` ends the input part."""
    open_prompt = F.concat(
        *_head(strip(copyright), strip(character), rating, aspect, length), strip(general)
    )
    return F.when(layout == "pretrain", open_prompt).otherwise(
        F.concat(open_prompt, identity, F.lit(C.INPUT_END))
    )


def cut_sections(tokens: Column, end_marks: Sequence) -> Column:
    """Struct part_0 .. part_n-1: the runs before each end mark, marks taken in turn.

    A part is null when its mark, or one before it, is missing.
    """

    def after(starts: Column, mark: Column) -> Column:
        begin = F.element_at(starts, -1)
        at = F.array_position(F.slice(tokens, begin, F.size(tokens)), mark).cast("int")
        return F.concat(starts, F.array(begin + at))

    def cut(starts: Column) -> Column:
        def part(i: int) -> Column:
            begin, end = F.get(starts, F.lit(i)), F.get(starts, F.lit(i + 1))
            found = reduce(Column.__and__, (F.get(starts, F.lit(j + 1)) > F.get(starts, F.lit(j)) for j in range(i + 1)))
            return F.when(found, F.slice(tokens, begin, end - begin - 1)).alias(f"part_{i}")

        return F.struct(*(part(i) for i in range(len(end_marks))))

    # Each start builds on the one before; written out, every one would compute all earlier ones
    # several times over. A start that does not move tells that its mark is missing.
    marks = F.array(*(F.lit(m) for m in end_marks))
    return held(F.aggregate(marks, F.array(F.lit(1)), after), cut)


def reorder_sections(
    rating: Column,
    copyright: Column,
    character: Column,
    general: Column,
    people: Sequence,
) -> Column:
    """People tags, character, copyright, the other general tags, rating."""
    in_people = [F.lit(p) for p in people]
    return F.concat(
        F.filter(general, lambda t: t.isin(*in_people)),
        character,
        copyright,
        F.filter(general, lambda t: ~t.isin(*in_people)),
        rating,
    )


def plain_rating_words(text: Column) -> Column:
    """The one rating word that is written without its prefix."""
    return F.replace(text, F.lit("rating:nsfw"), F.lit("nsfw"))
