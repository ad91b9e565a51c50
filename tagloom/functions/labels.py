"""Training labels over token-id arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.constants import IGNORE_LABEL, MASK_RATE, MAX_LENGTH
from tagloom.functions.draws import PRIME, positional_sql
from tagloom.functions.text import held


def _ignore() -> Column:
    return F.lit(IGNORE_LABEL)


def pad_or_truncate(ids: Column, pad_id: int, length: int = MAX_LENGTH) -> Column:
    """Exactly `length` ids: cut on the right, or filled up with the pad id."""
    kept = F.slice(ids, 1, length)
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(kept, F.array_repeat(F.lit(pad_id), missing))


def causal_labels(ids: Column, pad_id: int) -> Column:
    """The ids themselves, padding ignored."""
    return F.transform(ids, lambda x: F.when(x == pad_id, _ignore()).otherwise(x))


def completion_labels(ids: Column, input_end_id: int, pad_id: int) -> Column:
    """Only ids after the last end-of-input mark count; without the mark none do."""
    from_end = F.array_position(F.reverse(ids), F.lit(input_end_id))
    end = F.when(from_end > 0, F.size(ids) - from_end).otherwise(F.size(ids))

    def labels(end: Column) -> Column:
        return F.transform(
            ids, lambda x, i: F.when((i <= end) | (x == pad_id), _ignore()).otherwise(x)
        )

    # Held in a one-item array, or Spark would look for the mark again at every position.
    return F.get(F.transform(F.array(end), labels), F.lit(0))


def masked_token_labels(
    ids: str,
    special_ids: Sequence[int],
    mask_id: int,
    vocab_size: int,
    seed: int,
    key: str = "id",
    rate: float = MASK_RATE,
) -> Column:
    """Struct (input_ids, labels) for masked-token training.

    Each non-special id is chosen with probability `rate`; of the chosen, 80 % become the mask,
    10 % a random id, 10 % stay. One draw per position decides all three.
    """
    special = [F.lit(i) for i in special_ids]
    drawn = F.expr(positional_sql(ids, seed, "mask", key))

    def one(s: Column) -> Column:
        x = s["item"]
        u = s["k"] / F.lit(float(PRIME))
        # Among the chosen, u / rate is again uniform; its ninth tenth is spread over the ids.
        how = u / F.lit(rate)
        other = F.floor((how - 0.8) / 0.1 * vocab_size).cast("int")
        changed = (
            F.when(how < 0.8, F.lit(mask_id))
            .when(how < 0.9, F.least(other, F.lit(vocab_size - 1)))
            .otherwise(x)
        )
        chosen = (u < rate) & ~x.isin(*special)
        return F.struct(
            F.when(chosen, changed).otherwise(x).alias("input_id"),
            F.when(chosen, x).otherwise(_ignore()).alias("label"),
        )

    def both(pairs: Column) -> Column:
        return F.struct(
            F.transform(pairs, lambda p: p["input_id"]).alias("input_ids"),
            F.transform(pairs, lambda p: p["label"]).alias("labels"),
        )

    return held(F.transform(drawn, one), both)
