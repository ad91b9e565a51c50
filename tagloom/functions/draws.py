"""Random draws computed from keys.

A draw depends only on (seed, salt, key), never on partitioning, task order or retries, so a
lost executor cannot change a row that was already written.

Draws per row start from an MD5 digest. Draws per list position are mixed from one such row draw
by whole-number arithmetic, several times cheaper than a digest per position. The expressions
are given to Spark as SQL text; `key` and `items` are column names or SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A prime with no factor 5 in PRIME - 1: x -> x^5 permutes 0 .. PRIME-1, and squares fit a bigint.
PRIME = 2**31 - 1
STEP = 506952113


def digest_sql(seed: int, salt: str, *keys: str) -> str:
    texts = "".join(f", cast({key} as string)" for key in keys)
    return f"md5(concat_ws('|', '{seed}', '{salt}'{texts}))"


def _hash32_sql(seed: int, salt: str, key: str) -> str:
    return f"cast(conv(substring({digest_sql(seed, salt, key)}, 1, 8), 16, 10) as bigint)"


def _uniform_sql(seed: int, salt: str, key: str) -> str:
    return f"({_hash32_sql(seed, salt, key)} / {float(2**32)}D)"


def hash32(seed: int, salt: str, key: str = "id") -> Column:
    """A draw from 0 .. 2^32-1 as bigint."""
    return F.expr(_hash32_sql(seed, salt, key))


def uniform(seed: int, salt: str, key: str = "id") -> Column:
    """A draw from [0, 1)."""
    return F.expr(_uniform_sql(seed, salt, key))


def random_index(seed: int, salt: str, bound: str, key: str = "id") -> Column:
    """A whole number from 0 .. bound-1."""
    return F.expr(f"cast(floor({_uniform_sql(seed, salt, key)} * {bound}) as int)")


def choose(
    seed: int, salt: str, weighted: Sequence[tuple[str | float, float]], key: str = "id"
) -> Column:
    """The value whose share of [0, 1) the draw falls into, in the given order."""

    def literal(value: str | float) -> str:
        return f"'{value}'" if isinstance(value, str) else f"{float(value)!r}D"

    u = _uniform_sql(seed, salt, key)
    total = sum(weight for _, weight in weighted)
    reached, cases = 0.0, ""
    for value, weight in weighted[:-1]:
        reached += weight
        cases += f" when {u} < {reached / total!r}D then {literal(value)}"
    last = literal(weighted[-1][0])
    return F.expr(f"case{cases} else {last} end" if cases else last)


def positional_sql(items: str, seed: int, salt: str, key: str = "id") -> str:
    """Array of struct (k, item): each item with a draw k from 0 .. PRIME-1.

    Positions of one row never collide: spacing the row's draw by position, then raising it to
    the fifth power, are both one-to-one. The row draw is held in a one-item array, or Spark
    would compute it again for every position.
    """
    power = "s.k"
    for _ in range(4):
        power = f"{power} * s.k % {PRIME}"
    spaced = (
        f"transform(array({_hash32_sql(seed, salt, key)}), d -> transform({items}, (x, i) -> "
        f"named_struct('k', (d + i * {STEP}L) % {PRIME}, 'item', x)))[0]"
    )
    return f"transform({spaced}, s -> named_struct('k', {power}, 'item', s.item))"


def shuffled(items: str, seed: int, salt: str, key: str = "id") -> Column:
    """The items sorted by the draw of their position."""
    return F.expr(f"transform(sort_array({positional_sql(items, seed, salt, key)}), s -> s.item)")
