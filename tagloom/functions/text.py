"""Tag-string expressions: blank test, splitting, normalising, year of an ISO date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes. Java's \s alone knows only the ASCII ones.
_WIDE_SPACES = r"\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = r"\s\u001c-\u001f" + _WIDE_SPACES
SEPARATOR = ", "
TOKEN_SEPARATOR = rf",[\s{_WIDE_SPACES}]*"


def has_text(text: Column) -> Column:
    """True where the text is not null and holds more than white space."""
    return text.isNotNull() & text.rlike(f"[^{WHITESPACE}]")


def held(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)` with the value computed once, however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def or_empty(text: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(text, F.lit(""))


def split_tags(text: Column) -> Column:
    """Split on comma and blank; the empty string gives one empty tag."""
    return F.split(text, SEPARATOR)


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, SEPARATOR)


def tag_count(text: Column) -> Column:
    """How many tags a string lists; null counts as none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(split_tags(text)))


def _plain_commas(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(SEPARATOR), F.lit(","))


def wide_commas(text: Column) -> Column:
    """True where some comma has other white space after it than one blank."""
    return _plain_commas(text).rlike(rf",[\s{_WIDE_SPACES}]")


def tokenize(text: Column) -> Column:
    """Lower-case and cut at commas with any white space after them; empty pieces vanish."""
    lowered, plain = F.lower(text), _plain_commas(text)
    # Most texts have no other white space after a comma than one blank. Spark compiles a pattern
    # anew for every text it splits, but not a plain comma.
    pieces = F.when(wide_commas(text), F.split(lowered, TOKEN_SEPARATOR))
    return F.array_remove(pieces.otherwise(F.split(plain, ",")), "")


def iso_year(created_at: Column) -> Column:
    """Year as written, so the date keeps its own offset. Null where it is no number."""
    return F.substring(created_at, 1, 4).try_cast("int")
