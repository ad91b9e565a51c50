"""Between tag strings and token ids."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import constants as C
from tagloom.functions.text import SEPARATOR, has_text, tokenize
from tagloom.operators.lookup import MAX_LITERAL_ENTRIES, TagTable, Wanted, resolve_all, tag_table

_MAX_SPECIAL = 10_000


@dataclass(frozen=True)
class Encoder:
    """A vocabulary made ready for encoding and decoding."""

    table: TagTable
    vocab: DataFrame
    special: dict[str, int]

    @property
    def unk_id(self) -> int:
        return self.special[C.UNK]

    @property
    def pad_id(self) -> int:
        return self.special[C.PAD]

    def special_id(self, token: str, among: tuple[str, ...]) -> Column:
        """Id of a special token held in a column, one of a few."""
        cases = " ".join(f"when '{name}' then {self.special[name]}" for name in among)
        return F.expr(f"case {token} {cases} end")

    def mark(self, *tokens: str) -> Column:
        """Array of the ids of fixed special tokens."""
        return F.expr(f"array({', '.join(str(self.special[t]) for t in tokens)})")

    def wanted(self, text: Column, out: str) -> Wanted:
        """The ids of a tag string in order, to be looked up along with other lists."""
        return Wanted(tokenize(text), self.table, out)

    def known_ids(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Ids of a tag string in order, null for each unknown tag."""
        return resolve_all(df, [self.wanted(F.col(text), out)])

    def encode(self, df: DataFrame, text: str, out: str = "token_ids") -> DataFrame:
        """Ids of a tag string in order, the unknown id for each unknown tag."""
        found = self.known_ids(df, text, out)
        return found.withColumn(
            out, F.transform(F.col(out), lambda i: F.coalesce(i, F.lit(self.unk_id)))
        )

    def known_tokens(self, df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
        """Array of struct (tag, token_id): the known tags in order, the unknown dropped."""
        ids = f"_{out}_ids"
        found = self.known_ids(df, text, ids)
        return found.withColumn(out, known_pairs(tokenize(F.col(text)), F.col(ids))).drop(ids)

    def reject_unknown(self, df: DataFrame, *texts: str) -> DataFrame:
        """Rows whose tag strings hold known tags only; the empty string passes."""
        ids = {text: f"_{text}_ids" for text in texts}
        found = resolve_all(df, [self.wanted(F.col(text), out) for text, out in ids.items()])
        unknown = (F.exists(F.col(out), lambda i: i.isNull()) for out in ids.values())
        return found.where(~reduce(Column.__or__, unknown)).drop(*ids.values())


def known_pairs(tags: Column, ids: Column) -> Column:
    """Array of struct (tag, token_id) of the tags that have an id."""
    pairs = F.zip_with(tags, ids, lambda t, i: F.struct(t.alias("tag"), i.alias("token_id")))
    return F.filter(pairs, lambda p: p["token_id"].isNotNull())


def encoder(vocab: DataFrame, max_entries: int = MAX_LITERAL_ENTRIES) -> Encoder:
    """Ready a vocabulary for encoding; duplicate tokens and special tokens past a bound raise."""
    named = vocab.where(F.col("kind") == "special").select("token", "token_id")
    rows = named.limit(_MAX_SPECIAL + 1).collect()
    if len(rows) > _MAX_SPECIAL:
        raise ValueError(f"more than {_MAX_SPECIAL} special tokens")
    special = {row["token"]: row["token_id"] for row in rows}
    table = tag_table(vocab, "token", "token_id", max_entries=max_entries)
    return Encoder(table, vocab, special)


def unknown_tags(posts: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """tag, n_posts of every tag the vocabulary lacks; counted first, so no key is hot."""
    pieces = posts.select("id", F.explode(F.array_distinct(tokenize(F.col(column)))).alias("tag"))
    counted = pieces.groupBy("tag").agg(F.count(F.lit(1)).alias("n_posts"))
    return counted.join(vocab.select(F.col("token").alias("tag")), "tag", "left_anti")


def decoder(
    vocab: DataFrame, skip_special: bool = True, max_entries: int = MAX_LITERAL_ENTRIES
) -> TagTable:
    """Token id -> token, without special tokens (if so wished) and without blank ones."""
    kept = vocab.where(F.col("kind") != "special") if skip_special else vocab
    names = kept.where(has_text(F.col("token")))
    return tag_table(names, "token_id", "token", "string", max_entries)


def decode(df: DataFrame, ids: str, tokens: TagTable, out: str = "text") -> DataFrame:
    """Joined tokens of an id array; ids the decoder leaves out are skipped."""
    names = f"_{out}_names"
    keys = F.transform(F.col(ids), lambda i: i.cast("string"))
    found = resolve_all(df, [Wanted(keys, tokens, names)])
    # array_join leaves out nulls.
    return found.withColumn(out, F.array_join(F.col(names), SEPARATOR)).drop(names)
