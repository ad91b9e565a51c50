"""Exact duplicates by deterministic naming of blocks.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted into integer
names, then pairs of neighbouring names into new names, and so on until one name is left for each
text: two texts of as many rounds have the same last name exactly if they are equal. Block text
moves through one shuffle, combined before it; all else are numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed, keep_rows, text_key, whole_text

BLOCK_BYTES = 8192
_NO_RIGHT = -1  # in place of the right name of a last, odd block


def normalised(text: str):
    """The text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Add `name`: the place in the sorted partition, made unique by the partition's number.

    The partition is sorted, so a lost one is computed again with the same names."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, id_col: str, text: str, block_bytes: int, hash_bits: int) -> DataFrame:
    """row, id, sha, n (blocks of the text), pos, h (hash of the block), block."""
    body = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.encode(normalised(text), "UTF-8").alias("body"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.length("body") / block_bytes)).cast("int")
    cut = body.select(
        "row", "id", F.unhex(F.sha2("body", 256)).alias("sha"), count.alias("n"),
        F.posexplode(F.sequence(F.lit(0), count - 1)).alias("pos", "_"), "body",
    )
    start = (F.col("pos") * block_bytes + 1).cast("int")
    whole = cut.select("row", "id", "sha", "n", "pos", F.substring("body", start, F.lit(block_bytes)).alias("block"))
    return whole.withColumn("h", F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block"))


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """row, id, sha, n, pos, name.

    Blocks are joined to their names by hash, so they don't move again. A hash that two different
    blocks share is found as its least block differs from its greatest; such blocks, if any, are
    named and joined by their bytes.
    """
    per_hash = blocks.groupBy("h").agg(F.min("block").alias("block"), F.max("block").alias("last"))
    named = _numbered(per_hash, "block").select("h", "name", (F.col("block") != F.col("last")).alias("shared"))
    named = checkpointed(named)
    found = blocks.join(named, "h")
    columns = ["row", "id", "sha", "n", "pos", "name"]
    shared = named.where("shared").select("h")
    if shared.isEmpty():
        return found.select(columns)
    rest = blocks.join(shared, "h", "left_semi").select("h", "block").distinct()
    # Names below _NO_RIGHT are free.
    rest = checkpointed(_numbered(rest, "h", "block").withColumn("name", _NO_RIGHT - 1 - F.col("name")))
    late = blocks.join(rest, ["h", "block"])
    return found.where("not shared").select(columns).union(late.select(columns))


def _halved(pieces: DataFrame) -> DataFrame:
    """The pieces with every two neighbours of a text under one new name."""
    odd = F.col("pos") % 2 == 1
    pairs = pieces.groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
        F.max("n").alias("n"),
        F.max(F.when(~odd, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(_NO_RIGHT)).alias("right"),
    )
    names = _numbered(pairs.select("left", "right").distinct(), "left", "right")
    found = pairs.join(names, ["left", "right"])
    return found.select("row", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after every run of white space became one space; null counts
    as empty, and empty texts are equal. Of equal texts the row with the smallest id is kept, null
    ids last; of repeated rows exactly one, so kept is true once per group. An empty table stays
    empty. A text of any length takes as many rounds as the logarithm of its blocks; groups of any
    size are only counted before the shuffle or joined, never gathered. `hash_bits` is for tests.
    """
    blocks = _blocks(docs, id_col, text, block_bytes, hash_bits)
    pieces = checkpointed(_named_blocks(blocks))
    rows = pieces.where("pos = 0").select("row", "id", "sha", "n")
    longest = pieces.agg(F.max("n")).first()[0] or 1
    depth, now = 0, pieces.select("row", "n", "pos", "name")
    named = now.where("n = 1").select("row", F.lit(0).alias("depth"), "name")
    while longest > 1:
        now = checkpointed(_halved(now.where("n > 1")))
        depth, longest = depth + 1, (longest + 1) // 2
        named = named.union(now.where("n = 1").select("row", F.lit(depth).alias("depth"), "name"))
    identified = checkpointed(rows.join(named, "row"))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    groups = identified.groupBy("depth", "name").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    both = identified.join(groups, ["depth", "name"])
    return both.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that exact_duplicates drops, columns as they are.

    Of repeated rows with a kept id and equal text one stays.
    """
    kept = exact_duplicates(docs, id_col, text).where("kept")
    as_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keys = kept.select(F.unhex(F.sha2(F.encode(F.concat_ws(" ", "text_sha256", as_text), "UTF-8"), 256)))
    key = text_key(normalised(text), F.col(f"`{id_col}`"))
    return keep_rows(docs, key, keys, one_each=True)
