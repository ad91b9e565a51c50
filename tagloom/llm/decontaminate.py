"""Benchmark passages in training documents, by n-grams of normalised words.

The windows of the benchmark are broadcast under a hash of some of their words; all windows of
the documents are looked up, and hits are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ascii_lower, keep_rows, text_key, whole_text

WINDOW = 13
#: Words of benchmark text whose windows may be broadcast, some 100 MB; beyond it they are joined
#: by shuffling.
MAX_BROADCAST_WORDS = 200_000
_PROBES = 5
_PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Lower-cased words: digits, letters and all beyond ASCII; none for null."""
    return F.filter(F.split(ascii_lower(whole_text(text)), _PARTING), lambda w: w != "")


def _key(array: str, start: Column, length: Column) -> Column:
    """Hash of a window's length and of words spread over it."""
    at = [F.get(F.col(array), (start + F.floor(length - 1) * i / (_PROBES - 1)).cast("int")) for i in range(_PROBES)]
    return F.xxhash64(length, *at)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """key, len, window (words), items (the ids that hold it, as strings)."""
    split = benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("words"))
    split = split.withColumn("n", F.size("words")).where("n > 0")
    length = F.least(F.lit(size), F.col("n"))
    at = split.select("item", "words", length.alias("len"), F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("i"))
    window = F.slice("words", F.col("i") + 1, F.col("len"))
    keyed = at.select(_key("words", F.col("i"), F.col("len")).alias("key"), "len", window.alias("window"), "item")
    return keyed.groupBy("key", "len", "window").agg(F.collect_set("item").alias("items"))


def _places(docs: DataFrame, id_col: str, text: str, lengths: list[int]) -> DataFrame:
    """row, id, n, words, len, i: every start of a window, and -1 once per row of docs."""
    split = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        words(text).alias("words"),
    ).withColumn("n", F.size("words"))

    def starts(length: int, lead: Column) -> Column:
        whole = F.sequence(F.lit(0), F.col("n") - length)
        return F.when(F.col("n") >= length, F.concat(lead, whole)).otherwise(lead)

    lead, none = F.array(F.lit(-1)), F.array().cast("array<int>")
    base = ["row", "id", "n", "words"]
    if len(lengths) == 1:
        return split.select(*base, F.lit(lengths[0]).alias("len"), F.explode(starts(lengths[0], lead)).alias("i"))
    ways = [
        F.struct(F.lit(m).alias("len"), starts(m, none if k else lead).alias("at"))
        for k, m in enumerate(lengths)
    ]
    each = split.select(*base, F.explode(F.array(*ways)).alias("way"))
    return each.select(*base, "way.len", F.explode("way.at").alias("i"))


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = WINDOW,
    max_broadcast_words: int = MAX_BROADCAST_WORDS,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items, items_sha256, contaminated
    and spans, the places (first word, word after the last) of windows found.

    Only SQL functions. A window is `size` words in a row; an item of fewer, but not none, is one
    window. A row is contaminated if it has hits and at least one word in 20 is hit. Null and
    empty texts have no words and no hits; items without words match nothing, items with a null
    id mark words but count as no item. Repeated rows are judged each, an empty benchmark hits
    nothing, an empty table stays empty. Very long texts are scanned whole, window by window.
    """
    lengths_of = F.collect_set(F.least(F.lit(size), F.col("n")))
    sizes = benchmark.select(F.size(words("text")).alias("n")).where("n > 0")
    facts = sizes.agg(F.sum("n").alias("words"), lengths_of.alias("lengths")).first()
    places = _places(docs, id_col, text, sorted(facts["lengths"] or [size]))
    # A row's own number, not null, where there is no window, as null keys would meet in one task.
    found = F.col("i") >= 0
    places = places.withColumn("key", F.when(found, _key("words", F.col("i"), F.col("len"))).otherwise(F.col("row")))
    seen = F.when(found, F.slice("words", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("len")))
    windows = benchmark_windows(benchmark, size)
    if (facts["words"] or 0) <= max_broadcast_words:
        joined = places.join(F.broadcast(windows), ["key", "len"], "left").withColumn("seen", seen)
    else:
        slim = places.select("row", "id", "n", "i", "len", "key", seen.alias("seen"))
        joined = slim.join(windows, ["key", "len"], "left")
    hits = joined.where((F.col("i") < 0) | (F.col("seen") == F.col("window")))
    span = F.when(found, F.struct(F.col("i").alias("start"), (F.col("i") + F.col("len")).alias("stop")))
    per_row = hits.groupBy("row", "id", "n").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(found, F.col("items")))))).alias("items"),
    )
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("reached"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["reached"], s["stop"]).alias("reached"),
            (a["hit"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["reached"], s["start"]))).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    counted = per_row.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        "spans",
    )
    much = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return counted.withColumn("contaminated", much)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, columns as they are. Whether a row is depends on
    its text alone, so rows are told apart by a hash of it, whatever their ids."""
    key = text_key(F.col(f"`{text}`").cast("string"))
    texts = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
    bad = benchmark_hits(texts, benchmark, "key").where("contaminated").select("key").distinct()
    return keep_rows(docs, key, bad, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All rows of docs, their texts without the words that are hit and what follows each of them
    up to the next word; texts without hits, null ones included, stay as they are."""
    key = text_key(F.col(f"`{text}`").cast("string"))
    texts = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
    hits = benchmark_hits(texts, benchmark, "key").where("n_hit > 0")
    cuts = hits.groupBy("key").agg(F.first("spans").alias("_spans"))
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    joined = docs.select(row.alias("_row"), key.alias("key")).join(cuts, "key", "left")
    place = docs.columns.index(text)
    whole = F.col(f"_row.c{place}")
    # Only A-Z differ between the words counted and those cut here; both part at the same places.
    pieces = F.regexp_extract_all(whole, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), 1)
    lead = F.regexp_extract(whole, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["stop"])))
    cut = F.when(F.col("_spans").isNull(), whole).otherwise(F.concat(lead, F.array_join(kept, "")))
    columns = [cut if i == place else F.col(f"_row.c{i}") for i in range(len(docs.columns))]
    return joined.select(*(c.alias(n) for c, n in zip(columns, docs.columns, strict=True)))
