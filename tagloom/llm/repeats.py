"""Bytes covered by long strings that occur elsewhere: suffixes sorted in runs, exchanged, merged.

A window is a string of fixed length. Its anchor is the gram in it with the least hash (the first
of equal ones), so equal windows have equal anchors at the same place. Neighbouring windows of one
anchor form a stretch; only suffixes that start at anchors are sorted, some one byte in seventy.

1. Texts of the same content are one class. Classes are dealt into chunks of bounded size, written
   once, compressed, and stay where they are; twins of a class are removed whole.
2. Each chunk asks which of its anchor grams occur elsewhere, by cut hashes in sorted blocks; a
   false alarm costs time only. Grams in very many stretches are hot.
3. Stretches of repeated grams form a chunk's run: sorted by the suffix at the anchor, front-coded,
   dealt by gram. Of hot grams the windows themselves are asked for as in 2 and those that occur
   elsewhere are dealt by window, so a passage in a third of all texts is no large group.
4. A loser tree merges the runs of all chunks. Suffixes that share a gram stand together, and their
   windows are compared byte by byte. What repeats is told to the chunks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.llm.common import checkpointed, fields, text_bytes, whole_text
from tagloom.llm.suffixes import decoded, front_coded, merged

#: Bytes of text in a chunk, window starts looked at together, hashes per block, strings of a gram
#: beyond which it is hot, and bytes of front-coded strings merged by one task.
CHUNK_BYTES, PIECE_BYTES, BLOCK_HASHES, HOT_STRETCHES, MERGE_BYTES = 4 << 20, 1 << 20, 500_000, 2000, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_HASH_BITS, _REST_BYTES = 48, 6


@dataclass(frozen=True)
class Sizes:
    """Window and gram in bytes, and the bounds above."""

    window: int
    gram: int
    chunk_bytes: int
    piece_bytes: int
    block_hashes: int
    hot: int
    merge_bytes: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the 256 bytes, and powers of the base and of its inverse modulo 2^64."""
    weights = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)

    def powers(of: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, of, np.uint64)]))

    return weights, powers(_BASE), powers(pow(_BASE, -1, 2**64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: span - width], values[width - span :])


class Chunk:
    """The distinct texts of a chunk, one after the other, and their stretches."""

    def __init__(self, rows: pa.Table, sizes: Sizes) -> None:
        self.sizes = sizes
        found: dict[tuple, list] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for c1, c2, packed in zip(*(rows.column(c).to_pylist() for c in ("c1", "c2", "packed")), strict=True):
            known = found.setdefault((c1, c2), [0, None])
            known[0] += 1
            known[1] = known[1] or packed
        self.classes = sorted(found)
        self.copies = [found[c][0] for c in self.classes]
        texts = [unpack(found[c][1]) for c in self.classes]
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.raw = b"".join(texts)

    def _valid(self) -> np.ndarray:
        """Where a window may start: it ends within its text."""
        valid = np.ones(len(self.raw), dtype=bool)
        for end in self.ends.tolist():
            valid[max(0, end - self.sizes.window + 1) : end] = False
        return valid

    def stretches(self) -> None:
        """start, count (of windows), anchor (from the start), gram and name of each stretch."""
        parts = [self._piece(at, valid) for at, valid in self._pieces()]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
        self.start, self.count, self.anchor, self.gram, self.name = columns

    def _pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        valid, step = self._valid(), self.sizes.piece_bytes
        for at in range(0, len(self.raw) - self.sizes.window + 1, step):
            yield at, valid[at : min(at + step, len(self.raw) - self.sizes.window + 1)]

    def _piece(self, at: int, valid: np.ndarray) -> list[np.ndarray]:
        size, gram = self.sizes.window, self.sizes.gram
        b = np.frombuffer(self.raw, np.uint8, len(valid) + size - 1, at)
        weights, powers, inverse = _powers(self.sizes.piece_bytes + size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights[b] * powers[: len(b)])])
        n = len(b) - gram + 1
        hashed = _mixed((sums[gram:] - sums[:n]) * inverse[:n])
        placed = (hashed & ~_PLACE) | np.arange(n, dtype=np.uint64)
        anchor = (_least(placed, size - gram + 1) & _PLACE).astype(np.int64)
        # A stretch ends where the anchor changes, or where windows stop being of one text.
        change = np.flatnonzero((np.diff(anchor) != 0) | np.diff(valid)) + 1
        start = np.concatenate([[0], change])
        end = np.concatenate([change, [len(anchor)]])
        start, end = start[valid[start]], end[valid[start]]
        length = end - start + size - 1
        name = (sums[start + length] - sums[start]) * inverse[start]
        gram_hash = hashed[anchor[start]]
        name = _mixed(name + length.astype(np.uint64) * gram_hash)
        return [start + at, end - start, anchor[start] - start, gram_hash >> np.uint64(64 - _HASH_BITS), name]

    def distinct(self) -> None:
        """Stretches of equal content: first of each, how often, and each stretch's number."""
        key = _mixed(self.name ^ (self.gram * np.uint64(_BASE)))
        _, self.first, self.number, self.times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, how many distinct stretches each has, and whether it occurs twice."""
        self.distinct()
        grams, at = np.unique(self.gram, return_inverse=True)
        stretches = np.bincount(at[self.first], minlength=len(grams))
        return grams, stretches, np.bincount(at, minlength=len(grams)) > 1

    def text_of(self, number: int) -> tuple[bytes, int]:
        """A distinct stretch, and where its anchor is."""
        k = self.first[number]
        start = int(self.start[k])
        return self.raw[start : start + int(self.count[k]) + self.sizes.window - 1], int(self.anchor[k])


def _window_hash(window: bytes) -> int:
    return xxhash.xxh3_64_intdigest(window) >> (64 - _HASH_BITS)


def _hot_windows(chunk: Chunk, hot: np.ndarray) -> tuple[dict[int, list], np.ndarray]:
    """Hash -> [(window, distinct stretch, place)] of the windows of stretches with hot grams."""
    found = defaultdict(list)
    for number in np.flatnonzero(hot).tolist():
        text, _ = chunk.text_of(number)
        for place in range(len(text) - chunk.sizes.window + 1):
            window = text[place : place + chunk.sizes.window]
            found[_window_hash(window)].append((window, number, place))
    return found, np.array(sorted(found), np.uint64)


_ASKED = fields(block="long", chunk="long", values="binary")


def _asked(chunk: int, hashes: np.ndarray, weights: np.ndarray, twice: np.ndarray, blocks: int) -> pa.Table:
    """The sorted hashes of a chunk, one row per block: rest of the hash, twice or not, weight."""
    bits = np.uint64(_HASH_BITS - (blocks - 1).bit_length())
    block = (hashes >> bits).astype(np.int64)
    packed = np.zeros((len(hashes), _REST_BYTES + 3), np.uint8)
    rest = hashes & np.uint64((1 << int(bits)) - 1)
    packed[:, :_REST_BYTES] = rest.view(np.uint8).reshape(-1, 8)[:, :_REST_BYTES]
    packed[:, _REST_BYTES] = twice
    packed[:, _REST_BYTES + 1 :] = np.minimum(weights, 65535).astype(np.uint16).view(np.uint8).reshape(-1, 2)
    # Zero bytes at the end of each hash cost little once compressed.
    places = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
    cuts = np.split(packed, places[1:]) if len(block) else []
    return pa.table(
        {
            "block": pa.array(block[places] if len(block) else [], pa.int64()),
            "chunk": pa.array([chunk] * len(cuts), pa.int64()),
            "values": pa.array([c.tobytes() for c in cuts], pa.binary()),
        }
    )


_TOLD = fields(block="long", chunk="long", codes="binary")


def _told(rows: pa.Table, hot: int) -> pa.Table:
    """Per row and hash of one block: 0 occurs once, 1 repeated, 2 repeated and hot."""
    chunks, values = (rows.column(c).to_pylist() for c in ("chunk", "values"))
    packed = [np.frombuffer(v, np.uint8).reshape(-1, _REST_BYTES + 3) for v in values]
    every = np.concatenate(packed)
    wide = np.zeros((len(every), 8), np.uint8)
    wide[:, :_REST_BYTES] = every[:, :_REST_BYTES]
    _, at = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    chunks_with = np.bincount(at)
    twice = np.bincount(at, weights=every[:, _REST_BYTES]) > 0
    weight = np.bincount(at, weights=every[:, _REST_BYTES + 1 :].copy().view(np.uint16).ravel())
    code = np.where((chunks_with > 1) | twice, np.where(weight > hot, 2, 1), 0).astype(np.uint8)[at]
    cuts = np.split(code, np.cumsum([len(p) for p in packed])[:-1])
    return pa.table({"block": rows.column("block"), "chunk": pa.array(chunks, pa.int64()), "codes": pa.array([c.tobytes() for c in cuts], pa.binary())})


def _codes(rows: pa.Table) -> np.ndarray:
    """The answers to a chunk, in the order of its hashes."""
    blocks = rows.column("block").to_numpy()
    codes = rows.column("codes").to_pylist()
    return np.frombuffer(b"".join(codes[i] for i in np.argsort(blocks, kind="stable")), np.uint8)


_RUNS = fields(deal="long", by_window="boolean", chunk="long", shared="binary", lengths="binary", rests="binary", lefts="binary", numbers="binary")


def _run(chunk: int, by_window: bool, items: list[tuple], deals: int) -> Iterator[dict]:
    """Front-coded rows, one per deal, of (hash, suffix, left, number and flag)."""
    dealt = defaultdict(list)
    for key, *item in items:
        dealt[key % deals].append(item)
    for deal, some in dealt.items():
        some.sort()
        shared, lengths, rests = front_coded([suffix for suffix, _, _ in some])
        lefts = [left for _, left, _ in some]
        yield {
            "deal": deal,
            "by_window": by_window,
            "chunk": chunk,
            "shared": shared,
            "lengths": lengths,
            "rests": rests,
            "lefts": np.fromiter(map(len, lefts), np.int32, len(lefts)).tobytes() + b"".join(lefts),
            "numbers": np.array([number for _, _, number in some], np.int64).tobytes(),
        }


_FOUND = fields(chunk="long", by_window="boolean", numbers="binary", places="binary")


class _Merge:
    """What repeats among the runs of one deal."""

    def __init__(self, rows: pa.Table, window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        self.by_window = rows.column("by_window")[0].as_py()
        self.chunks = rows.column("chunk").to_pylist()
        coded = [rows.column(c).to_pylist() for c in ("shared", "lengths", "rests")]
        self.runs = [decoded(*r) for r in zip(*coded, strict=True)]
        self.numbers = [np.frombuffer(n, np.int64).tolist() for n in rows.column("numbers").to_pylist()]
        self.lefts = [self._lefts(raw, len(n)) for raw, n in zip(rows.column("lefts").to_pylist(), self.numbers, strict=True)]
        self.found: dict[int, list] = defaultdict(list)

    @staticmethod
    def _lefts(raw: bytes, n: int) -> list[bytes]:
        ends = np.cumsum(np.frombuffer(raw, np.int32, n)).tolist()
        return [raw[4 * n + a : 4 * n + b] for a, b in zip([0, *ends], ends, strict=False)]

    def run(self) -> pa.Table:
        at = [0] * len(self.runs)
        group: dict[tuple, list] = {}
        together = self.window if self.by_window else self.gram
        for run, shared, suffix in merged(self.runs):
            if shared < together and group:
                self._close(group)
                group = {}
            i = at[run]
            at[run] += 1
            number = self.numbers[run][i]
            # Equal strings share one entry: who holds it, and whether one holds it twice.
            held = group.setdefault((self.lefts[run][i], suffix), [[], False])
            held[0].append((run, number >> 1))
            held[1] |= bool(number & 1)
        self._close(group)
        rows = [(self.chunks[run], np.array(f, np.int64)) for run, f in self.found.items()]
        return pa.table(
            {
                "chunk": pa.array([c for c, _ in rows], pa.int64()),
                "by_window": pa.array([self.by_window] * len(rows), pa.bool_()),
                "numbers": pa.array([f[:, 0].tobytes() for _, f in rows], pa.binary()),
                "places": pa.array([np.ascontiguousarray(f[:, 1:]).tobytes() for _, f in rows], pa.binary()),
            }
        )

    def _close(self, group: dict[tuple, list]) -> None:
        """Marks the windows of a group that occur at two places or more."""
        whole = {key for key, (holders, twice) in group.items() if twice or len(holders) > 1}
        if len(group) == 1:
            for key in whole:
                left, suffix = key
                self._mark(group[key][0], [(0, len(left) + len(suffix) - self.window + 1)])
            return
        seen: dict[bytes, tuple | None] = {}
        hits: dict[tuple, list[int]] = {key: [] for key in group}
        for key in group:
            text = key[0] + key[1]
            for place in range(len(text) - self.window + 1):
                window = text[place : place + self.window]
                if window not in seen:
                    seen[window] = (key, place)
                    continue
                if seen[window] is not None:
                    first, where = seen[window]
                    hits[first].append(where)
                    seen[window] = None
                hits[key].append(place)
        for key, places in hits.items():
            if key in whole:
                self._mark(group[key][0], [(0, len(key[0]) + len(key[1]) - self.window + 1)])
            elif places:
                places = np.array(sorted(places))
                cuts = np.flatnonzero(np.diff(places) != 1) + 1
                self._mark(group[key][0], [(int(p[0]), int(p[-1]) + 1) for p in np.split(places, cuts)])

    def _mark(self, holders: list[tuple], spans: list[tuple[int, int]]) -> None:
        for run, number in holders:
            self.found[run].extend((number, a, b) for a, b in spans)


def _stored(docs: DataFrame, sizes: Sizes, total: int) -> DataFrame:
    """chunk, c1, c2, packed of every text with a window; a task packs equal texts once."""
    chunks = max(1, -(-total // sizes.chunk_bytes))
    schema = fields(chunk="long", c1="long", c2="long", packed="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            packed = []
            for key, raw in zip(keys, text_bytes(batch.column(2)), strict=True):
                packed.append(None if key in seen else pack(raw.as_py()))
                seen.add(key)
            columns = [[k[0] % chunks for k in keys], [k[0] for k in keys], [k[1] for k in keys]]
            arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    long_enough = docs.where(F.octet_length("text") >= sizes.window).select("c1", "c2", "text")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks // 4)
    return _dealt(long_enough.mapInArrow(run, schema).repartition(partitions, "chunk"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows, stored. Planned without adaptive execution, whose plans do not tell how rows are
    dealt: so later steps know that they lie by chunk, and only what the chunks are told moves."""
    conf = rows.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(rows)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def _per_chunk(texts: DataFrame, others: list[DataFrame], work: Callable, schema) -> DataFrame:
    """`work(chunk, its texts, its rows of the others)` for every chunk; the texts do not move."""
    # Rows of all others in one frame, so that each chunk meets them at once.
    columns = {f.name: f.dataType for o in others for f in o.schema.fields if f.name != "chunk"}
    rows = None
    for part, other in enumerate(others):
        kept = [F.col(c) if c in other.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        some = other.select("chunk", F.lit(part).alias("part"), *kept)
        rows = some if rows is None else rows.unionAll(some)
    n = len(others)

    def run(some: pa.Table, found: pa.Table) -> pa.Table:
        if not some.num_rows:
            return pa.table({f.name: [] for f in schema}).cast(to_arrow_schema(schema))
        parts = found.column("part").to_numpy()
        return work(some.column("chunk")[0].as_py(), some, [found.filter(pa.array(parts == i)) for i in range(n)])

    return texts.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(run, schema)


def _told_by_block(asked: DataFrame, hot: int) -> DataFrame:
    return checkpointed(asked.groupBy("block").applyInArrow(lambda rows: _told(rows, hot), _TOLD))


def repeated_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 200,
    gram: int = 64,
    chunk_bytes: int = CHUNK_BYTES,
    piece_bytes: int = PIECE_BYTES,
    block_hashes: int = BLOCK_HASHES,
    hot: int = HOT_STRETCHES,
    merge_bytes: int = MERGE_BYTES,
) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends.

    Of the text's UTF-8 bytes (null: none) those are removed that a string of `window` bytes covers
    which starts anywhere else too, in the same text or another; occurrences may overlap, none
    crosses from one text into the next. starts and ends (exclusive) are the maximal removed runs
    in bytes, which may cut characters. Shorter texts and an empty table lose nothing; equal texts
    of a window or more, repeated rows included, are removed whole, whatever their ids, nulls
    included. Very long texts are looked at in pieces, and a passage of any number of texts is
    dealt by window. Texts are known by 128-bit hashes; windows are compared byte by byte.
    """
    sizes = Sizes(window, min(gram, window), chunk_bytes, piece_bytes, block_hashes, hot, merge_bytes)
    whole = whole_text(text)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(whole).alias("c1"),
        F.xxhash64(F.lit(1), whole).alias("c2"),
        whole.alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = _stored(rows, sizes, total)
    found = _classes(texts, sizes, total)
    plain = rows.select("id", "c1", "c2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    none = F.array().cast("array<long>")
    return plain.join(found, ["c1", "c2"], "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
        F.coalesce("starts", none).alias("starts"),
        F.coalesce("ends", none).alias("ends"),
    )


def _classes(texts: DataFrame, sizes: Sizes, total: int) -> DataFrame:
    """c1, c2, n_removed, kept (hash of what stays), starts, ends of the texts that lose bytes."""
    blocks = 1 << (total // 64 // sizes.block_hashes).bit_length()

    def ask(rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows, sizes)
        chunk.stretches()
        return _asked(rows.column("chunk")[0].as_py(), *chunk.grams(), blocks)

    told = _told_by_block(texts.groupBy("chunk").applyInArrow(ask, _ASKED), sizes.hot)

    def read(rows: pa.Table, codes: np.ndarray) -> tuple[Chunk, np.ndarray]:
        """The chunk and, per distinct stretch, the answer for its gram."""
        chunk = Chunk(rows, sizes)
        chunk.stretches()
        grams, _, _ = chunk.grams()
        return chunk, codes[np.searchsorted(grams, chunk.gram[chunk.first])]

    # Hot grams: their windows are asked for, as the grams were.
    window_told = None
    hot_rows = told.where(F.hex("codes").contains("02"))  # codes are 00, 01 or 02
    hot_chunks = told.join(hot_rows.select("chunk").distinct(), "chunk", "left_semi")
    if not hot_rows.isEmpty():

        def ask_windows(number: int, rows: pa.Table, others: list[pa.Table]) -> pa.Table:
            if not others[0].num_rows:
                return _asked(number, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool), blocks)
            chunk, code = read(rows, _codes(others[0]))
            found, hashes = _hot_windows(chunk, code == 2)
            several = [len(found[h]) > 1 or chunk.times[found[h][0][1]] > 1 for h in hashes.tolist()]
            return _asked(number, hashes, np.ones(len(hashes), np.int64), np.array(several, bool), blocks)

        window_told = _told_by_block(_per_chunk(texts, [hot_chunks], ask_windows, _ASKED), 1 << 62)

    deals = max(1, total // sizes.merge_bytes)

    def sort(number: int, rows: pa.Table, others: list[pa.Table]) -> pa.Table:
        if not others[0].num_rows:
            return pa.table({f.name: [] for f in _SORTED}).cast(to_arrow_schema(_SORTED))
        chunk, code = read(rows, _codes(others[0]))
        items, windows = [], []
        for k in np.flatnonzero(code == 1).tolist():
            string, at = chunk.text_of(k)
            items.append((int(chunk.gram[chunk.first[k]]), string[at:], string[:at], 2 * k + int(chunk.times[k] > 1)))
        places: list[tuple[int, int]] = []
        if len(others) > 1 and others[1].num_rows:
            found, hashes = _hot_windows(chunk, code == 2)
            for h, again in zip(hashes.tolist(), _codes(others[1]).tolist(), strict=True):
                if not again:
                    continue
                same = defaultdict(list)
                for string, k, place in found[h]:
                    same[string].append((k, place))
                for string, held in same.items():
                    several = len(held) > 1 or chunk.times[held[0][0]] > 1
                    windows.append((h, string, b"", 2 * len(places) + int(several)))
                    places.append((len(held), 0))
                    places.extend(held)
        runs = [*_run(number, False, items, deals), *_run(number, True, windows, deals)]
        wanted = np.flatnonzero(code[chunk.number] > 0)
        index = np.stack([chunk.number[wanted], chunk.start[wanted], chunk.count[wanted]]).astype(np.int64)
        made = {f.name: [r.get(f.name) for r in runs] + [None] for f in _RUNS}
        made["chunk"][-1] = number
        made["index"] = [None] * len(runs) + [index.tobytes()]
        made["windows"] = [None] * len(runs) + [np.array(places, np.int64).tobytes()]
        return pa.table(made, schema=to_arrow_schema(_SORTED))

    sorted_runs = checkpointed(_per_chunk(texts, [told] + ([window_told] if window_told is not None else []), sort, _SORTED))
    window, gram = sizes.window, sizes.gram
    runs = sorted_runs.where("deal is not null").select(_RUNS.names)
    merged_runs = runs.groupBy("by_window", "deal").applyInArrow(lambda rows: _Merge(rows, window, gram).run(), _FOUND)
    index = sorted_runs.where("deal is null").select("chunk", "index", "windows")

    def close(number: int, rows: pa.Table, others: list[pa.Table]) -> pa.Table:
        chunk = Chunk(rows, sizes)
        change = np.zeros(len(chunk.raw) + 1, np.int32)
        for at, end in _places(others[0], others[1]):
            np.add.at(change, at, 1)
            np.add.at(change, end + window - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        return _kept(chunk, gone)

    return _per_chunk(texts, [index, merged_runs], close, _CLASSES)


_SORTED = fields(deal="long", by_window="boolean", chunk="long", shared="binary", lengths="binary", rests="binary", lefts="binary", numbers="binary", index="binary", windows="binary")
_CLASSES = fields(c1="long", c2="long", n_removed="long", kept="string", starts="array<long>", ends="array<long>")


def _places(index: pa.Table, found: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and last (exclusive) window starts of a chunk that are repeated."""
    for raw, windows in zip(index.column("index").to_pylist(), index.column("windows").to_pylist(), strict=True):
        number, start, _ = np.frombuffer(raw, np.int64).reshape(3, -1)
        order = np.argsort(number, kind="stable")
        number, start = number[order], start[order]
        held = np.frombuffer(windows, np.int64).reshape(-1, 2)
        columns = zip(*(found.column(c).to_pylist() for c in ("by_window", "numbers", "places")), strict=True)
        for by_window, numbers, places in columns:
            marks = np.column_stack([np.frombuffer(numbers, np.int64), np.frombuffer(places, np.int64).reshape(-1, 2)])
            if by_window:
                each = [held[at + 1 : at + 1 + held[at, 0]] for at in marks[:, 0].tolist()]
                each = np.concatenate(each)
                marks = np.column_stack([each[:, 0], each[:, 1], each[:, 1] + 1])
            # Every stretch of that content, wherever it is in the chunk.
            low, high = np.searchsorted(number, marks[:, 0]), np.searchsorted(number, marks[:, 0], side="right")
            count = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            first, last = np.repeat(marks[:, 1], count), np.repeat(marks[:, 2], count)
            yield start[at] + first, start[at] + last


def _kept(chunk: Chunk, gone: np.ndarray) -> pa.Table:
    columns: list[list] = [[] for _ in _CLASSES.names]
    begin = 0
    for (c1, c2), copies, end in zip(chunk.classes, chunk.copies, chunk.ends.tolist(), strict=True):
        if copies > 1:
            gone[begin:end] = True
        mask = gone[begin:end]
        if mask.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            kept = np.frombuffer(chunk.raw, np.uint8, end - begin, begin)[~mask].tobytes()
            row = (c1, c2, int(mask.sum()), hashlib.sha256(kept).hexdigest(), edges[::2], edges[1::2])
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        begin = end
    return pa.table(dict(zip(_CLASSES.names, columns, strict=True)), schema=to_arrow_schema(_CLASSES))
