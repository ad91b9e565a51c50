"""Spelling variants: words one edit apart, found by dense tiles of padded code points.

* A word is cut into three parts. One inserted, deleted or replaced code point lies in one of
  them, so near words agree on what is before and behind that part. Words of one length, and those
  one longer, come together under the two ends that a part leaves: a tile.
* In a tile, blocks of words are matrices of code points, padded with different values on the two
  sides. The common prefix and suffix of every pair come from them at once; two words are near
  where both reach the longer length less one. Tiles are cut into blocks of bounded size and every
  two blocks meet in a task of their own.
* A pair is counted in the one tile whose part holds the last place its edit can have.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, UPPER, checkpointed, fields, whole_text

#: Words, and code points, of a block.
BLOCK_WORDS, BLOCK_POINTS = 512, 1 << 18
_PARTS = 3
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_TO_LOWER = str.maketrans(UPPER, LOWER)
#: Distinct words a task counts, and rows of tiles, before it gives them out; cells of a matrix.
_HELD, _ROWS, _CELLS = 200_000, 50_000, 4_000_000


def _cut_words(texts: DataFrame, shortest: int, every: int) -> DataFrame:
    """word, n: what the runs of the texts become, combined within a task."""
    schema = fields(word="string", n="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
            batch = pa.RecordBatch.from_arrays(arrays, names=schema.names)
            counts.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(*(batch.column(i) for i in range(2)), strict=True):
                runs: Counter = Counter()
                for word, n in Counter(_RUN.findall(text.as_py())).items():
                    if len(word) >= shortest:
                        runs[word.lower() if word.isascii() else word.translate(_TO_LOWER)] += n
                name = doc_id.as_py() + ":"
                for word, n in runs.items():
                    h = zlib.crc32((name + word).encode())
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) >= _HELD:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, schema)


def _tiled(words: DataFrame) -> DataFrame:
    """tile (64-bit hash of length, part and both ends), longer, part, word, n.

    Each word is in the tiles of its own length and, as the longer one, of the length below.
    """
    size = F.char_length("word")

    def tiles(longer: int):
        length = size - longer
        for part in range(_PARTS):
            low, high = (F.floor(length * p / _PARTS).cast("int") for p in (part, part + 1))
            ends = F.substr("word", F.lit(1), low), F.substr("word", high + 1 + longer)
            key = F.xxhash64(length, F.lit(part), *ends)
            yield F.struct(key.alias("tile"), F.lit(longer).alias("longer"), F.lit(part).alias("part"))

    every = F.array(*tiles(0), *tiles(1))
    return words.select("word", "n", F.explode(every).alias("t")).select("t.*", "word", "n")


def _matrix(words: list[str], width: int, height: int, at_end: bool) -> np.ndarray:
    """Code points of tiles of `height` words, padded in front or behind with a value that no two
    words of a tile share."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
    found = np.repeat(-1 - np.arange(len(words), dtype=np.int32)[:, None], width, axis=1)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if at_end:
        column = column + np.repeat(width - lengths, lengths)
    found[np.repeat(np.arange(len(words)), lengths), column] = flat
    return found.reshape(-1, height, width)


def _common(points: np.ndarray, columns: range) -> np.ndarray:
    """How many code points every two words of a tile share, column by column."""
    tiles, height, _ = points.shape
    same = np.ones((tiles, height, height), dtype=bool)
    shared = np.zeros((tiles, height, height), np.int32)
    for c in columns:
        same &= points[:, :, None, c] == points[:, None, :, c]
        if not same.any():
            break
        shared += same
    return shared


class Tiles:
    """Rows of whole jobs, in order: a job compares two blocks (or one with itself) of a tile."""

    def __init__(self, rows: pa.Table) -> None:
        self.words = np.array(rows.column("word").to_pylist() + [""], object)  # the last one pads
        self.job = rows.column("job").to_numpy()
        self.n = rows.column("n").to_numpy()
        self.part, self.block, self.longer = (np.append(rows.column(c).to_numpy(), 2) for c in ("part", "block", "longer"))
        self.within = rows.column("within").to_numpy()
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs of near words, the one of the tile's own length first."""
        starts = np.flatnonzero(np.concatenate([[True], self.job[1:] != self.job[:-1]]))
        sizes = np.diff(np.append(starts, len(self.job)))
        heights = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        widths = np.maximum.reduceat(self.length[:-1], starts)
        widths = np.where(widths <= 16, 16, 1 << np.ceil(np.log2(np.maximum(widths, 1))).astype(np.int64))
        pairs = []
        for height, width in sorted(set(zip(heights.tolist(), widths.tolist(), strict=True))):
            some = np.flatnonzero((heights == height) & (widths == width))
            step = max(1, _CELLS // (height * max(height, width)))
            for at in range(0, len(some), step):
                jobs = some[at : at + step]
                rows = starts[jobs, None] + np.arange(height)
                rows[np.arange(height) >= sizes[jobs, None]] = len(self.words) - 1
                pairs.append(self._of(rows, int(width)))
        return tuple(np.concatenate(c) for c in zip(*pairs, strict=True))

    def _of(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        height = rows.shape[1]
        words = self.words[rows.ravel()].tolist()
        prefix = _common(_matrix(words, width, height, False), range(width))
        suffix = _common(_matrix(words, width, height, True), range(width - 1, -1, -1))
        size, longer = self.length[rows], self.longer[rows]
        own, other = size[:, :, None], size[:, None, :]
        # Own length first; of two of that length each pair once.
        order = np.arange(height)
        fits = (longer[:, :, None] == 0) & (
            ((longer[:, None, :] == 0) & (own == other) & (order[:, None] < order)) | ((longer[:, None, :] == 1) & (other == own + 1))
        )
        block, within = self.block[rows], self.within[np.minimum(rows[:, 0], len(self.job) - 1)]
        fits &= within[:, None, None] | (block[:, :, None] != block[:, None, :])
        fits &= prefix + suffix >= other - 1
        # The last place the edit can have lies in this tile's part.
        part = self.part[rows[:, 0]][:, None, None]
        fits &= (prefix >= own * part // _PARTS) & ((prefix < own * (part + 1) // _PARTS) | (part == _PARTS - 1))
        tile, x, y = np.nonzero(fits)
        return rows[tile, x], rows[tile, y]

    def best(self) -> pa.RecordBatch:
        """word, near, best_n, best of the words that have near ones in these tiles."""
        x, y = self.near()
        word, other = np.concatenate([x, y]), np.concatenate([y, x])
        names, name = np.unique(self.words[word], return_inverse=True) if len(word) else (np.empty(0, object), word)
        _, rank = np.unique(self.words[other], return_inverse=True) if len(word) else (None, word)
        order = np.lexsort((rank, -self.n[other], name))
        first = np.flatnonzero(np.diff(name[order], prepend=-1))
        at = other[order[first]]
        arrays = [
            pa.array(names.tolist(), pa.string()),
            pa.array(np.diff(np.append(first, len(order))), pa.int64()),
            pa.array(self.n[at], pa.int64()),
            pa.array(self.words[at].tolist(), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=_NEAR.names)


_NEAR = fields(word="string", near="long", best_n="long", best="string")


def _compare(jobs: DataFrame) -> DataFrame:
    """word, near, best_n, best: partial results of the jobs a task holds, many small ones at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            job = held.column("job").to_numpy()
            cut = int(np.searchsorted(job[::-1] != job[-1], True)) if len(job) else 0
            whole = len(job) - cut
            if whole and whole >= _ROWS:
                yield Tiles(held.slice(0, whole)).best()
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield Tiles(held).best()

    job = F.xxhash64("tile", "part", "i", "j").alias("job")
    dealt = jobs.select(job, "part", "block", "longer", "word", "n", (F.col("i") == F.col("j")).alias("within"))
    return dealt.repartition("job").sortWithinPartitions("job").mapInArrow(run, _NEAR)


def _roots(links: DataFrame) -> DataFrame:
    """word, root of every word with a form: ways are doubled until none changes."""
    now = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        then = checkpointed(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shortest: int = 7,
    least: int = 2,
    ratio: int = 10,
    every: int = 31,
    block_words: int = BLOCK_WORDS,
    block_points: int = BLOCK_POINTS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `shortest` code points or more that
    occurs `least` times or more.

    Runs are maximal strings of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; one in `every`,
    by the crc32 of id and run, has lost a code point. A null id counts as the empty string, null
    and empty texts have no runs, repeated rows count each, an empty table has no words. Two words
    are near that differ by exactly one inserted, deleted or replaced code point. The form is the
    most frequent near word (of equally frequent ones the first in code-point order) if it occurs
    at least `ratio` times as often, else null; the root is where forms lead to. Very long runs are
    words like any other; blocks of them hold fewer words.
    """
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), whole_text(text))
    counted = _cut_words(texts, shortest, every).groupBy("word").agg(F.sum("n").alias("n"))
    words = checkpointed(counted.where(F.col("n") >= least))
    tiled = _tiled(words)
    # A tile with one word, or with words of the longer kind alone, has no pairs.
    sizes = tiled.groupBy("tile", "part").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("longer").alias("least"),
        F.max(F.char_length("word")).alias("points"),
    )
    per_block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.lit(block_points) / F.col("points"))))
    sizes = sizes.where("count > 1 and least = 0").select("tile", "part", F.ceil(F.col("count") / per_block).cast("int").alias("blocks"))
    placed = tiled.join(sizes, ["tile", "part"]).withColumn("block", F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    jobs = placed.select("tile", "part", "longer", "word", "n", "block", others.alias("other")).select(
        "tile", "part", "longer", "word", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    found = _compare(jobs).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best")
    )
    best_n = -F.col("best.less")
    is_form = best_n >= F.col("n") * ratio
    joined = words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.best")).alias("form"),
        F.when(is_form, best_n).alias("form_n"),
    )
    joined = checkpointed(joined)
    roots = _roots(joined.where("form is not null").select("word", "form"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
