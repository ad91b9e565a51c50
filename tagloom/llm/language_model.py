"""Language-model scores: a word unigram base, and prediction by partial matching over bytes.

The byte model is a trie of contexts of up to four bytes, counted over all training texts; it grows
with the corpus and is never whole in one place. Symbols not seen in a context are predicted by
escaping to the next shorter one, without the symbols the longer one has seen.

Texts are read in chunks of bounded size. A chunk tells the blocks of the trie how often each
symbol follows each context in its training texts, and in doing so asks for the contexts of all its
texts: a block adds up what it is told and answers each chunk with all that followed those. In the
same way a chunk asks once for each of its distinct words, so a word has at most as many rows as
there are chunks, and gets its counts back in the order of its words.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import add_columns, checkpointed, fields, text_bytes, whole_text
from tagloom.llm.quality import remainder

#: A chunk has some CHUNK_BYTES of text; a longer text is a chunk alone.
CHUNK_BYTES = 16_000_000
_WINDOWS_AT_ONCE = 1_000_000
#: Bytes of the longest contexts; a key has the length of its context at this bit, above its bytes.
DEPTH, _ORDER_AT = 4, 40
#: Bytes that occur in no UTF-8 text: before and after a text.
_START, _END = 0xFE, 0xFF
_SYMBOLS = 256


def _framed(lower: bytes, depth: int) -> bytes:
    return bytes([_START] * depth) + lower + bytes([_END])


def _windows(framed: np.ndarray, depth: int) -> np.ndarray:
    """Contexts of `depth` bytes with the symbol behind, as numbers, of a slice of framed texts."""
    found = np.zeros(max(0, len(framed) - depth), np.uint64)
    for i in range(depth + 1):
        found <<= np.uint64(8)
        found |= framed[i : i + len(found)]
    return found


def _slices(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the texts, some at once, and which of them predict a symbol of a text or its end."""
    every = np.frombuffer(b"".join(_framed(t, depth) for t in texts), np.uint8)
    for at in range(0, len(every) - depth, _WINDOWS_AT_ONCE):
        some = every[at : at + _WINDOWS_AT_ONCE + depth]
        yield _windows(some, depth), some[depth:] != _START


def _counted(texts: list[bytes], train: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of the texts, of every length, and how often they occur in training.

    A key holds the length of the context above its bytes.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for learnt in (True, False):
        for windows, real in _slices([t for t, is_train in zip(texts, train, strict=True) if is_train == learnt], depth):
            codes, distinct = pd.factorize(windows[real])
            found.append((distinct, np.bincount(codes, minlength=len(distinct)) if learnt else np.zeros(len(distinct), np.int64)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts = _summed(*(np.concatenate(c) for c in zip(*found, strict=True)))
    levels = []
    for order in range(depth, -1, -1):
        keys, counts = _summed(keys & _low(order + 1), counts)
        levels.append((keys | np.uint64(order << _ORDER_AT), counts))
    return tuple(np.concatenate(c) for c in zip(*levels[::-1], strict=True))


def _low(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in order and their counts; bytes of equal weight together, as they compress better so."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.stack([steps.view(np.int64), counts.astype(np.int64)]).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    steps, counts = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(2, -1)
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64), counts


class ContextModel:
    """The part of the trie that some texts need: what follows each of their contexts.

    Exclusion: what a longer context has seen is taken out of the shorter ones, whose counts,
    totals and escapes are those of what is left. What is left of a context's suffix depends on the
    context alone, so it is kept with it.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.grams, self.counts, self.contexts, self.total, self.distinct, self.left = [], [], [], [], [], []
        ends = np.searchsorted(keys, np.arange(depth + 2, dtype=np.uint64) << np.uint64(_ORDER_AT))
        for order in range(depth + 1):
            grams, n = keys[ends[order] : ends[order + 1]] & _low(_ORDER_AT // 8), counts[ends[order] : ends[order + 1]]
            contexts, start = np.unique(grams >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, start) if len(start) else n
            distinct = np.diff(np.append(start, len(grams)))
            if order and len(grams):
                shorter = np.searchsorted(self.grams[-1], grams & _low(order))
                taken = np.add.reduceat(self.counts[-1][shorter], start)
                suffix = np.searchsorted(self.contexts[-1], contexts & _low(order - 1))
                self.left.append((self.total[-1][suffix] - taken, self.distinct[-1][suffix] - distinct))
            else:
                self.left.append((total, distinct))
            for kept, made in zip((self.grams, self.counts, self.contexts, self.total, self.distinct), (grams, n, contexts, total, distinct), strict=True):
                kept.append(made)

    def log10(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window after the others."""
        found, alive, inside = np.zeros(len(windows)), np.ones(len(windows), bool), np.zeros(len(windows), bool)
        total, distinct = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        for order in range(self.depth, -1, -1):
            if not len(self.grams[order]):
                continue
            gram = windows & _low(order + 1)
            at = np.minimum(np.searchsorted(self.contexts[order], gram >> np.uint64(8)), len(self.contexts[order]) - 1)
            known = self.contexts[order][at] == gram >> np.uint64(8)
            # The longest context known counts whole; of shorter ones what the longer has left.
            total = np.where(inside, total, self.total[order][at])
            distinct = np.where(inside, distinct, self.distinct[order][at])
            where = np.minimum(np.searchsorted(self.grams[order], gram), len(self.grams[order]) - 1)
            seen = self.grams[order][where] == gram
            usable = alive & known & (distinct > 0)
            share = np.where(seen, self.counts[order][where], distinct)
            found[usable] += np.log10(share[usable] / (total + distinct)[usable])
            alive &= ~(usable & seen)
            if order:
                left = self.left[order]
                total, distinct = np.where(known, left[0][at], total), np.where(known, left[1][at], distinct)
                inside |= known
        n_seen = self.distinct[0][0] if len(self.distinct[0]) else 0
        found[alive] -= np.log10(_SYMBOLS - n_seen)
        return found

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        found = np.zeros(len(texts))
        # The windows of a text are those that end in it; the first `depth` bytes of all end none.
        lengths = np.array([len(t) + 1 + self.depth for t in texts], np.int64)
        begin = np.maximum(np.cumsum(lengths) - lengths - self.depth, 0)
        at = 0
        for windows, real in _slices(texts, self.depth):
            codes, distinct = pd.factorize(windows)
            share = np.where(real, self.log10(distinct)[codes], 0.0)
            first = np.searchsorted(begin, at, side="right") - 1
            last = np.searchsorted(begin, at + len(share))
            found[first:last] += np.add.reduceat(share, np.maximum(begin[first:last] - at, 0))
            at += len(share)
        return found


def _key(lower: bytes, doc_id: str | None) -> tuple[int, int]:
    """128-bit hash of a text and its id, as two signed numbers."""
    state = xxhash.xxh3_128(lower)
    state.update(b"\xff" + (doc_id or "").encode())
    a, b = np.frombuffer(state.digest(), dtype="<i8")
    return int(a), int(b)


_CHUNK = fields(
    words="array<long>",
    counts="array<int>",
    blocks="array<long>",
    asked="array<binary>",
    n_texts="long",
    n_train="long",
    payload="binary",
)


def _block(contexts: np.ndarray, blocks: int) -> np.ndarray:
    return ((contexts * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(blocks)


class _Chunk:
    """Texts, and the numbers of their distinct words as they come."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.keys: list[tuple[int, int]] = []
        self.train: list[bool] = []
        self.size = 0

    def add(self, lower: bytes, doc_id: str | None, train: bool) -> None:
        self.texts.append(lower)
        self.keys.append(_key(lower, doc_id))
        self.train.append(train)
        self.size += len(lower)

    def row(self, depth: int, blocks: int) -> tuple:
        number, tokens = _numbered(self.texts)
        train = np.repeat(np.array(self.train, dtype=bool), [len(t) for t in tokens])
        tokens = np.concatenate([np.empty(0, np.uint32), *tokens])
        counts = np.bincount(tokens[train], minlength=len(number)).astype(np.int32)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        keys, seen = _counted(self.texts, self.train, depth)
        block = _block(keys >> np.uint64(8), blocks)
        order = np.argsort(block, kind="stable")  # keys stay in order within a block
        named, starts = np.unique(block[order], return_index=True)
        asked = [_packed(keys[at], seen[at]) for at in np.split(order, starts[1:])] if len(keys) else []
        lengths = np.array([len(t) for t in self.texts], dtype=np.uint32)
        payload = np.array(self.keys, dtype=np.int64).tobytes() + lengths.tobytes() + b"".join(self.texts)
        return (
            words.view(np.int64), counts, named.astype(np.int64), asked,
            len(self.keys), sum(self.train), zstandard.ZstdCompressor(level=3).compress(payload),
        )


def _numbered(texts: list[bytes]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Numbers of the distinct words, as they come, and each text in them."""
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    tokens = []
    for text in texts:
        words = text.split()
        tokens.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
    return number, tokens


def _read_payload(payload: bytes, n: int) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    keys = np.frombuffer(raw, np.int64, 2 * n).reshape(n, 2)
    ends = 20 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 16 * n).astype(np.int64))
    return keys, [raw[a:b] for a, b in zip([20 * n, *ends.tolist()], ends.tolist(), strict=False)]


def _chunks(docs: DataFrame, chunk_bytes: int, depth: int, blocks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: _Chunk) -> pa.RecordBatch:
            arrays = [
                pa.array([v], t)
                for v, t in zip(
                    chunk.row(depth, blocks),
                    [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()),
                     pa.int64(), pa.int64(), pa.binary()],
                    strict=True,
                )
            ]
            return pa.RecordBatch.from_arrays(arrays, names=_CHUNK.names)

        chunk = _Chunk()
        for batch in batches:
            ids, train = batch.column("id").to_pylist(), batch.column("train").to_pylist()
            for raw, doc_id, is_train in zip(text_bytes(batch.column("text")), ids, train, strict=True):
                chunk.add(raw.as_py().lower(), doc_id, is_train)
                if chunk.size >= chunk_bytes:
                    yield out(chunk)
                    chunk = _Chunk()
        if chunk.keys:
            yield out(chunk)

    return docs.mapInArrow(run, _CHUNK).withColumn("chunk", F.monotonically_increasing_id())


def _followers(chunks: DataFrame) -> DataFrame:
    """chunk, block, payload: all that followed the contexts a chunk asked a block for."""
    zipped = F.explode(F.arrays_zip("blocks", "asked")).alias("a")
    asked = chunks.select("chunk", zipped).select("chunk", F.col("a.blocks").alias("block"), F.col("a.asked").alias("payload"))

    def add(rows: pa.Table) -> pa.Table:
        told = [_unpacked(p) for p in rows.column("payload").to_pylist()]
        keys, counts = _summed(*(np.concatenate(c) for c in zip(*told, strict=True)))
        keys, counts = keys[counts > 0], counts[counts > 0]
        answers = []
        for wanted, _ in told:
            contexts = np.unique(wanted >> np.uint64(8))
            at = np.minimum(np.searchsorted(contexts, keys >> np.uint64(8)), len(contexts) - 1)
            mine = contexts[at] == keys >> np.uint64(8)
            answers.append(_packed(keys[mine], counts[mine]))
        return rows.set_column(rows.column_names.index("payload"), "payload", pa.array(answers, pa.binary()))

    return asked.groupBy("block").applyInArrow(add, asked.schema)


def _sums(chunks: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """k1, k2, n_bytes, n_words, known, logs, score: per text the sum of log10(c + 0.1) over its
    words, and what the byte model gives it."""
    asked = chunks.select("chunk", F.posexplode("words").alias("pos", "word"))
    none = F.lit(None).cast("binary").alias("payload")
    zero = F.lit(0).cast("long")
    answers = asked.join(counts, "word").select(
        "chunk", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"), "count", zero.alias("n_texts"), none
    )
    followers = _followers(chunks).select(
        "chunk", F.lit(1).alias("kind"), F.col("block").alias("pos"), zero.alias("count"), zero.alias("n_texts"), "payload"
    )
    texts = chunks.select("chunk", F.lit(2).alias("kind"), zero.alias("pos"), zero.alias("count"), "n_texts", "payload")
    # The counts of a chunk come first, in the order of its words; then what followed; then its texts.
    order = ["chunk", "kind", "pos"]
    partitions = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = answers.union(followers).union(texts).repartition(partitions, "chunk").sortWithinPartitions(*order)
    schema = fields(k1="long", k2="long", n_bytes="long", n_words="long", known="long", logs="double", score="double")

    def done(c: np.ndarray, told: list[bytes], payload: bytes, n: int) -> pa.RecordBatch:
        keys, texts = _read_payload(payload, n)
        _, tokens = _numbered(texts)
        lengths = np.array([len(t) for t in tokens], np.int64)
        every = np.concatenate([np.empty(0, np.uint32), *tokens])
        sums = np.zeros((2, len(every) + 1))
        if len(every):
            np.cumsum(np.log10(c + 0.1)[every], out=sums[0, 1:])
            np.cumsum((c > 0)[every], out=sums[1, 1:])
        ends = np.cumsum(lengths)
        logs, known = sums[:, ends] - sums[:, ends - lengths]
        parts = [_unpacked(p) for p in told] or [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        model = ContextModel(*_summed(*(np.concatenate(p) for p in zip(*parts, strict=True))), depth)
        sizes = np.array([len(t) for t in texts], np.int64)
        arrays = [keys[:, 0], keys[:, 1], sizes, lengths, known.astype(np.int64), logs, model.scores(texts)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        told: list[bytes] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            count = batch.column("count").to_numpy()
            start = 0
            for at in np.flatnonzero(kind):
                gathered.append(count[start:at])
                start = at + 1
                payload = batch.column("payload")[at].as_py()
                if kind[at] == 1:
                    told.append(payload)
                    continue
                yield done(np.concatenate(gathered), told, payload, batch.column("n_texts")[at].as_py())
                gathered, told = [], []
            gathered.append(count[start:].copy())

    return together.mapInArrow(run, schema)


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per row of docs: id, train, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    `train` (over the columns of docs) tells the rows to learn from; null is false. Words are split
    at ASCII white space, A-Z in lower case, and each text has one end token more. base_score is
    the smoothed unigram log10 probability, score that of the byte model, whose contexts have up to
    `depth` bytes (4 at most), for the text and its end.
    Null and empty texts have the end alone. Repeated rows count and score each; without training
    rows both models are uniform over what is left; an empty table stays empty. Word counts and
    bytes of very long texts are all read. Words are known by 64-bit hashes.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("given"),
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        whole_text(text).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // (2 * chunk_bytes)
    chunks = checkpointed(_chunks(rows.drop("given"), chunk_bytes, depth, blocks))
    asked = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counts = asked.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("count"))
    counts = checkpointed(counts)
    facts = counts.agg(F.sum("count").alias("n"), F.count(F.when(F.col("count") > 0, 1)).alias("v")).first()
    ends = chunks.agg(F.sum("n_train")).first()[0] or 0
    n, v = (facts["n"] or 0) + ends, facts["v"] + (ends > 0)

    def setup():
        def work(texts, ids):
            keys = [_key(t.as_py().lower(), i) for t, i in zip(text_bytes(texts), ids.to_pylist(), strict=True)]
            return [k[0] for k in keys], [k[1] for k in keys]

        return work

    named = add_columns(rows, ["text", "id"], fields(k1="long", k2="long"), setup, ["given", "train"])
    sums = _sums(chunks, counts, depth).dropDuplicates(["k1", "k2"])
    n_tokens = F.col("n_words") + 1
    at_end = F.log10(F.lit(ends + 0.1))
    per_token = F.log10(F.lit(n + 0.1 * (v + 1)))
    return named.join(sums, ["k1", "k2"]).select(
        F.col("given").alias(id_col),
        "train",
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + at_end - n_tokens * per_token).alias("base_score"),
        "score",
        (-F.col("score") * F.log2(F.lit(10.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def held_in(doc_id: Column, parts: int, out: int) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo parts, is not `out`."""
    return remainder(doc_id, parts) != out
