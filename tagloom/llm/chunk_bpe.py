"""Encoding with reuse of content-defined chunks, and decoding.

Texts are cut where a rolling hash over the last bytes says so, hence equal passages are cut at
equal places in whatever text they stand. A chunk is encoded once per worker and remembered. At
each join the words around the cut are encoded again together; the outer words of that window
must give the tokens they had in their chunks, else the window grows over both chunks until they
do. White space never is part of a token here, so windows begin and end at it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tagloom.llm.common import Memo, add_columns, fields, text_bytes
from tagloom.llm.merges import FieldReader, merge_table

WINDOW = 32
#: A cut at one of 2 ** MASK_BITS places on average; chunks are MIN_CHUNK to MAX_CHUNK bytes.
MASK_BITS = 10
MIN_CHUNK, MAX_CHUNK = 512, 8192

#: Pseudo-random numbers for the bytes, the same on every machine.
_GEAR = np.array(
    [int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)],
    dtype=np.uint64,
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The cut word, white space, the first whole word and white space; and the same from behind.
_OUTER = re.compile("[^\t-\r ]*[\t-\r ]+([^\t-\r ]+)[\t-\r ]+")


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text, the last one being its length."""
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    data = np.frombuffer(raw, dtype=np.uint8)
    sums = np.cumsum(_GEAR[data], dtype=np.uint64)
    rolled = sums.copy()
    rolled[WINDOW:] -= sums[:-WINDOW]
    hit = (rolled * _MIX) >> np.uint64(64 - MASK_BITS) == 0
    ends, start = [], 0
    for end in (np.flatnonzero(hit[:-1]) + 1).tolist():
        while end - start > MAX_CHUNK:
            start = _character_start(raw, start + MAX_CHUNK)
            ends.append(start)
        if end - start >= MIN_CHUNK and (end := _character_start(raw, end)) < n:
            ends.append(end)
            start = end
    while n - start > MAX_CHUNK:
        start = _character_start(raw, start + MAX_CHUNK)
        ends.append(start)
    return [*ends, n]


def _character_start(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


@dataclass(frozen=True)
class Chunk:
    """Edges and inside of a chunk: head | first | inside | last | tail, each but the ends whole
    words. `inside` is None where a chunk has too few words to have one; `lead` then is all."""

    lead: str
    first: bytes = b""
    inside: bytes | None = None
    last: bytes = b""
    trail: str = ""


class ChunkEncoder:
    """Whole texts to ids, as 32-bit little-endian bytes, and back."""

    def __init__(self, path: str, limit: int = 8_000) -> None:
        table = merge_table(path)
        if table.tokenizer.decoder is not None:
            raise ValueError("only tokenizers whose tokens are joined by spaces are supported")
        names = {i: name for name, i in table.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

        def of_piece(piece: bytes) -> bytes:
            return array("I", [s for s in table.merge(piece)[0] if s >= 0]).tobytes()

        def of_special(token: str) -> bytes:
            return array("I", [table.special[token]]).tobytes()

        self.ids = FieldReader(table, of_piece, of_special, b"".join)
        self.chunks = Memo(self._chunk, limit, MAX_CHUNK + 4)

    def _chunk(self, raw: bytes) -> Chunk:
        text = raw.decode()
        left, right = _OUTER.match(text), _OUTER.match(text[::-1])
        if left is None or right is None or left.end() + right.end() >= len(text):
            return Chunk(text)
        a, b = left.end(), len(text) - right.end()
        first, last = left.group(1), right.group(1)[::-1]
        return Chunk(text[:a], self.ids(first), self.ids(text[a:b]), self.ids(last), text[b:])

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text: what encoding it in one piece gives."""
        pieces, start = [], 0
        for end in cut_points(raw):
            pieces.append(raw[start:end])
            start = end
        inner, windows = _laid_out([(p, self.chunks[p]) for p in pieces])
        while True:
            between = [self.ids(w) for w in windows]
            bad = {
                i
                for i, (_, c) in enumerate(inner)
                if not (between[i].endswith(c.first) and between[i + 1].startswith(c.last))
            }
            if not bad:
                break
            inner, windows = _widened(inner, windows, bad)
        parts = [between[0]]
        for (_, c), window in zip(inner, between[1:], strict=True):
            parts += [c.inside, window]
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids, special tokens included, in UTF-8."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


Placed = tuple[bytes, Chunk]


def _laid_out(chunks: list[Placed]) -> tuple[list[Placed], list[str]]:
    """Chunks that have an inside, and the texts before, between and after their insides."""
    inner, windows = [], [""]
    for raw, c in chunks:
        windows[-1] += c.lead
        if c.inside is not None:
            inner.append((raw, c))
            windows.append(c.trail)
    return inner, windows


def _widened(inner: list[Placed], windows: list[str], bad: set[int]) -> tuple[list[Placed], list[str]]:
    """The same without the insides of the chunks whose edges disagree."""
    kept, wider = [], [windows[0]]
    for i, (raw, c) in enumerate(inner):
        if i in bad:
            text = raw.decode()
            wider[-1] += text[len(c.lead) : len(text) - len(c.trail)] + windows[i + 1]
        else:
            kept.append((raw, c))
            wider.append(windows[i + 1])
    return kept, wider


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_texts(
    df: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    with_ids: bool = True,
    with_decoded: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and, if wished, ids and decoded to every row.

    Pure map: no shuffle. Null and empty texts have no ids and decode to the empty text. Repeated
    rows give equal results, an empty table stays empty; input columns of the names added are
    replaced. A very long text is encoded chunk by chunk and never cut off.
    """

    outputs = fields(n_tokens="long", ids_sha256="string", decoded_sha256="string")
    if with_ids:
        outputs.add("ids", ArrayType(IntegerType()))
    if with_decoded:
        outputs.add("decoded", StringType())

    def setup():
        encoder = chunk_encoder(tokenizer_path)

        def work(texts):
            raw = [t.as_py() for t in text_bytes(texts)]
            columns: list[list] = [[] for _ in outputs]
            for ids in map(encoder.encode, raw):
                decoded = encoder.decode(ids)
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                if with_ids:
                    row.append(np.frombuffer(ids, dtype="<i4"))
                if with_decoded:
                    row.append(decoded.decode())
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return columns

        return work

    return add_columns(df.withColumn(text, F.col(text).cast("string")), [text], outputs, setup, keep)
