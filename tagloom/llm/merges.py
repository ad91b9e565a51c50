"""Byte-pair merging of single words over a heap and a linked list."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex
from tokenizers import Tokenizer

from tagloom.llm.common import Memo

#: Texts below U+0250 are in normal form C and their lower case is the same everywhere.
_NOT_LATIN = re.compile("[^\x00-ɏ]")
#: Python's split() also splits at these, which are no white space for the tokenizers.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile("[\t-\r ]+")
_END = "</w>"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as is, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeTable:
    """The merges of a tokenizer file and how it cuts a text into the pieces they work on.

    Made for vocabularies with word ends whose pieces hold no white space, so a text may be cut
    at any white space without changing its tokens.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + _END] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.rank, self.left, self.right, self.merged = {}, [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] << 32 | ids[b]] = rank
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.merged.append(ids[a + b])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(split).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def pieces(self, field: str) -> list[bytes]:
        """What a field without special tokens is cut into, normalised."""
        if _NOT_LATIN.search(field) is None:
            field = field.lower()
            return [field.encode()] if field.isalpha() else [p.encode() for p in self._pieces(field)]
        normal = self.tokenizer.normalizer.normalize_str(field)
        byte_of = self.byte_of.__getitem__
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(byte_of, piece)) for piece, _ in cut]

    def merge(self, piece: bytes) -> tuple[list[int], int]:
        """The symbols of a piece, -1 where one was merged into the one before, and the number of
        merges: the pair of lowest rank first, the leftmost of equals."""
        n = len(piece)
        inner = self.inner
        symbols = [inner[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        if n == 1:
            return symbols, 0
        rank_of, left, right, merged = self.rank.get, self.left, self.right, self.merged
        width = n.bit_length()
        mask = (1 << width) - 1
        found = [rank_of(a << 32 | b) for a, b in zip(symbols, symbols[1:], strict=False)]
        heap = [r << width | i for i, r in enumerate(found) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> width
            j = after[i]
            # A pair whose parts have been merged meanwhile is out of date.
            if symbols[i] != left[r] or j >= n or symbols[j] != right[r]:
                continue
            new = symbols[i] = merged[r]
            symbols[j] = -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_of(new << 32 | symbols[k])
                if r is not None:
                    heappush(heap, r << width | i)
            h = before[i]
            if h >= 0:
                r = rank_of(symbols[h] << 32 | new)
                if r is not None:
                    heappush(heap, r << width | h)
        return symbols, merges


def text_fields(text: str) -> list[str]:
    """The text between white space."""
    if _ODD_SPACE.search(text) is None:
        return text.split()
    return [f for f in _ASCII_SPACE.split(text) if f]


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class FieldReader:
    """A function of fields made from one of pieces and one of special tokens; it remembers."""

    def __init__(self, table: MergeTable, of_piece, of_special, join) -> None:
        self.table, self.of_special, self.join = table, of_special, join
        self.of_piece = Memo(of_piece, 150_000)
        self.of_field = Memo(self._field, 100_000)

    def _plain(self, field: str):
        return self.join(map(self.of_piece.__getitem__, self.table.pieces(field)))

    def _field(self, field: str):
        if "<|" not in field or not self.table.special_at.search(field):
            return self._plain(field)
        found, at = [], 0
        for m in self.table.special_at.finditer(field):
            found += [self._plain(field[at : m.start()]), self.of_special(m.group())]
            at = m.end()
        return self.join([*found, self._plain(field[at:])])

    def __call__(self, text: str):
        return self.join(map(self.of_field.__getitem__, text_fields(text)))
