"""Runs of strings in order: written front-coded, merged by a loser tree that keeps prefixes.

A string of a run is written as the length of the prefix it shares with the one before and the
rest. In the merge every head carries the length of the prefix it shares with the string given out
last. Of two heads the one that shares more comes first; only heads that share equally much are
compared, from there on, so no known prefix is read again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on the first `known` bytes."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[known:size], "big") ^ int.from_bytes(b[known:size], "big")
    return size - (differ.bit_length() + 7) // 8


def front_coded(strings: Sequence[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared lengths and whole lengths (32 bits each), and the rests, of strings in order."""
    shared = np.zeros(len(strings), np.int32)
    rests = []
    before = b""
    for i, s in enumerate(strings):
        shared[i] = n = common_prefix(before, s)
        rests.append(s[n:])
        before = s
    lengths = np.fromiter(map(len, strings), np.int32, len(strings))
    return shared.tobytes(), lengths.tobytes(), b"".join(rests)


def decoded(shared: bytes, lengths: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(length of the prefix shared with the one before, string) of a front-coded run."""
    at, before = 0, b""
    for n, size in zip(np.frombuffer(shared, np.int32).tolist(), np.frombuffer(lengths, np.int32).tolist(), strict=True):
        before = before[:n] + rests[at : at + size - n]
        at += size - n
        yield n, before


def merged(runs: Sequence[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, length of the prefix shared with the string before, string) of all runs in order.

    Each run gives (length of the prefix shared with its string before, string). Equal strings
    come one after the other.
    """
    count = len(runs)
    if not count:
        return
    leaves = 1 << (count - 1).bit_length()
    heads: list[bytes | None] = [None] * leaves
    shared = [0] * leaves
    for run, strings in enumerate(runs):
        heads[run] = next(strings, (0, None))[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * leaves
    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if leaves > 1 else 0
    while heads[best] is not None:
        yield best, shared[best], heads[best]
        # What the next string of the run shares with the one given out is known from the run.
        shared[best], heads[best] = next(runs[best], (0, None))
        node = (best + leaves) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
