"""Repeated bytes, ranked search and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagloom.llm import ranking, repeats, suffixes, variants


def test_merged_runs_are_in_order_and_know_their_prefixes():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [suffixes.decoded(*suffixes.front_coded(r)) for r in runs]
    found = list(suffixes.merged(coded))
    assert [s for _, _, s in found] == sorted(s for r in runs for s in r)
    for k, run in enumerate(runs):
        assert [s for r, _, s in found if r == k] == run
    for (_, _, a), (_, n, b) in zip(found, found[1:]):
        assert n == suffixes.common_prefix(a, b)
    assert not list(suffixes.merged([])) and not list(suffixes.merged([iter(())]))


def _repeated(texts, size):
    """Removed bytes of each text, by all windows of all texts."""
    places = defaultdict(list)
    for t, raw in enumerate(texts):
        for i in range(len(raw) - size + 1):
            places[raw[i : i + size]].append((t, i))
    gone = [[False] * len(raw) for raw in texts]
    for found in places.values():
        if len(found) > 1:
            for t, i in found:
                gone[t][i : i + size] = [True] * size
    return gone


def _copied_texts(rng):
    words = ["".join(rng.choice("abcdéö") for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [prose(12) for _ in range(4)]
    texts = [prose(20) + rng.choice(passages)[rng.randint(0, 9) :] + prose(rng.randint(0, 20)) for _ in range(40)]
    return texts + [texts[0], texts[1][5:], "x" * 300, "xy" * 90, "x" * 30, "", None, " ".join(passages), passages[0] + passages[0]]


@pytest.mark.parametrize(
    "window,gram,bounds",
    [
        (24, 8, {}),
        (24, 8, {"chunk_bytes": 700, "piece_bytes": 150, "block_hashes": 20, "merge_bytes": 500}),
        (24, 8, {"chunk_bytes": 700, "block_hashes": 20, "merge_bytes": 500, "hot": 2}),
        (10, 10, {"chunk_bytes": 2000, "piece_bytes": 64, "hot": 1}),
    ],
)
def test_repeated_bytes_equal_brute_force(spark, window, gram, bounds):
    texts = _copied_texts(random.Random(window))
    rows = [(i if i % 9 else None, t, "b", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, part int")
    found = repeats.repeated_bytes(docs, window=window, gram=gram, **bounds).collect()
    raws = [(t or "").encode() for t in texts]
    wanted = []
    for (i, _, _, _), raw, gone in zip(rows, raws, _repeated(raws, window), strict=True):
        edges = [k for k in range(len(raw) + 1) if (gone[k] if k < len(raw) else False) != (gone[k - 1] if k else False)]
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        wanted.append((i, len(raw), sum(gone), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2], edges[1::2]))
    assert Counter(map(repr, wanted)) == Counter(repr(tuple(r)) for r in found)


def test_repeated_bytes_of_odd_rows(spark, odd_docs):
    found = repeats.repeated_bytes(odd_docs)
    assert {(r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in found.collect() if r["n_removed"]} == {(6, 0), (7, 4)}
    assert repeats.repeated_bytes(odd_docs.limit(0)).count() == 0


def _words(rows, shortest, least, every):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def _variants(counts):
    near = {w: [v for v in counts if v != w and _one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    found = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return found


@pytest.mark.parametrize("shortest,every,block_words,block_points", [(7, 31, 512, 1 << 18), (3, 2, 3, 40), (1, 3, 2, 5)])
def test_spelling_variants_equal_brute_force(spark, shortest, every, block_words, block_points):
    rng = random.Random(shortest)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 11))) for _ in range(40)] + ["A" * 9, "aaaaaaab", "ÀÉbcdefg", "x" * 90]

    def spoilt(w):
        at = rng.randrange(len(w))
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÉ") + w[at:], w[:at] + rng.choice("abc") + w[at + 1 :], w])

    texts = []
    for _ in range(60):
        words = [rng.choice(stems[:6]) if rng.random() < 0.6 else spoilt(rng.choice(stems)) for _ in range(60)]
        texts.append(rng.choice([" ", "-", "漢"]).join(words))
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*texts, texts[0], None, "", "x" * 90 + " " + "x" * 91])]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    found = variants.spelling_variants(docs, shortest=shortest, every=every, block_words=block_words, block_points=block_points)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = _variants(_words(rows, shortest, 2, every))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert shortest == 7 or any(r[1] for r in got)
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_sparse_table_finds_the_greatest():
    values = np.random.default_rng(1).integers(0, 9, 37)
    table = ranking.SparseTable(values)
    for low in range(37):
        for high in range(low + 1, 38):
            at = table.at(low, high)
            assert low <= at < high and values[at] == values[low:high].max()


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked(docs, items, k):
    held = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = Counter()
    for item, text in items:
        scores = []
        for i, counts in held:
            m = 25 + (75 * counts.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in _terms(text)
            )
            if score > 0:
                scores.append((-score, i is None, i))
        found.update((item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1))
    return found


@pytest.mark.parametrize("bounds", [{}, {"shard_docs": 13, "leaf_docs": 1, "block_terms": 9}, {"shard_docs": 1000, "leaf_docs": 3}])
def test_ranked_documents_equal_brute_force(spark, bounds):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["É", "漢字", "Mixed"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return rng.choice([" ", ".", "-"]).join(rng.choices(words, weights, k=n))

    docs = [(rng.choice([None, 7, -3, i]) if i % 10 == 0 else i, text(rng.randint(1, 60))) for i in range(120)]
    docs += [docs[5], docs[5], (500, ""), (501, None), (502, "!!"), (503, "mixed " * 3000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(9)] + [(3, "w1 w1 mixed"), (20, ""), (None, "W2"), (21, None), (22, "absent")]
    found = ranking.rank_documents(
        spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, terms string").repartition(3),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, rank int"),
        k=4,
        **bounds,
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == _ranked(docs, items, 4)


def test_ranking_of_empty_tables(spark, odd_docs):
    items = spark.createDataFrame([(1, "alpha")], "item_id int, text string")
    assert ranking.rank_documents(odd_docs.limit(0), items).count() == 0
    assert ranking.rank_documents(odd_docs, items.limit(0)).count() == 0
