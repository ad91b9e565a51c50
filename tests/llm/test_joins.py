"""Operators that compare texts with each other, and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import decontaminate, exact_dedup, jaccard, language_model
from tagloom.llm.components import connected_components
from tagloom.llm.oracle import ALL
from tagloom.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ALL))
def test_queries_equal_their_sql(spark, name):
    got = all_queries()[name](spark, SMALL)
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
        found = db.execute(ALL[name])
        names, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(names).collect())) == Counter(want) and want


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block_bytes,hash_bits", [(8192, 64), (7, 64), (5, 2)])
def test_exact_duplicates_equal_grouping(spark, odd_docs, block_bytes, hash_bits):
    got = exact_dedup.exact_duplicates(odd_docs.where("doc_id is null or doc_id not in (6, 7)"), block_bytes=block_bytes, hash_bits=hash_bits).collect()
    rows = odd_docs.where("doc_id is null or doc_id not in (6, 7)").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[_normal(r["text"])].append(r["doc_id"])
    for text, ids in groups.items():
        mine = [g for g in got if g["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(g["doc_id"] is None for g in mine) == sorted(i is None for i in ids)
        known = [i for i in ids if i is not None]
        assert {(g["keep_id"], g["group_size"]) for g in mine} == {(min(known, default=None), len(ids))}
        assert sum(g["kept"] for g in mine) == 1
    assert exact_dedup.exact_duplicates(odd_docs.limit(0)).count() == 0


def test_keeping_first_rows(odd_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8]


def _windows(words, size=13):
    n = min(size, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def _hit_words(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, text_ in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text_ or ""))
        for win in set(_windows(w)):
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(words), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_equals_brute_force(spark, odd_docs, limit):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, "Beta gamma"), (3, ""), (4, None), (10, passage.upper()), (5, "漢字")]
    more = [(20, f"before {passage} after", None, None), (21, f"{passage}. {passage}", None, None), (22, "beta-gamma", None, None)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_hits(docs, benchmark, max_broadcast_words=limit).collect()
    wanted = []
    for r in docs.collect():
        n, hit, names = _hit_words(r["text"], items)
        wanted.append((str(r["doc_id"]), n, hit, hashlib.sha256(names.encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert sorted((str(g["doc_id"]), g["n_words"], g["n_hit"], g["items_sha256"], g["contaminated"]) for g in got) == sorted(wanted)
    clean = decontaminate.without_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in wanted)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs, benchmark).where("doc_id >= 20").collect()}
    assert cut == {20: "before after", 21: "", 22: ""}


def test_empty_benchmark_hits_nothing(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(odd_docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.without_contaminated(odd_docs, none).count() == odd_docs.count()


def test_decontamination_plan_is_native(spark):
    plan = all_queries()["op4_decontamination"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def _near_texts():
    pick = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n in (1, 2, 3, 5, 9, 10, 11, 12, 15, 20, 30, 60, 150, 400):
        base = [pick.choice(words) for _ in range(n)]
        for _ in range(7):
            changed = list(base)
            for _ in range(pick.randrange(0, max(2, n // 25) + 1)):
                k = pick.randrange(len(changed))
                changed[k : k + pick.randrange(2)] = [pick.choice(words)] * pick.randrange(3) or ["z"]
            texts.append(" ".join(changed))
    return texts + [texts[5].upper(), "", None, " ", texts[-1] + " tail"]


@pytest.mark.parametrize("percent,chunk", [(90, 256), (90, 3), (80, 256)])
def test_jaccard_join_equals_brute_force(spark, percent, chunk):
    texts = _near_texts()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        k = min(3, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    links = defaultdict(set)
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    least = list(range(len(texts)))
    for _ in texts:
        least = [min([least[i], *(least[j] for j in links[i])]) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_join(docs, percent=percent, chunk_classes=chunk).collect()
    assert sorted((g["doc_id"], g["n_shingles"], g["component_id"], g["n_links"]) for g in got) == [
        (i, len(s), least[i], len(links[i])) for i, s in enumerate(sets)
    ]


def test_linked_sets_share_a_tile():
    pick = np.random.default_rng(2)
    bands = jaccard.Bands(90)
    for n in [*range(9, 40), 71, 72, 107, 108, 500, 3000]:
        for _ in range(6):
            smaller = np.unique(pick.integers(0, 2**63, n, dtype=np.uint64))
            grown = pick.integers(0, 2**63, n // 9, dtype=np.uint64)
            larger = np.unique(np.concatenate([smaller, grown]))
            assert set(bands.tiles(smaller)) & set(bands.tiles(larger))


def test_one_of_each_component(odd_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "None"])
    assert jaccard.jaccard_join(odd_docs.limit(0)).count() == 0


def test_pipeline_drops_copies_over_four_fifths(spark):
    pick = random.Random(8)
    texts = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 3, 4, 5, 6):
            words = list(base)
            for at in pick.sample(range(10, 190, 10), changes):
                words[at] = f"other{len(texts)}x{at}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]

    def like(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    assert sum(0.8 <= like(a, b) < 0.9 for a, b in itertools.combinations(range(len(texts)), 2)) > 12
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in range(len(texts)) if like(i, j) >= 0.8) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect())
    assert kept == sorted(set(least)) and len(kept) < len(texts)


def test_pipeline_stages_take_empty_tables_and_odd_rows(spark, odd_docs):
    odd = odd_docs.withColumn("_key", F.lit("k")).withColumn("a.b", F.lit(None).cast("string"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SMALL).count() == 0, name
        made = stage(spark, odd, SMALL)
        if name != "BPE encoding":
            assert made.columns == odd.columns, name
        left[name] = Counter(r["doc_id"] for r in made.collect())
    every = Counter(r["doc_id"] for r in odd.collect())
    assert all(not found - every for found in left.values())
    # 2 and the null id have the text of 1; 4 has none, as 3, and a blank is no empty text.
    assert left["exact dedup"] == Counter([1, 3, 5, 6, 7, 8])
    # Texts without words are linked with nothing; repeated rows are one, 7 is nearly 6.
    assert left["n-gram Jaccard join"] == Counter([1, 3, 4, None, 5, 6, 8])
    assert left["benchmark decontamination"] == left["BPE encoding"] == every
    good = left["quality classifier"]
    assert good[2] in (0, 2) and len({good[i] > 0 for i in (3, 4, 5)}) == 1


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    hub = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*path, *hub, (200, 200), (301, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert connected_components(edges.limit(0)).count() == 0


def _held_in(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


@pytest.mark.parametrize("at_once", [1, 7, 10**6])
def test_slices_of_windows_give_the_same(monkeypatch, at_once):
    texts = [b"abcabcabd", b"", b"ab", "é a".encode(), b"abcabc"]
    learnt = [True, True, False, True, False]
    whole = language_model._counted(texts, learnt, 3)
    scores = language_model.ContextModel(*(c[whole[1] > 0] for c in whole), 3).scores(texts)
    monkeypatch.setattr(language_model, "_WINDOWS_AT_ONCE", at_once)
    sliced = language_model._counted(texts, learnt, 3)
    assert all((a == b).all() for a, b in zip(whole, sliced))
    assert language_model.ContextModel(*(c[whole[1] > 0] for c in whole), 3).scores(texts) == pytest.approx(scores)


@pytest.mark.parametrize("chunk_bytes, depth", [(16_000_000, 4), (20, 4), (20, 2), (300, 1)])
def test_language_model_equals_brute_force(spark, odd_docs, chunk_bytes, depth):
    docs = odd_docs.where("doc_id is null or doc_id not in (6, 7)")
    rows = docs.select("doc_id", "text").collect()
    lower = [(i, (t or "").encode().lower()) for i, t in rows]
    train = [t for i, t in lower if _held_in(i)]
    c = Counter(w for t in train for w in [*t.split(), "end"])
    n, v = sum(c.values()), len(c)
    contexts = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in train:
        b = [*[0xFE] * depth, *t, 0xFF]
        for j in range(depth, len(b)):
            for k in range(depth + 1):
                contexts[k][tuple(b[j - k : j])][b[j]] += 1

    def ppm(t):
        b, total = [*[0xFE] * depth, *t, 0xFF], 0.0
        for j in range(depth, len(b)):
            out, p = set(), 1.0
            for k in range(depth, -1, -1):
                left = {s: m for s, m in contexts[k][tuple(b[j - k : j])].items() if s not in out}
                if not left:
                    continue
                scale = sum(left.values()) + len(left)
                if b[j] in left:
                    p *= left[b[j]] / scale
                    break
                p *= len(left) / scale
                out |= set(left)
            else:
                p /= 256 - len(out)
            total += math.log10(p)
        return total

    def base(t):
        return sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), "end"])

    got = language_model.score_texts(docs, language_model.held_in(F.col("doc_id"), 10, 0), chunk_bytes=chunk_bytes, depth=depth).collect()
    wanted = [(str(i), len(t.split()) + 1, base(t), ppm(t)) for i, t in lower]
    for g, w in zip(sorted((str(g["doc_id"]), g["n_tokens"], g["base_score"], g["score"]) for g in got), sorted(wanted), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-5)
    assert {g["train_tokens"] for g in got} == {n}


def test_shares_of_the_context_model_sum_to_one():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    model = language_model.ContextModel(*language_model._counted(texts, [True] * 30, 3), 3)
    for context in (b"abc", b"xab", b"yyc", b"zzz", bytes([0xFE] * 3)):
        windows = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert np.power(10.0, model.log10(windows)).sum() == pytest.approx(1)


def test_texts_learnt_from_score_better_than_new_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scored = language_model.score_texts(docs, language_model.held_in(F.col("doc_id"), 10, 0))
    bits = {r["train"]: r["b"] for r in scored.groupBy("train").agg(F.avg("bits_per_byte").alias("b")).collect()}
    assert bits[True] < bits[False] < 2.6


def test_language_model_without_training_rows(spark, odd_docs):
    scored = language_model.score_texts(odd_docs, F.lit(False)).collect()
    assert len(scored) == odd_docs.count() and {r["n_known"] for r in scored} == {0}
    assert language_model.score_texts(odd_docs.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "n_tokens", "ids"} <= set(rows.columns) and rows.count() == before
