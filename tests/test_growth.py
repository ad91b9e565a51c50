"""Steps whose cost once grew faster than their input, or that did the same work several times."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagloom.functions import labels as L
from tagloom.functions import prompts as P
from tagloom.functions.text import TOKEN_SEPARATOR, tokenize
from tagloom.operators import requests, similar, vectors
from tagloom.operators.requests import Made
from tagloom.plans.prompts import _section_keys
from workload import queries as Q
from workload.corpus import Corpus, corpus, derive_posts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_posts_are_hashed_not_sorted(spark, sf_dir):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        text = derive_posts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "SortMergeJoin" not in text and text.count("ShuffledHashJoin") == 3
    # The joined tags are never moved.
    assert not [x for x in text.splitlines() if "Exchange" in x and "o_custkey" in x and "general" in x]


def test_sections_build_on_each_other_once(spark):
    tokens = F.array(*(F.lit(t) for t in "abcd"))
    df = spark.range(1, 3).select(F.transform(tokens, lambda t: F.concat(t, F.col("id").cast("string"))).alias("t"))
    text = plan(df.select(P.cut_sections(F.col("t"), ["b1", "c1", "d1"]).alias("p")))
    assert text.count("array_position") == 1


@pytest.mark.parametrize(
    ("tokens", "wanted"),
    [
        (["a", "x", "b", "y", "c"], (["a"], ["b"], [])),
        (["x", "y", "z"], ([], [], [])),
        (["y", "x", "z"], (["y"], None, None)),
        (["x", "z", "y"], ([], ["z"], None)),
        (["a", None, "x"], (["a", None], None, None)),
        (["y", "z"], (None, None, None)),
        ([], (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_sections_of_odd_lists(spark, tokens, wanted):
    df = spark.createDataFrame([([*tokens, "z"] if tokens and tokens[-1] == "c" else tokens,)], "t array<string>")
    found = df.select(P.cut_sections(F.col("t"), ["x", "y", "z"]).alias("p")).first()["p"]
    wanted = (["a"], ["b"], ["c"]) if tokens and tokens[-1] == "c" else wanted
    assert tuple(found) == wanted


def test_masked_labels_draw_once(spark):
    df = spark.range(3).select("id", F.sequence(F.lit(1), F.col("id") + 5).cast("array<int>").alias("ids"))
    both = df.select("id", L.masked_token_labels("ids", [0], 1, 50, 7).alias("both"))
    assert plan(both.select("both.input_ids", "both.labels")).count("md5(") == 1


def test_tokens_of_odd_texts(spark):
    texts = ["", ",", "a", "A, b", "a,b,, c", "a,  b", " a,b ", "a,\tb,　c", "a , b", ", ,a", "a,\n, b", ",,", "a,  b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    rows = df.select("text", tokenize(F.col("text")).alias("t")).collect()
    for row in rows:
        wanted = None if row["text"] is None else [t for t in re.split(TOKEN_SEPARATOR, row["text"].lower()) if t]
        assert row["t"] == wanted
    # Texts of plain commas are cut without a pattern.
    assert "split(replace(" in plan(df.select(tokenize(F.col("text"))))


def test_section_keys_of_odd_texts(spark):
    texts = ["a, b", "a,  b", "a, \tb,c", "a,\nb", "", ", a", "b,,  c"]
    df = spark.createDataFrame([(t, u) for t in texts for u in texts], "copyright string, character string")
    for row in df.select("copyright", "character", _section_keys().alias("k")).collect():
        wanted = set()
        for text in (row["copyright"], row["character"]):
            for part in (text, *text.split(", ")):
                wanted.update(t for t in re.split(TOKEN_SEPARATOR, part) if t)
        assert set(row["k"]) == wanted and len(row["k"]) == len(wanted)


def test_nearest_takes_slices_of_a_shard(monkeypatch):
    draw = np.random.default_rng(3)
    matrix = draw.normal(size=(9000, 4)).astype(np.float32)
    matrix[8000:8600] = matrix[:600]  # equal ones in different slices
    matrix[5] = 0
    ids = draw.permutation(9000)
    found = pd.DataFrame({"token_id": ids, "token": [f"t{i}" for i in ids], "embedding": list(matrix)})
    asked = pd.DataFrame({"query": [f"t{i}" for i in ids[:700]], "wanted": list(matrix[:700])})
    widths, first_k = [], vectors._first_k

    def seen(sim, *rest):
        widths.append(sim.shape[1])
        return first_k(sim, *rest)

    monkeypatch.setattr(vectors, "_first_k", seen)
    made = vectors.nearest(asked, found, 7)
    assert max(widths) <= 4096
    units = vectors.unit(matrix.astype(np.float64))
    for at in (0, 5, 300, 699):
        sim = np.round(units @ units[at], 9)
        order = np.lexsort((ids, np.where(np.isnan(sim), np.inf, -sim)))[:7]
        assert made.iloc[at * 7 : at * 7 + 7]["token_id"].tolist() == ids[order].tolist()


def test_lengths_are_not_made_per_component(spark, monkeypatch):
    made = []
    monkeypatch.setattr(similar, "fit_clusters", lambda units, *a: made.append(units) or similar_stop())
    df = spark.createDataFrame([(0, "a", [1.0, 2.0])], "token_id int, token string, embedding array<float>")
    with pytest.raises(StopIteration):
        similar.sharded(df, 2)
    scaled = re.search(r"transform\(array\(sqrt\(aggregate|transform\(array\(SQRT\(aggregate", plan(made[0]))
    assert scaled and made[0].first()["embedding"] == pytest.approx([0.4472136, 0.8944272])


def similar_stop():
    raise StopIteration


def test_cluster_check_joins_vectors_once(spark, sf_dir, monkeypatch):
    made, vectors_of = [], Corpus.vectors.fget
    monkeypatch.setattr(Corpus, "vectors", property(lambda self: made.append(1) or vectors_of(self)))
    found = Q.kmeans_map(corpus(spark, sf_dir))
    assert len(made) == 1 and found.where("not (in_range and nearest and cheapest)").isEmpty()


def test_looked_up_vectors_stay_in_the_task_that_fills_them(spark, sf_dir):
    text = plan(Q.vector_lookup(corpus(spark, sf_dir)))
    assert text.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow" not in text


@pytest.mark.parametrize(
    "lists",
    [
        [[1.0, 2.0], [3.0, None], [5.0, 6.0]],
        [[1.0], [2.0, 3.0], []],
        [[], [], []],
        [[1.0], None, [2.0]],
        [None, None, None],
    ],
)
def test_lists_of_any_length_are_taken(lists):
    kind = pa.list_(pa.field("element", pa.float32()))
    values = pa.array([[9.0], *lists], kind).slice(1)
    places = [2, None, 0, 0, 1]
    found = requests._taken(values, pa.array(places, pa.int32()))
    wanted = [None if i is None else lists[i] for i in places]
    assert found.type == kind and found.to_pylist() == wanted
    flat = [x for v in wanted for x in v or []]
    assert found.flatten().to_pylist() == flat
    none = requests._taken(values.slice(0, 0), pa.array([None], pa.int32()))
    assert none.type == kind and none.to_pylist() == [None]


def test_lists_of_one_length_are_taken_as_blocks(monkeypatch):
    made, blocks = [], pa.FixedSizeListArray

    class Seen:
        @staticmethod
        def from_arrays(*args):
            made.append(args[1])
            return blocks.from_arrays(*args)

    monkeypatch.setattr(requests.pa, "FixedSizeListArray", Seen)
    requests._taken(pa.array([[1.0, 2.0], [3.0, 4.0]]), pa.array([1]))
    assert made == [2]


@pytest.mark.parametrize("cells", [1, 1 << 15])
def test_digests_of_looked_up_vectors(spark, monkeypatch, cells):
    monkeypatch.setattr(Q, "DIGEST_CELLS", cells)
    draw = np.random.default_rng(5)
    known = {i: draw.normal(size=3).astype(np.float32) for i in (0, 1, 2, 7)}
    some = spark.createDataFrame([(i, v.tolist()) for i, v in known.items()], "token_id int, embedding array<float>")
    lists = [(1, [7, 0, 7]), (1, [7, 0, 7]), (2, [5, 1]), (3, [5]), (4, []), (5, None), (None, [None, 2])]
    rows = spark.createDataFrame(lists, "id long, ids array<int>").repartition(2)
    made = vectors.lookup_vectors(rows, "ids", some, "digests", Made(Q._digests, StringType()))

    def digest(i):
        whole = np.floor(known[i].astype(np.float64) * 10_000 + 0.5).astype(int) if i in known else None
        return "-" if whole is None else str(whole @ [1, 2, 3])

    wanted = [(i, ids, " ".join(digest(x) for x in ids or [])) for i, ids in lists]
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, wanted))


def test_digests_of_no_vectors():
    lists = pa.array([[None, None], [], None], pa.list_(pa.list_(pa.float32())))
    assert Q._digests(lists).to_pylist() == ["- -", "", ""]
    assert Q._digests(lists.slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize(
    ("name", "n_columns"),
    [
        ("vector_lookup", 2),
        ("encode_tags", 2),
        ("encode_tags_joined", 2),
        ("drop_unknown", 2),
        ("mlm_labels", 2),
        ("unknown_reject", 3),
    ],
)
def test_requests_carry_the_columns_in_use(spark, sf_dir, monkeypatch, name, n_columns):
    carried, staged = [], requests.staged

    def seen(table, *rest):
        carried.append(len(table.schema["row"].dataType))
        return staged(table, *rest)

    monkeypatch.setattr(requests, "staged", seen)
    c = Corpus(spark, sf_dir)
    c.posts, c.vocab = corpus(spark, sf_dir).posts, corpus(spark, sf_dir).vocab
    c.encoder = c.joined_encoder
    getattr(Q, name)(c)
    assert carried[0] == n_columns
