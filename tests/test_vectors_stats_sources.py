import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import constants as C
from tagloom.functions import labels as L
from tagloom.operators import kmeans, similar, stats, vectors
from tagloom.plans.vectors import cluster_map
from tagloom.sources import readers, writers

SCHEMA = "token_id int, token string, embedding array<float>"


@pytest.fixture(scope="module")
def some(spark):
    draw = np.random.default_rng(3)
    matrix = draw.normal(size=(60, 8)).round(3)
    matrix[7] = 0.0
    matrix[11] = matrix[10]
    rows = [(i, f"t{i}", [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute_force(table, k):
    rows = sorted(table.collect(), key=lambda r: r["token_id"])
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    norm = np.linalg.norm(matrix, axis=1)
    found = {}
    for row, vector in zip(rows, matrix, strict=True):
        with np.errstate(invalid="ignore"):
            sim = np.round(matrix @ vector / (norm * np.linalg.norm(vector)), 9)
        order = sorted(range(len(rows)), key=lambda i: (np.isnan(sim[i]), -np.nan_to_num(sim[i]), i))
        found[row["token"]] = [rows[i]["token"] for i in order[:k]]
    return found


@pytest.mark.parametrize("max_bytes", [2**20, 8 * 8 * 20])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_similar_tags(spark, some, max_bytes, k):
    found = {}
    rows = vectors.similar_tags(some.select("token"), some, k, max_bytes).collect()
    for row in sorted(rows, key=lambda r: (r["query"], r["rank"])):
        found.setdefault(row["query"], []).append(row["token"])
    assert found == brute_force(some, k)


@pytest.mark.parametrize("k, pivots, block", [(1, 4, 3), (5, 6, 4096), (58, 6, 7), (100, 3, 4096)])
def test_pruned_search_equals_brute_force(spark, some, k, pivots, block):
    found = {}
    rows = similar.similar_tags_pruned(some.select("token"), some, k, pivots, block).collect()
    for row in sorted(rows, key=lambda r: (r["query"], r["rank"])):
        found.setdefault(row["query"], []).append(row["token"])
    assert found == brute_force(some, k)


def test_pruned_search_skips_shards_out_of_reach(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(8, 12))
    rows = [(i, f"t{i}", [float(x) for x in centres[i % 8] + 0.05 * draw.normal(size=12)]) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    visited = []
    found = similar.similar_tags_pruned(table.select("token"), table, 10, 8, visited=visited)
    whole = vectors.similar_tags(table.select("token"), table, 10)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    seen = sum(v.count() for v in visited)
    assert 400 <= seen < 400 * 8 / 3
    asked = spark.createDataFrame([("nobody",)], "token string")
    assert [tuple(r) for r in similar.similar_tags_pruned(asked, table, 3, 4).collect()] == [("nobody", None, None, None, None)]


def test_unknown_and_zero_queries(spark, some):
    asked = spark.createDataFrame([("nobody",), ("t7",)], "token string")
    rows = vectors.similar_tags(asked, some, 3).collect()
    assert [r["rank"] for r in rows if r["query"] == "t7"] == [1, 2, 3]
    assert all(r["similarity"] is None for r in rows)
    alone = vectors.similar_tags(asked.where("token = 'nobody'"), some, 3).collect()
    assert [tuple(r) for r in alone] == [("nobody", None, None, None, None)]


def test_clusters(spark, some):
    found = vectors.train_clusters(some, 4, n_init=2, max_iter=30, seed=1)
    labels = {r["token"]: r["cluster_id"] for r in found.collect()}
    assert len(labels) == 60 and set(labels.values()) <= set(range(4))
    again = vectors.train_clusters(some, 4, n_init=2, max_iter=30, seed=1)
    assert {r["token"]: r["cluster_id"] for r in again.collect()} == labels
    # Every vector lies closest to the centre of its own cluster.
    points = {r["token"]: np.array(r["embedding"]) for r in some.collect()}
    centres = {
        c: np.mean([points[t] for t in labels if labels[t] == c], axis=0)
        for c in set(labels.values())
    }
    off = sum(
        min(centres, key=lambda c: np.linalg.norm(points[t] - centres[c])) != labels[t]
        for t in labels
    )
    assert off == 0


def test_best_of_several_runs_is_kept(some):
    def cost(table):
        rows = some.join(table, "token").collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["cluster_id"], []).append(r["embedding"])
        return sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum() for g in groups.values())

    single = [cost(vectors.train_clusters(some, 5, 1, 30, seed=s)) for s in (1, 2, 3)]
    assert cost(vectors.train_clusters(some, 5, 3, 30, seed=1)) <= min(single) + 1e-6


def test_every_step_scans_the_vectors_once_for_all_runs(some, monkeypatch):
    steps = []
    sums = kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda points, runs: steps.append(len(runs)) or sums(points, runs))
    found = kmeans.fit_clusters(some, 4, n_init=3, max_iter=4, seed=1)
    # Two rounds of the start and its weights, the steps, and the costs at the end.
    assert len(steps) <= 3 + 4 + 1 and steps[:3] == [3, 3, 3] and steps[-1] == 3
    assert len(found.costs) == 3 and found.cost == min(found.costs)


def test_clusters_of_few_and_of_no_vectors(spark, some):
    few = some.where("token_id < 3")
    found = vectors.train_clusters(few, 5, n_init=2, max_iter=5)
    assert sorted(r["cluster_id"] for r in found.collect()) == [0, 1, 2]
    assert vectors.train_clusters(some.limit(0), 5, n_init=1).count() == 0


def test_a_failed_training_leaves_no_map(spark, some, tmp_path):
    broken = some.withColumn("token", F.when(F.col("token_id") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("token")))
    with pytest.raises(Exception, match="lost"):
        cluster_map(spark, str(tmp_path), lambda: broken, 3, n_init=1, max_iter=2)
    (tmp_path / "data").mkdir(exist_ok=True)
    found = cluster_map(spark, str(tmp_path), lambda: some, 3, n_init=1, max_iter=2)
    assert found.count() == 60


def test_same_cluster(spark):
    table = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "token string, cluster_id int")
    asked = spark.createDataFrame([("b",), ("x",)], "token string")
    rows = {tuple(r) for r in vectors.same_cluster(asked, table).collect()}
    assert rows == {("b", 0, "a"), ("b", 0, "b"), ("x", None, None)}
    members = {r["cluster_id"]: r["tags"] for r in vectors.cluster_members(table).collect()}
    assert members == {0: ["a", "b"], 1: ["c"]}


def test_transfer(spark, some):
    vocab = spark.createDataFrame([(0, "new"), (1, "t3"), (2, "t5")], "token_id int, token string")
    rows = {r["token"]: r for r in vectors.transfer_vectors(vocab, some, 8).collect()}
    old = {r["token"]: r["embedding"] for r in some.collect()}
    assert rows["t3"]["embedding"] == old["t3"] and rows["t3"]["copied"]
    assert not rows["new"]["copied"] and len(rows["new"]["embedding"]) == 8
    with pytest.raises(Exception, match="vector size differs"):
        vectors.transfer_vectors(vocab, some, 9).collect()


def test_drawn_vectors_are_normal(spark, some):
    vocab = spark.range(2000).select(
        F.col("id").cast("int").alias("token_id"), F.concat(F.lit("n"), "id").alias("token")
    )
    made = vectors.transfer_vectors(vocab, some, 16, initializer_range=0.02)
    cells = np.array([r["embedding"] for r in made.collect()])
    assert abs(cells.mean()) < 0.0005
    assert abs(cells.std() - 0.02) < 0.0005
    assert abs((np.abs(cells) < 0.02).mean() - 0.6827) < 0.01


@pytest.mark.parametrize("numbers", [2**17, 1])
def test_lookup_vectors(spark, some, numbers, monkeypatch):
    monkeypatch.setattr(vectors, "_CHUNK_NUMBERS", numbers)
    old = {r["token_id"]: r["embedding"] for r in some.collect()}
    lists = [(1, [3, 3, 5]), (2, []), (3, None), (4, [0, 999, 59]), (5, [7])]
    rows = spark.createDataFrame(lists, "id long, ids array<int>").repartition(3)
    found = {
        r["id"]: r["embeddings"]
        for r in vectors.lookup_vectors(rows, "ids", some).collect()
    }
    for key, ids in lists:
        assert found[key] == (None if ids is None else [old.get(i) for i in ids])


def test_special_vectors_can_be_left_out(spark, some):
    assert vectors.exclude_special(some, ["t1", "t2"]).count() == 58


# Statistics


def test_boundary_takes_the_next_rank_when_the_share_is_whole(make_posts):
    posts = make_posts(*[{"score": s, "rating": "g"} for s in range(10)])
    row = stats.boundary_scores(stats.score_counts(posts)).first()
    assert [row[f"b{i}"] for i in range(4)] == [1, 2, 7, 9]


@pytest.mark.parametrize("n", [1, 2, 3, 30, 77])
def test_order_statistics(make_posts, n):
    scores = [(i * i * 7) % 23 - 3 for i in range(n)]
    counts = stats.score_counts(make_posts(*[{"score": s} for s in scores]))
    ordered = sorted(scores)
    row = stats.boundary_scores(counts).first()
    assert [row[f"b{i}"] for i in range(4)] == [ordered[int(n * r)] for r in C.BOUNDARY_RATIOS]
    box = stats.score_boxplot(counts).first()
    q1, median, q3 = np.percentile(scores, [25, 50, 75])
    assert np.allclose([box["q1"], box["median"], box["q3"]], [q1, median, q3])
    bands = {r["band"]: r["n"] for r in stats.quality_bands(counts).collect()}
    assert sum(bands.values()) == n and set(bands) == set(range(5))


def test_whiskers(make_posts):
    scores = [1, 2, 3, 4, 5, 6, 7, 8, 100, -90]
    box = stats.score_boxplot(stats.score_counts(make_posts(*[{"score": s} for s in scores]))).first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 8.0, 2)


@pytest.mark.parametrize("low, high, bins", [(1, 1000, 100), (1, 400, 100), (0, 1000, 100), (1, 150, 150)])
def test_histogram_agrees_with_numpy(spark, low, high, bins):
    values = list(range(-5, high + 20)) + [high, low, high]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    rows = stats.histogram(df, "v", low, high, bins).orderBy("bin").collect()
    expected, edges = np.histogram(values, bins=bins, range=(low, high))
    assert [r["n"] for r in rows] == list(expected)
    assert np.allclose([r["left_edge"] for r in rows], edges[:-1])


# Labels


def test_label_edges(spark):
    rows = spark.createDataFrame(
        [(1, [5, 9, 6, 9, 7, 2]), (2, [5, 6, 7]), (3, [])], "id long, ids array<int>"
    )
    ids = F.col("ids")
    found = rows.select(
        "id",
        L.completion_labels(ids, 9, 2).alias("c"),
        L.causal_labels(ids, 2).alias("l"),
        L.pad_or_truncate(ids, 2, 4).alias("p"),
    )
    got = {r["id"]: (r["c"], r["l"], r["p"]) for r in found.collect()}
    no = C.IGNORE_LABEL
    assert got[1] == ([no, no, no, no, 7, no], [5, 9, 6, 9, 7, no], [5, 9, 6, 9])
    assert got[2] == ([no, no, no], [5, 6, 7], [5, 6, 7, 2])
    assert got[3] == ([], [], [2, 2, 2, 2])


def test_masking_shares(spark):
    rows = spark.range(2000).select("id", F.sequence(F.lit(0), F.lit(99)).alias("ids"))
    special = list(range(10))
    both = L.masked_token_labels("ids", special, 5, 1000, 1)
    chosen = masked = kept = 0
    for row in rows.select("ids", both.alias("m")).collect():
        for was, now, label in zip(row["ids"], row["m"]["input_ids"], row["m"]["labels"], strict=True):
            if label == C.IGNORE_LABEL:
                assert was == now
                continue
            assert label == was and was not in special and 0 <= now < 1000
            chosen += 1
            masked += now == 5
            kept += now == was
    assert abs(chosen / (2000 * 90) - 0.15) < 0.004
    assert abs(masked / chosen - 0.8) < 0.01
    assert abs(kept / chosen - 0.1) < 0.01


# Sources and sinks


def test_tag_group_files(spark, tmp_path):
    lists = {"people": "1girl\n2girls ", "focus": " solo", "watermark": "a\nb ", "artistic_error": "x"}
    for name, text in lists.items():
        (tmp_path / f"{name}.txt").write_text(text)
    from tagloom.operators.organize import TagGroups

    groups = TagGroups.from_table(readers.read_tag_groups(spark, str(tmp_path)))
    assert groups == TagGroups(("1girl", "2girls"), ("solo",), ("a", "b"), ("x",))


def test_cluster_map_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("青い髪", 3), ('a "b"', 0)], "token string, cluster_id int")
    path = str(tmp_path / "map")
    assert not readers.table_exists(spark, path)
    writers.write_cluster_map(table, path)
    assert readers.table_exists(spark, path)
    back = readers.read_cluster_map(spark, path)
    assert sorted(back.collect()) == sorted(table.collect())


def test_get_or_train(spark, some, tmp_path):
    path = str(tmp_path / "trained")
    calls = []

    def source():
        calls.append(1)
        return some

    first = cluster_map(spark, path, source, 3, n_init=1, max_iter=10).collect()
    second = cluster_map(spark, path, source, 3, n_init=1, max_iter=10).collect()
    assert sorted(first) == sorted(second) and len(first) == 60 and calls == [1]


def test_json_object_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("b", 2), ("é", 5)], "token string, cnt long")
    path = str(tmp_path / "object")
    writers.write_json_object(table, "token", "cnt", path)
    (part,) = [p for p in (tmp_path / "object").iterdir() if not p.name.startswith(".")]
    assert json.loads(part.read_text()) == {"b": 2, "é": 5}
    back = readers.read_json_object(spark, path, "token", "cnt")
    assert sorted(back.collect()) == sorted(table.collect())


def test_indented_json_object(spark, tmp_path):
    file = tmp_path / "map.json"
    file.write_text(json.dumps({"a": 1, "b c": 2}, indent=2))
    back = readers.read_json_object(spark, str(file), "token", "cluster_id", "int")
    assert {r["token"]: r["cluster_id"] for r in back.collect()} == {"a": 1, "b c": 2}


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 0}])
def test_one_json_object_is_read_by_several_tasks(spark, tmp_path, form):
    entries = {f"tag {i} {'é' * (i % 3)}\\ \"{i}\", {{}}": i * 7 for i in range(3000)}
    file = tmp_path / "map.json"
    file.write_text(json.dumps(entries, **form))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        back = readers.read_json_object(spark, str(file), "token", "n")
        assert back.rdd.getNumPartitions() > 3
        assert {r["token"]: r["n"] for r in back.collect()} == entries and back.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("entries", [{}, {"a": 1}, {"a, b": 1, "c,d": 2}])
def test_small_json_objects(spark, tmp_path, entries):
    (tmp_path / "map.json").write_text(json.dumps(entries))
    back = readers.read_json_object(spark, str(tmp_path / "map.json"), "token", "n")
    assert {r["token"]: r["n"] for r in back.collect()} == entries


def test_a_key_that_ends_with_a_comma_is_refused_and_not_misread(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"a": 1, "b, ": 2, "c": 3}))
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_json_object(spark, str(tmp_path / "map.json"), "token", "n").collect()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_json_objects_written_by_several_tasks(spark, tmp_path, n):
    table = spark.range(n).select(F.concat(F.lit('k"\\, '), F.col("id").cast("string")).alias("token"), "id").repartition(4)
    writers.write_json_object(table, "token", "id", str(tmp_path / "o"))
    text = (tmp_path / "o" / "object.json").read_text()
    assert json.loads(text) == {f'k"\\, {i}': i for i in range(n)}
    back = readers.read_json_object(spark, str(tmp_path / "o"), "token", "id")
    assert sorted(back.collect()) == sorted(table.collect())


def test_split_files(spark, tmp_path):
    rows = spark.range(100).repartition(4).select(
        "id",
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
        F.when(F.col("id") < 10, "test").otherwise("train").alias("split"),
    )
    path = str(tmp_path / "set")
    writers.write_splits(rows, path, max_bytes=2000)
    files = list((tmp_path / "set").glob("split=*/*.parquet"))
    assert len(files) > 8 and all(f.stat().st_size <= 2000 for f in files)
    test = readers.read_split(spark, path, "test")
    assert {r["id"] for r in test.collect()} == set(range(10))
    assert readers.read_split(spark, path, "train").count() == 90
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_posts_and_vectors(spark, some, make_posts, tmp_path):
    posts = make_posts({"general": "a"}, {"general": None})
    writers.write_table(posts, str(tmp_path / "posts"))
    back = readers.read_posts(spark, str(tmp_path / "posts"))
    assert sorted(back.collect(), key=lambda r: r["id"]) == sorted(posts.collect(), key=lambda r: r["id"])
    writers.write_table(some, str(tmp_path / "vectors"))
    vocab = spark.createDataFrame([(3, "renamed"), (999, "lost")], "token_id int, token string")
    row, lost = readers.read_tag_vectors(spark, str(tmp_path / "vectors"), vocab).orderBy("token_id").collect()
    assert (row["token_id"], row["token"]) == (3, "renamed") and row["embedding"]
    assert (lost["token_id"], lost["token"], lost["embedding"]) == (999, "lost", None)


def test_vector_export(spark, some, tmp_path):
    missing = spark.createDataFrame([(77, "none", None)], SCHEMA)
    writers.write_vectors_tsv(some.unionByName(missing), str(tmp_path), 3)

    def lines(name):
        parts = sorted((tmp_path / f"file={name}").glob("part-*"))
        return [line for p in parts for line in p.read_text().splitlines()]

    def parts(name):
        return [(p.name.split("-")[1], len(p.read_text().splitlines())) for p in sorted((tmp_path / f"file={name}").glob("part-*"))]

    assert parts("labels") == parts("vectors") and len(parts("labels")) == 3

    labels, numbers = lines("labels"), lines("vectors")
    assert labels == [f"t{i}" for i in range(60)]
    old = {r["token"]: r["embedding"] for r in some.collect()}
    for label, line in zip(labels, numbers, strict=True):
        assert np.allclose([float(x) for x in line.split("\t")], old[label])
