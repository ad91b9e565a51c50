import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tagloom import constants as C
from tagloom.operators import compose, organize
from tagloom.operators.encode import encoder
from tagloom.operators.lookup import tag_table
from tagloom.operators.split import find_cut, head, train_only, train_test_split
from tagloom.operators.vocabulary import VocabularyParams, build_vocabulary
from tagloom.plans import prompts as jobs
from tagloom.plans.exploration import corpus_report
from tagloom.plans.vectors import VectorSetParams, vector_set
from workload.corpus import GROUPS, corpus
from workload.queries import CALIBRATION, FINETUNE

ONCE = VocabularyParams(min_count={"general": 1, "copyright": 1, "character": 1})
ANY_SCORE = tuple((r, -1000) for r in "gsqe")


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return corpus(spark, sf_dir)


# Edge rows


def made(rows, name="text"):
    return {r["id"]: r[name] for r in rows.collect()}


def test_edge_rows_of_the_pretraining_set(make_posts):
    posts = make_posts(
        {"general": "1girl, blue hair"},
        {"general": None},
        {"general": ""},
        {"general": " 　\n"},
        {"general": "1girl, watermark, cat"},
        {"copyright": None, "character": None},
        {"rating": "x"},
        {"image_height": 0},
        {"copyright": "original"},
        {"general": "nobody knows"},
        {"general": ", ".join(["cat"] * 100)},
        {"general": ", ".join(["cat"] * 101)},
        {"copyright": ", ".join(["aaa"] * 6)},
        {"character": ", ".join(["bbb"] * 11)},
        {"copyright": "zzz"},
        {"copyright": "AAA, aaa"},
    )
    vocab = build_vocabulary(posts.where("id not in (9, 14, 15)"), ONCE)
    rows = jobs.pretrain_rows(posts, encoder(vocab)).cache()
    texts = made(jobs.accepted(rows))
    assert set(texts) == {0, 4, 5, 8, 9, 10, 15}
    assert made(jobs.quarantined(rows), "reason") == {6: "unknown_rating", 7: "no_aspect_ratio"}
    assert "<general>1girl, cat</general>" in texts[4]
    assert texts[5].startswith("<|bos|><copyright></copyright><character></character>")
    # Nothing known is left: the prompt stays, with nothing in it.
    assert "<general></general>" in texts[9]
    # Copyright keeps its case in the text; capitals sort before small letters.
    assert "<copyright>AAA, aaa</copyright>" in texts[15]


@pytest.fixture(scope="module")
def tiny(spark, make_posts):
    posts = make_posts(
        {"general": "1girl, a, b, c, d"},
        {"general": "1girl, solo"},
        {"general": "1girl, a, lost"},
        {"general": "1girl, a, b", "rating": "x"},
        {"general": "1girl, a, b", "score": -5000},
        {"general": "1girl, a, b", "created_at": "2019-12-31T20:00:00.000-05:00"},
        {"general": "a, a, a"},
        {"general": "nobody knows"},
    )
    vocab = build_vocabulary(posts.where("id < 7"), ONCE)
    clusters = spark.createDataFrame(
        [(f"{level}|{t}", i % n) for level, n in (("lax", 4), ("strict", 2)) for i, t in enumerate("abcd")],
        "key string, cluster_id int",
    )
    return posts, encoder(vocab), tag_table(clusters, "key", "cluster_id")


def test_edge_rows_of_the_finetuning_set(tiny):
    posts, enc, clusters = tiny
    params = replace(jobs.FINETUNE, score_floors=ANY_SCORE, first_year=2020)
    rows = jobs.finetune_rows(posts, enc, clusters, params=params).cache()
    assert set(made(jobs.accepted(rows))) == {0, 6}
    assert made(jobs.quarantined(rows), "reason") == {
        1: "no_tags_to_complete",
        2: "unclustered_tag",
        3: "unknown_rating",
        7: "no_tags_to_complete",
    }


def test_fail_fast(tiny):
    posts, enc, clusters = tiny
    params = replace(jobs.FINETUNE, score_floors=ANY_SCORE, fail_fast=True)
    with pytest.raises(Exception, match="post 2: unclustered_tag"):
        jobs.accepted(jobs.finetune_rows(posts.where("id = 2"), enc, clusters, params=params)).collect()


def test_clusters_in_order_of_first_sight(spark, tiny):
    tags = spark.range(1).select("id", F.split(F.lit("1girl d a b a c d"), " ").alias("tags"))
    grouped = organize.organize_by_group(tags, "tags")
    clusters = tag_table(
        spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("d", 1)], "k string, c int"), "k", "c"
    )
    row = organize.by_cluster(grouped, clusters).first()
    assert row["other"] == [["d", "b", "d"], ["a", "a", "c"]]
    assert not row["unclustered"]


def test_franchise(spark):
    def flag(copyright, character, counts=True):
        lists = [F.array(*[F.lit(x) for x in items]).cast("array<string>") for items in (copyright, character)]
        column = compose.names_franchise(*lists, empty_counts=counts)
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert flag(["aaa"], ["b"])
    assert not flag(["original"], ["b"])
    assert flag(["original", "aaa"], ["b"])
    # A missing copyright is one empty tag, which counts unless told otherwise.
    assert flag([""], [""])
    assert not flag([""], [""], counts=False)
    assert not flag(["aaa"], [])


# Invariants on the derived corpus


def organized(data, level):
    leveled = jobs.known_posts(data.posts, data.encoder, jobs.Caps()).withColumn("level", F.lit(level))
    grouped = organize.organize_by_group(leveled, "tokens", GROUPS, organize.named)
    return organize.by_cluster(grouped, data.clusters, organize.named, F.col("level"))


@pytest.mark.parametrize("level", ["lax", "strict", "none"])
@pytest.mark.parametrize(
    "make", [compose.condition_keeping_identity, compose.condition_free], ids=["keep", "free"]
)
def test_no_tag_is_lost(data, level, make):
    params = FINETUNE.compose
    df = organized(data, level).withColumn("was", compose.shown_tags())
    rows = make(df, params).collect()
    assert len(rows) > 100
    moved = 0
    for row in rows:
        if not row["composable"]:
            continue
        both = Counter(t["tag"] for t in row["condition"] + row["completion"])
        assert both == Counter(t["tag"] for t in row["was"])
        names = [t["tag"] for t in row["completion"]]
        assert names == sorted(names) and names
        if make is compose.condition_keeping_identity:
            lead = {t["tag"] for t in row["people"] + row["focus"]}
            assert lead <= {t["tag"] for t in row["condition"]}
            moved += len(row["condition"]) > len(row["people"] + row["focus"])
    if make is compose.condition_keeping_identity:
        assert moved > 10


def test_rates_above_one_complete_everything(data):
    params = compose.ComposeParams(condition_rates=((40.0, 1.0),))
    rows = compose.recompose(organized(data, "strict"), params).collect()
    spent = [r for r in rows if len(r["other"]) > 1 and not r["condition"]]
    assert spent
    for row in rows:
        if len(row["other"]) > 1:
            assert row["completion"]


def test_prompt_ids_are_the_encoded_text(data):
    """Cutting the text at its special tokens and looking pieces up gives the same ids."""
    params = replace(CALIBRATION, score_floors=ANY_SCORE, first_year=None)
    pre = jobs.accepted(jobs.pretrain_rows(data.posts, data.encoder, GROUPS))
    fine = jobs.accepted(
        jobs.finetune_rows(data.posts, data.encoder, data.clusters, GROUPS, params)
    )
    vocab = {r["token"]: r["token_id"] for r in data.vocab.collect()}
    marks = re.compile("(" + "|".join(map(re.escape, C.SPECIAL_TOKENS["main"])) + ")")
    for rows in (pre, fine):
        for row in rows.collect():
            ids = []
            for piece in marks.split(row["text"]):
                if piece in vocab and marks.fullmatch(piece):
                    ids.append(vocab[piece])
                else:
                    tags = re.split(r",\s*", piece.lower())
                    ids += [vocab.get(t, vocab[C.UNK]) for t in tags if t]
            assert ids == row["input_ids"]


def test_identity_shares(data):
    n = 20_000
    ids = data.spark.range(n)
    rows = ids.select(compose.identity_level(FINETUNE.identity_rates, 1).alias("l")).collect()
    lax = sum(r["l"] == "lax" for r in rows) / n
    assert abs(lax - 0.6) < 3 * (0.6 * 0.4 / n) ** 0.5


def test_sets_do_not_depend_on_partitioning_or_lookup_size(data):
    params = replace(FINETUNE, test_size=20)

    def rows(posts, enc, clusters):
        made = jobs.finetune_set(posts, enc, clusters, GROUPS, params)
        return sorted((r["id"], r["text"], tuple(r["input_ids"]), r["split"]) for r in made.collect())

    whole = rows(data.posts.coalesce(1), data.encoder, data.clusters)
    assert sum(r[3] == "test" for r in whole) == 20
    joined = encoder(data.vocab, 0)
    keyed = data.cluster_map.withColumn("key", organize.cluster_key(F.col("level"), F.col("token")))
    clusters = tag_table(keyed, "key", "cluster_id", max_entries=0)
    assert joined.table.literal is None and clusters.literal is None
    assert rows(data.posts.repartition(8), joined, clusters) == whole


def test_vector_set(data):
    kept = vector_set(data.posts, data.encoder, VectorSetParams(shuffle=False, test_size=30))
    mixed = vector_set(data.posts, data.encoder, VectorSetParams(test_size=30))
    plain = {r["id"]: (r["input_ids"], r["split"]) for r in kept.collect()}
    assert sum(s == "test" for _, s in plain.values()) == 30
    changed = 0
    for row in mixed.collect():
        ids, split = plain.pop(row["id"])
        assert len(ids) > 10 and sorted(ids) == sorted(row["input_ids"]) and split == row["split"]
        changed += ids != row["input_ids"]
    assert not plain and changed > 500


# Split


@pytest.mark.parametrize("size", [0, 1, 7, 999, 1000, 5000])
def test_split_sizes(spark, size):
    rows = spark.range(1000).repartition(5)
    split = train_test_split(rows, size)
    assert split.where("split = 'test'").count() == min(size, 1000)
    assert split.count() == 1000


def test_split_is_the_smallest_draws(spark):
    from tagloom.operators.split import split_draw

    rows = spark.range(3000).withColumn("draw", split_draw(5))
    test = {r["id"] for r in train_test_split(rows, 100, 5).where("split = 'test'").collect()}
    expected = rows.orderBy("draw", "id").limit(100).collect()
    assert test == {r["id"] for r in expected}
    assert train_only(rows, rows.where(F.col("id").isin(*test))).count() == 2900


@pytest.mark.parametrize("n", [0, 1, 10, 399, 5000])
def test_head(spark, n):
    rows = spark.range(0, 4000, 10).select((F.col("id") * F.col("id") - 70).alias("id"))
    ids = sorted(r["id"] for r in rows.collect())
    assert [r["id"] for r in head(rows.repartition(3), n).collect()] == ids[:n]
    assert head(rows.where("false"), n).count() == 0


def test_split_counts_only_survivors(spark):
    rows = spark.range(1000)
    cut = find_cut(rows, 50, 1, lambda df: df.where("id % 3 = 0"))
    kept = rows.where("id % 3 = 0").withColumn("split", cut.column())
    assert kept.where("split = 'test'").count() == 50


@pytest.mark.parametrize("share, size", [(1, 30), (40, 30), (900, 30), (2, 600)])
def test_cut_looks_at_few_rows_and_widens_when_few_survive(spark, share, size):
    from tagloom.operators.split import split_draw

    rows = spark.range(30_000)
    seen = []

    def survivors(some):
        seen.append(some.count())
        return some.where(F.col("id") % share == 0)

    cut = find_cut(rows, size, 1, survivors)
    kept = rows.where(F.col("id") % share == 0).withColumn("draw", split_draw(1))
    test = kept.withColumn("split", cut.column()).where("split = 'test'")
    expected = kept.orderBy("draw", "id").limit(size)
    assert {r["id"] for r in test.collect()} == {r["id"] for r in expected.collect()}
    if share == 1:
        assert sum(seen) < 1_000


# Plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("max_entries", [20_000, 0])
def test_prompt_sets_read_posts_once_and_never_regroup(data, max_entries):
    enc = encoder(data.vocab, max_entries)
    keyed = data.cluster_map.withColumn("key", organize.cluster_key(F.col("level"), F.col("token")))
    clusters = tag_table(keyed, "key", "cluster_id", max_entries=max_entries)
    for rows in (
        jobs.pretrain_rows(data.posts, enc, GROUPS),
        jobs.finetune_rows(data.posts, enc, clusters, GROUPS, FINETUNE),
    ):
        plan = jobs.accepted(rows)._jdf.queryExecution().optimizedPlan().toString()
        # Without literals the posts were written once, and the plan reads what was written.
        assert len(re.findall(r"Relation \[id#\d+L,general#", plan)) == (max_entries > 0)
        assert plan.count("FlatMapCoGroupsInArrow") == (max_entries == 0)
        assert plan.count("Aggregate ") == plan.count("Aggregate [asking#")


def test_scans_read_only_what_they_need(data):
    from tagloom.operators import clean, stats

    plan = plan_of(stats.rating_counts(data.posts))
    assert "ReadSchema: struct<rating:string>" in plan
    plan = plan_of(clean.above_score_floor(data.posts, {"g": 1, "s": 2}).select("id"))
    assert "GreaterThan(score,1)" in plan and "EqualTo(rating,g)" in plan


def test_tag_counts_are_hashed_and_combined_first(data):
    from tagloom.operators.vocabulary import tag_counts

    plan = plan_of(tag_counts(data.posts))
    assert "SortAggregate" not in plan
    assert plan.count("HashAggregate") >= 2


def test_report(data):
    report = corpus_report(data.posts, data.min_count)
    assert report["score_histogram"].count() == 400
    total = report["length_histogram"].agg(F.sum("n")).first()[0]
    assert total == data.posts.where("general is not null").count()
    assert report["popular_tags"].count() < report["tag_counts"].count()
    for table in report.values():
        assert table.columns


def test_a_report_scans_the_posts_once_and_adds_up(data, make_posts):
    from tagloom.operators import stats
    from tagloom.operators.summary import merged, summarize
    from tagloom.operators.vocabulary import tag_counts

    halves = [summarize(data.posts.where(F.col("id") % 2 == k)) for k in (0, 1)]
    report = corpus_report(summary=merged(*halves))
    odd = make_posts({"general": None, "score": None, "rating": None}, {"general": "", "copyright": "a, a"}, {"rating": None, "score": 3})
    for posts, made in ((data.posts, report), (odd, corpus_report(odd))):
        direct = {
            "tag_counts": tag_counts(posts),
            "rating_counts": stats.rating_counts(posts),
            "tags_per_post": stats.tags_per_post(posts),
            "score_boxplot": stats.score_boxplot(stats.score_counts(posts)),
            "quality_bands": stats.quality_bands(stats.score_counts(posts)),
        }
        for name, table in direct.items():
            found = made[name].select(*table.columns)
            assert sorted(map(str, found.collect())) == sorted(map(str, table.collect())), name
    plan = summarize(data.posts)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[id#", plan)) == 1
    assert all("general:string" not in plan_of(t) for t in corpus_report(data.posts).values())


def test_reasons_are_counted_while_rows_are_written(spark, tiny, tmp_path):
    posts, enc, clusters = tiny
    posts = posts.where("id <> 4")
    odd = {
        20: {"rating": F.lit("x")},
        21: {"image_height": F.lit(0)},
        22: {"score": F.lit(None).cast("int")},
        23: {"created_at": F.lit("once")},
        24: {"score": F.lit(None).cast("int")},
    }
    first = posts.where("id = 0")
    for number, changes in odd.items():
        posts = posts.unionByName(first.withColumns({"id": F.lit(number).cast("long"), **changes}))
    params = replace(jobs.FINETUNE, score_floors=ANY_SCORE, first_year=2010)
    rows = jobs.finetune_rows(posts, enc, clusters, params=params)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    path = str(tmp_path / "set")
    counts = jobs.write_accepted(rows.mapInArrow(count, rows.schema), lambda kept: kept.write.parquet(path))
    assert made.value == rows.count()
    assert counts.pop(None) == spark.read.parquet(path).count() > 0
    failed = jobs.quarantined(rows).groupBy("reason").count().collect()
    assert counts == {r["reason"]: r["count"] for r in failed} and min(counts.values()) > 0 and len(counts) == 6


def test_finetuning_rows_keep_the_posts_columns_and_lose_no_post_unseen(tiny):
    posts, enc, clusters = tiny
    params = replace(jobs.FINETUNE, score_floors=ANY_SCORE, first_year=2020)
    blank = posts.where("id = 0").withColumn("score", F.lit(None).cast("int"))
    undated = posts.where("id = 0").withColumn("created_at", F.lit("once"))
    for odd, reason in ((blank, "no_score"), (undated, "no_date")):
        rows = jobs.finetune_rows(odd, enc, clusters, params=params)
        assert made(jobs.quarantined(rows), "reason") == {0: reason}
    kept = jobs.accepted(jobs.finetune_rows(posts, enc, clusters, params=params))
    assert set(posts.columns) <= set(kept.columns)
    assert kept.where("id = 0").first()["image_width"] == 896


def test_score_floors_reach_the_scan(data):
    rows = jobs.finetune_rows(data.posts, data.encoder, data.clusters, GROUPS, FINETUNE)
    pushed = plan_of(jobs.accepted(rows, "id")).split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "GreaterThan(score" in pushed


def test_head_with_an_outlying_id(spark):
    rows = spark.range(500).union(spark.createDataFrame([(2**62,)], "id long")).repartition(4)
    assert [r["id"] for r in head(rows, 3).collect()] == [0, 1, 2]
