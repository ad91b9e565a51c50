import pytest
from pyspark.sql import functions as F

from tagloom import constants as C
from tagloom.operators.encode import decode, decoder, encoder, unknown_tags
from tagloom.operators.lookup import Wanted, resolve_all, tag_table
from tagloom.operators.vocabulary import (
    VocabularyParams,
    build_vocabulary,
    check_unique,
    duplicate_tokens,
    most_frequent_first,
    number_tokens,
    popular,
    tag_counts,
    unreachable_tokens,
    vocabulary_sizes,
)

PARAMS = VocabularyParams(min_count={"general": 2, "copyright": 1, "character": 1})


@pytest.fixture(scope="module")
def posts(make_posts):
    return make_posts(
        {"general": "b, a, a, c", "copyright": "x", "character": None},
        {"general": "a, b, rare", "copyright": None, "character": "m, n"},
        {"general": "c, Upper, o'b \"q\" \\ é", "copyright": "x, y", "character": "m"},
        {"general": "Upper, o'b \"q\" \\ é"},
        {"general": None},
    )


@pytest.fixture(scope="module")
def vocab(posts):
    return build_vocabulary(posts, PARAMS).cache()


def test_tag_counts(posts):
    rows = tag_counts(posts, ("general",)).collect()
    counts = {r["tag"]: (r["cnt"], r["first_seen"]) for r in rows}
    assert counts["a"] == (3, 1)
    assert counts["b"] == (2, 0)
    assert counts["c"] == (2, 3)
    assert counts["rare"] == (1, 2**32 + 2)
    ordered = [r["tag"] for r in most_frequent_first(tag_counts(posts, ("general",))).collect()]
    assert ordered[:3] == ["a", "b", "c"]


def test_vocabulary_order(vocab):
    rows = vocab.orderBy("token_id").collect()
    assert [r["token_id"] for r in rows] == list(range(len(rows)))
    assert [r["token"] for r in rows[:103]] == list(C.SPECIAL_TOKENS["main"])
    # Most frequent first; equal counts in order of first appearance.
    assert [r["token"] for r in rows[103:108]] == ["a", "b", "c", "Upper", "o'b \"q\" \\ é"]
    assert [r["kind"] for r in rows[108:]] == ["copyright"] * 3 + ["character"] * 3
    sizes = {r["kind"]: r["n"] for r in vocabulary_sizes(vocab).collect()}
    assert sizes == {"special": 103, "general": 5, "copyright": 3, "character": 3, "total": 114}


def test_popular_bounds_are_inclusive(spark):
    counts = spark.createDataFrame(
        [("general", "a", 200), ("general", "b", 199), ("copyright", "c", 100), ("other", "d", 999)],
        "field string, tag string, cnt long",
    )
    kept = popular(counts, {"general": 200, "copyright": 100}).collect()
    assert {r["tag"] for r in kept} == {"a", "c"}


def test_numbering_equals_one_sort(spark):
    rows = [("general", f"t{i}", (i * 7) % 5 + 1, (i * 31) % 97 * 2**38) for i in range(97)]
    counts = spark.createDataFrame(rows, "field string, tag string, cnt long, first_seen long")
    made = number_tokens(counts, ("general",), 10).orderBy("token_id").collect()
    expected = sorted(rows, key=lambda r: (-r[2], r[3], r[1]))
    assert [r["token"] for r in made] == [r[1] for r in expected]
    assert [r["token_id"] for r in made] == list(range(10, 107))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_numbering_of_distinct_and_of_equal_counts(spark, ranges):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        for of in (lambda i: i * 7 % 2003 + 1, lambda i: 5):
            rows = [(("b", "a")[i % 2], f"t{i}", of(i), (i * 31) % 2003) for i in range(2003)]
            counts = spark.createDataFrame(rows, "field string, tag string, cnt long, first_seen long").repartition(5)
            made = number_tokens(counts, ("b", "a"), 3)
            expected = sorted(rows, key=lambda r: (r[0] != "b", -r[2], r[3]))
            assert [(r["token_id"], r["token"]) for r in made.orderBy("token_id").collect()] == [(i, r[1]) for i, r in enumerate(expected, 3)]
        assert number_tokens(counts.limit(0), ("a",), 3).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_vocabulary_is_numbered_without_a_window(posts):
    plan = build_vocabulary(posts, PARAMS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("tags", [{"general": "a, x", "copyright": "x"}, {"general": "<|bos|>", "copyright": "y"}])
def test_a_tag_of_two_kinds_stops_the_build(make_posts, tags):
    params = VocabularyParams(min_count={"general": 1, "copyright": 1, "character": 1})
    with pytest.raises(ValueError, match="duplicate tokens"):
        build_vocabulary(make_posts(tags), params)


def test_duplicates(spark, vocab):
    assert duplicate_tokens(vocab).count() == 0
    assert check_unique(vocab) is vocab
    twice = vocab.unionByName(vocab.where("token = 'a'"))
    row = duplicate_tokens(twice).first()
    assert (row["token"], row["n"], row["kinds"]) == ("a", 2, ["general", "general"])
    with pytest.raises(ValueError, match="a"):
        check_unique(twice)


def test_unreachable(vocab):
    assert {r["token"] for r in unreachable_tokens(vocab).collect()} == {"Upper"}


@pytest.fixture(scope="module", params=[20_000, 0], ids=["literal", "joined"])
def enc(request, vocab):
    made = encoder(vocab, request.param)
    assert (made.table.literal is None) == (request.param == 0)
    return made


def test_encode(enc, vocab, posts):
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    unk = ids[C.UNK]
    rows = {r["id"]: r["token_ids"] for r in enc.encode(posts, "general").collect()}
    assert rows[0] == [ids["b"], ids["a"], ids["a"], ids["c"]]
    assert rows[1] == [ids["a"], ids["b"], unk]
    # Encoding lowers case, so a token with capitals is out of reach.
    assert rows[2] == [ids["c"], unk, ids["o'b \"q\" \\ é"]]
    assert rows[4] is None


def test_known_tokens(enc, posts):
    rows = {r["id"]: r["tokens"] for r in enc.known_tokens(posts, "general").collect()}
    assert [t["tag"] for t in rows[1]] == ["a", "b"]
    assert [t["tag"] for t in rows[0]] == ["b", "a", "a", "c"]


def test_reject_unknown(spark, enc):
    df = spark.createDataFrame([(1, "x, y"), (2, "x, z"), (3, "")], "id long, copyright string")
    assert {r["id"] for r in enc.reject_unknown(df, "copyright").collect()} == {1, 3}


@pytest.mark.parametrize("max_entries", [20_000, 0])
def test_decode(spark, vocab, max_entries):
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    df = spark.createDataFrame(
        [(1, [ids[C.BOS], ids["b"], ids["a"], ids["b"], ids[C.EOS]]), (2, [ids[C.BOS]]), (3, [])],
        "id long, ids array<int>",
    )
    rows = {r["id"]: r["text"] for r in decode(df, "ids", decoder(vocab, True, max_entries)).collect()}
    assert rows == {1: "b, a, b", 2: "", 3: ""}


def test_unknown_tags(posts, vocab):
    rows = {r["tag"]: r["n_posts"] for r in unknown_tags(posts, "general", vocab).collect()}
    assert rows == {"rare": 1, "upper": 2}


@pytest.mark.parametrize("max_entries", [20_000, 0])
def test_a_hot_key(spark, max_entries):
    """A third of all items share one key."""
    table = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    rows = spark.range(2_000).select(
        "id",
        F.array(
            F.lit("k49"), F.concat(F.lit("k"), (F.col("id") % 50).cast("string")), F.lit("none")
        ).alias("keys"),
    )
    found = tag_table(table, "k", "v", max_entries=max_entries).resolve(rows, "keys", "out")
    for row in found.collect():
        assert row["out"] == [49, row["id"] % 50, None]


@pytest.mark.parametrize("max_entries", [20_000, 0])
def test_lookups_use_the_input_once_and_keep_every_row(spark, max_entries):
    table = tag_table(
        spark.createDataFrame([(f"k{i}", i) for i in range(9)], "k string, v int"), "k", "v", max_entries=max_entries
    )
    # A key that equals a row's id must not be taken for the row.
    other = tag_table(spark.createDataFrame([("1", 70), ("k8", 80)], "k string, v int"), "k", "v")
    rows = spark.createDataFrame(
        [(1, ["k8", None, "k0", "k8", "none"], "a"), (2, [], None), (3, None, "c"), (4, [None], "d")],
        "id long, keys array<string>, `other.name` string",
    )
    more = F.when(F.col("id") != 2, F.array(F.lit("1"), F.lit("k8")))
    made = resolve_all(
        rows,
        [Wanted(F.col("keys"), table, "out"), Wanted(more, other, "two"), Wanted(more, table, "three")],
    )
    assert made.columns == ["id", "keys", "other.name", "out", "two", "three"]
    found = {r["id"]: (r["out"], r["other.name"], r["two"], r["three"]) for r in made.collect()}
    assert found == {
        1: ([8, None, 0, 8, None], "a", [70, 80], [None, 8]),
        2: ([], None, None, None),
        3: (None, "c", [70, 80], [None, 8]),
        4: ([None], "d", [70, 80], [None, 8]),
    }
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counted = spark.range(10).mapInArrow(count, "id long").select("id", F.array(F.lit("k7")).alias("keys"))
    resolved = table.resolve(counted, "keys", "out")
    assert [r["out"] for r in resolved.collect()] == [[7]] * 10 and made.value == 10
    # Rows are never regrouped; only what chunks ask for is made distinct.
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == plan.count("Aggregate [asking#") == (max_entries == 0)


@pytest.mark.parametrize("max_entries", [20_000, 0])
def test_a_key_listed_twice_is_an_error_at_every_size(spark, max_entries):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    with pytest.raises(ValueError, match="duplicate keys: \\['a'\\]"):
        tag_table(table, "k", "v", max_entries=max_entries)


def test_an_empty_table_and_null_keys(spark):
    table = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    rows = spark.createDataFrame([(1, ["a", None])], "id long, keys array<string>")
    assert tag_table(table, "k", "v").resolve(rows, "keys", "out").first()["out"] == [None, None]


def test_first_seen_is_exact_for_large_ids(spark):
    posts = spark.createDataFrame(
        [(2**62, ", ".join(["x"] * 70_000 + ["late", "later"]), None, None)],
        "id long, general string, copyright string, character string",
    )
    rows = {r["tag"]: int(r["first_seen"]) for r in tag_counts(posts, ("general",)).collect()}
    assert rows == {"x": 2**94, "late": 2**94 + 70_000, "later": 2**94 + 70_001}


def test_rows_of_one_id_stay_apart_at_every_size(spark):
    rows = [
        (1, ["a", "b"], None, "x"), (1, ["b"], None, "x"), (1, ["a", "b"], "x", None), (2, ["a"], None, "y"), (2, ["a"], None, "y"),
        (None, ["b", "zz"], None, "n"), (None, ["a"], "m", None), (None, ["a"], "m", None), (3, None, None, None), (3, [], None, None),
        (4, ["a", None], None, None), (4, [None, "a"], None, None),
    ]
    df = spark.createDataFrame(rows, "id long, tags array<string>, one string, two string").repartition(3)
    table = spark.createDataFrame([("a", 1), ("b", 2)], "tag string, number int")
    found = [
        sorted(map(str, resolve_all(df, [Wanted(F.col("tags"), tag_table(table, "tag", "number", max_entries=n), "numbers")]).collect()))
        for n in (20_000, 0)
    ]
    assert len(found[0]) == len(rows) and found[0] == found[1]


def test_names_of_any_kind_pass_a_large_lookup(spark):
    """Columns named like those made on the way come back as they were; an `out` replaces its own."""
    rows = spark.createDataFrame(
        [(1, ["a"], "h", "k", 5, [1.5]), (2, None, None, None, None, None)],
        "at long, keys array<string>, _hash string, _keys_0 string, chunk int, `row` array<double>",
    )
    table = tag_table(spark.createDataFrame([("a", 1)], "k string, v int"), "k", "v", max_entries=0)
    found = resolve_all(rows, [Wanted(F.col("keys"), table, "out"), Wanted(F.col("keys"), table, "chunk")])
    assert found.columns == ["at", "keys", "_hash", "_keys_0", "chunk", "row", "out"]
    assert sorted(map(tuple, found.collect())) == [(1, ["a"], "h", "k", [1], [1.5], [1]), (2, None, None, None, None, None, None)]
    assert resolve_all(rows.limit(0), [Wanted(F.col("keys"), table, "out")]).count() == 0


def test_chunks_of_any_size_give_the_same(spark):
    from tagloom.operators.requests import Asked, with_answers

    pairs = spark.range(300).selectExpr("cast(id as string) as _key", "id * 2 as _value")
    rows = spark.range(1000).select("id", F.transform(F.sequence(F.col("id") % 7, F.lit(9)), lambda i: (i * F.col("id") % 400).cast("string")).alias("keys"))
    found = [
        sorted((r["id"], tuple(r["out"])) for r in with_answers(rows.repartition(3), [Asked(F.col("keys"), pairs, "out")], n).collect())
        for n in (1, 64, 5000)
    ]
    wanted = [(r["id"], tuple(2 * int(k) if int(k) < 300 else None for k in r["keys"])) for r in rows.collect()]
    assert found == [sorted(wanted, key=lambda w: w[0])] * 3
