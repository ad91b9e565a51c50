from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.functions import draws
from tagloom.functions.text import (
    has_text,
    iso_year,
    split_tags,
    strip,
    tag_count,
    tokenize,
)


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r["x"] for r in df.orderBy("id").select(column.alias("x")).collect()]


BLANKS = ["", " ", "\n\t", "　", "  ", "\x1c\x1f", "\u0085"]


def test_has_text_agrees_with_python(spark):
    texts = [*BLANKS, None, "a", " a ", "　あ"]
    expected = [t is not None and len(t.strip()) > 0 for t in texts]
    assert values(spark, texts, has_text(F.col("t"))) == expected


def test_strip_agrees_with_python(spark):
    texts = [*BLANKS, " a b\n", "　x ", "\x1fy\x85"]
    assert values(spark, texts, strip(F.col("t"))) == [t.strip() for t in texts]


def test_splitting(spark):
    texts = ["a, b", "", "a,b", "A,  b,c , ,", None, "a,　b"]
    assert values(spark, texts, split_tags(F.col("t"))) == [
        ["a", "b"],
        [""],
        ["a,b"],
        ["A", " b,c ", ","],
        None,
        ["a,　b"],
    ]
    assert values(spark, texts, tokenize(F.col("t"))) == [
        ["a", "b"],
        [],
        ["a", "b"],
        ["a", "b", "c "],
        None,
        ["a", "b"],
    ]
    assert values(spark, texts, tag_count(F.col("t"))) == [2, 1, 1, 3, 0, 1]


def test_year_keeps_its_offset(spark):
    texts = ["2019-12-31T20:00:00.000-05:00", "2020-01-01T00:00:00+09:00", None]
    assert values(spark, texts, iso_year(F.col("t"))) == [2019, 2020, None]


def test_uniform(spark):
    u = spark.range(20_000).select(draws.uniform(1, "a").alias("u"))
    row = u.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg((F.col("u") < 0.25).cast("int"))).first()
    assert abs(row[0] - 0.5) < 0.01
    assert 0 <= row[1] and row[2] < 1
    assert abs(row[3] - 0.25) < 0.01


def test_draws_do_not_depend_on_partitioning(spark):
    def drawn(n):
        rows = spark.range(500).repartition(n).select(
            "id",
            draws.uniform(1, "a").alias("u"),
            draws.shuffled("sequence(0, 9)", 1, "b").alias("s"),
        )
        return sorted((r["id"], r["u"], tuple(r["s"])) for r in rows.collect())

    assert drawn(1) == drawn(8)


def test_choose(spark):
    weighted = (("lax", 0.25), ("strict", 0.25), ("none", 0.5))
    rows = spark.range(20_000).select(draws.choose(1, "c", weighted).alias("x")).collect()
    counts = Counter(r["x"] for r in rows)
    for name, share in weighted:
        assert abs(counts[name] / 20_000 - share) < 0.012


def test_shuffles_are_fair(spark):
    rows = spark.range(24_000).select(draws.shuffled("sequence(0, 3)", 7, "s").alias("s")).collect()
    counts = Counter(tuple(r["s"]) for r in rows)
    assert len(counts) == 24
    assert all(abs(n - 1000) < 160 for n in counts.values())


@pytest.mark.parametrize("length", [0, 1, 300])
def test_shuffle_keeps_items(spark, length):
    items = f"slice(sequence(1, {max(length, 1)}), 1, {length})"
    for row in spark.range(20).select(draws.shuffled(items, 7, "s").alias("s")).collect():
        assert sorted(row["s"]) == list(range(1, length + 1))


def test_positions_never_collide(spark):
    keys = draws.positional_sql("sequence(0, 4999)", 3, "k")
    for row in spark.range(5).select(F.expr(f"transform({keys}, s -> s.k)").alias("k")).collect():
        assert len(set(row["k"])) == 5000
        assert 0 <= min(row["k"]) and max(row["k"]) < draws.PRIME
