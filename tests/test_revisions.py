"""Splits made in one pass, and datasets published by revision."""

import os

import pytest
from pyspark.sql import functions as F

from tagloom.operators.split import split_draw, split_once
from tagloom.sources import revisions
from tagloom.sources.revisions import Dataset, Folder, write_bounded


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


@pytest.mark.parametrize("size", [0, 1, 50, 1999, 2000, 5000])
def test_a_split_in_one_pass_has_the_smallest_draws(spark, size):
    rows = spark.range(2000).withColumns({"_draw": F.col("id") * 2, "text": F.lit("x")}).repartition(3)
    split = split_once(rows, size, 7)
    assert split.columns == ["id", "_draw", "text", "split"]
    expected = rows.withColumn("d", split_draw(7)).orderBy("d", "id").limit(size)
    assert ids(split.where("split = 'test'")) == ids(expected)
    assert split.count() == 2000 and split.where("_draw <> id * 2").count() == 0


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(500).mapInArrow(count, "id long")
    assert split_once(rows, 20, 1).where("split = 'test'").count() == 20
    assert made.value == 500


@pytest.mark.parametrize("size, of", [(0, 900), (40, 900), (40, 10**9), (899, 900), (900, 900), (2000, 900)])
def test_published_splits(spark, tmp_path, size, of):
    """`of` far too large puts the cut into the upper range."""
    rows = spark.range(900).withColumn("text", F.lit("t")).repartition(3)
    data = Dataset(spark, str(tmp_path))
    data.write_split("v1", rows, of, size, 3)
    expected = rows.withColumn("d", split_draw(3)).orderBy("d", "id").limit(size)
    test, train = data.read("test"), data.read("train")
    assert test.columns == train.columns == ["id", "text"]
    assert ids(test) == ids(expected)
    assert sorted(ids(test) + ids(train)) == list(range(900))
    both = data.read().groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in both if r["count"]} == {s: n for s, n in (("test", min(size, 900)), ("train", 900 - min(size, 900))) if n}


def test_revisions_by_name(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "set"))
    with pytest.raises(LookupError):
        data.read("all")
    data.write("v1", {"all": spark.range(5)})
    data.write("v2", {"all": spark.range(9)})
    data.write("v1", {"all": spark.range(3)})
    assert data.read("all").count() == 3
    assert data.read("all", "v2").count() == 9
    assert [(r.number, r.name) for r in data.revisions()] == [(1, "v1"), (2, "v2"), (3, "v1")]
    with pytest.raises(LookupError, match="v9"):
        data.read("all", "v9")


def test_a_failed_write_leaves_the_revision_before(spark, tmp_path):
    data = Dataset(spark, str(tmp_path))
    data.write("v1", {"all": spark.range(5)})
    broken = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        data.write("v2", {"all": broken})
    assert [r.name for r in data.revisions()] == ["v1"]
    assert data.read("all").count() == 5


def test_of_two_writers_neither_is_lost(spark, tmp_path, monkeypatch):
    data = Dataset(spark, str(tmp_path))
    data.write("first", {"all": spark.range(1)})
    put, raced = Folder.put, []

    def slow(folder, name, text):
        if not raced:  # another writer takes the number meanwhile
            raced.append(name)
            data.write("other", {"all": spark.range(2)})
        return put(folder, name, text)

    monkeypatch.setattr(Folder, "put", slow)
    data.write("mine", {"all": spark.range(3)})
    assert [(r.number, r.name) for r in data.revisions()] == [(1, "first"), (2, "other"), (3, "mine")]
    assert not [f for f in os.listdir(tmp_path / "revisions") if f.startswith("_")]


def test_files_are_bounded_in_bytes(spark, tmp_path):
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"), (F.col("id") % 2).alias("half"))
    for by in ((), ("half",)):
        path = str(tmp_path / f"set{len(by)}")
        write_bounded(rows.coalesce(1), path, 60_000, *by)
        sizes = Folder(spark, path).sizes()
        assert len(sizes) > 4 and max(sizes.values()) <= 60_000
        assert ids(spark.read.parquet(path)) == list(range(4000))
    # A row larger than the bound has a file of its own.
    write_bounded(rows.limit(3).coalesce(1), str(tmp_path / "tiny"), 10)
    assert len(Folder(spark, str(tmp_path / "tiny")).sizes()) == 3
    assert revisions.MAX_FILE_BYTES == 4_096_000_000
