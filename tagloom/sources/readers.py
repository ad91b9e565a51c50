"""Scans."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.functions.text import strip
from tagloom.sources.revisions import Dataset

GROUP_FILES = ("people", "focus", "watermark", "artistic_error")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts kept in one folder."""
    return spark.read.schema(schemas.POSTS).parquet(path)


def read_revision(spark: SparkSession, root: str, revision: str | None = None, split: str = "all") -> DataFrame:
    """Posts, or another set, of a named revision; by default of the newest."""
    return Dataset(spark, root).read(split, revision)


def read_tag_groups(spark: SparkSession, folder: str) -> DataFrame:
    """group_name, tag from one text file per group, a tag per line."""
    files = [f"{folder}/{name}.txt" for name in GROUP_FILES]
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return spark.read.text(files).select(
        name.alias("group_name"), strip(F.col("value")).alias("tag")
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VOCABULARY).parquet(path)


def read_tag_vectors(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """Tag vectors; with a vocabulary, tokens are looked up by id, and those without a vector stay."""
    vectors = spark.read.parquet(path)
    if vocab is None:
        return vectors
    return vocab.select("token_id", "token").join(vectors.drop("token"), "token_id", "left")


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """token, cluster_id from rows of JSON."""
    return spark.read.schema(schemas.CLUSTER_MAP).json(path)


def _between_entries(spark: SparkSession, path: str) -> str | None:
    """What stands between the entries of a JSON object of numbers, up to the next key's quote.

    Cut at quotes, the file starts with the brace, the first key, then colon, number and this. A
    backslash before a quote means that the key goes on. None if there is only one entry.
    """
    pieces = iter(r["value"] for r in spark.read.option("lineSep", '"').text(path).limit(1000).collect())
    next(pieces, None)
    for piece in pieces:
        if (len(piece) - len(piece.rstrip("\\"))) % 2 == 0:
            break
    found = re.search(r",\s*$", next(pieces, ""))
    return found.group() + '"' if found else None


def read_json_object(
    spark: SparkSession, path: str, key: str, value: str, value_type: str = "bigint"
) -> DataFrame:
    """(key, value) rows from a file that is one JSON object, as count and cluster maps are kept.

    The file is cut where its first two entries are parted, in as many tasks as its size calls for.
    Within a string a quote has a backslash before it, so a cut can only be wrong where a key ends
    with a comma; such a file is refused, never misread. Values are numbers.
    """
    between = _between_entries(spark, path)
    if between is None:
        pieces = spark.read.text(path, wholetext=True).select(F.col("value").alias("whole"))
    else:
        part = F.regexp_replace(F.regexp_replace("value", r"^\s*\{\s*\"", ""), r"\}\s*$", "")
        whole = F.concat(F.lit('{"'), part, F.lit("}"))
        pieces = spark.read.option("lineSep", between).text(path).select(whole.alias("whole"))
    entries = F.from_json("whole", f"map<string,{value_type}>", {"mode": "FAILFAST"})
    return pieces.select(F.explode(entries).alias(key, value))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split; the other split's folder is never listed into the scan."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def table_exists(spark: SparkSession, path: str, fmt: str = "json") -> bool:
    try:
        # The schema is given, so nothing but the path is looked at.
        spark.read.format(fmt).schema("value string").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
