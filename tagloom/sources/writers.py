"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.sources.revisions import MAX_FILE_BYTES, Folder, write_bounded


def write_cluster_map(cluster_map: DataFrame, path: str) -> None:
    """JSON rows (token, cluster_id)."""
    cluster_map.select("token", "cluster_id").write.mode("overwrite").json(path)


def write_table(table: DataFrame, path: str) -> None:
    """Statistics and vocabularies."""
    table.write.mode("overwrite").parquet(path)


def write_json_object(table: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object key -> value in the single file `path`/object.json, one entry per line.

    Keys are unique and not null, and sorted into ranges; each task writes its lines, and the files
    are then put together in order.
    """
    entries = table.select(key, value)
    least = entries.agg(F.min(key)).first()[0]
    parts = f"{path}/_parts"
    text = F.to_json(F.map_from_arrays(F.array(key), F.array(value)))
    inner = F.expr("substring(line, 2, length(line) - 2)")
    lead = F.when(F.col(key) == F.lit(least), "{").otherwise(",")
    lines = entries.repartitionByRange(key).sortWithinPartitions(key).select(key, text.alias("line"))
    lines.select(F.concat(lead, inner)).write.mode("overwrite").text(parts)
    Folder(table.sparkSession, path).join_files("_parts", "object.json", "}\n" if least is not None else "{}\n")


def write_splits(rows: DataFrame, path: str, max_bytes: int = MAX_FILE_BYTES) -> None:
    """split=test and split=train folders in one run, files of at most `max_bytes`.

    Every task writes its own rows, so a rare split has up to one small file per task. For sets
    that others read meanwhile see `Dataset.write_split`.
    """
    write_bounded(rows, path, max_bytes, "split")


def write_vectors_tsv(vectors: DataFrame, path: str, n_parts: int | None = None) -> None:
    """`file=vectors` (tab-joined numbers) and `file=labels`, one line per token in id order.

    The tokens are sorted once, and each task writes a part of both files: part n of one goes with
    part n of the other, line by line; Spark chooses how many unless told. Tokens without a vector are in neither.
    """
    lines = tsv_lines(vectors.where(F.col("embedding").isNotNull()))
    both = F.explode(
        F.array(*(F.struct(F.lit(f"{c}s").alias("file"), F.col(c).alias("line")) for c in ("vector", "label")))
    )
    by = ["token_id"] if n_parts is None else [n_parts, "token_id"]
    ranged = lines.repartitionByRange(*by).select("token_id", both.alias("l")).select("token_id", "l.*")
    ranged.sortWithinPartitions("file", "token_id").select("file", "line").write.mode("overwrite").partitionBy(
        "file"
    ).text(path)


def tsv_lines(vectors: DataFrame) -> DataFrame:
    """token_id, vector, label: the two exported lines of each token."""
    numbers = F.transform(F.col("embedding"), lambda x: x.cast("string"))
    return vectors.select(
        "token_id", F.array_join(numbers, "\t").alias("vector"), F.col("token").alias("label")
    )
