"""Named revisions of a dataset: published whole or not at all, files of bounded size.

`data` holds the files of all writes, `revisions` one small manifest per revision that lists the
folders of each split. A revision exists once its manifest does, and that appears by one rename
that fails if the number is taken. What a failed write leaves behind is in no manifest, so no
reader ever sees it, and the revision before stays what it was.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.operators.split import cut_among, draw_bound, split_draw

#: At most so many bytes in a file.
MAX_FILE_BYTES = 4096 * 10**6
_DRAW, _RANGE = "_split_draw", "_split_range"


class Folder:
    """Files of one folder, by whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.path.getFileSystem(self.conf)

    def sizes(self) -> dict[str, int]:
        """Path and bytes of every data file, whatever its depth."""
        found, each = {}, self.files.listFiles(self.path, True)
        while each.hasNext():
            file = each.next()
            if not file.getPath().getName().startswith(("_", ".")):
                found[file.getPath().toString()] = file.getLen()
        return found

    def names(self) -> list[str]:
        if not self.files.exists(self.path):
            return []
        return sorted(f.getPath().getName() for f in self.files.listStatus(self.path))

    def remove(self, file: str) -> None:
        self.files.delete(self.jvm.org.apache.hadoop.fs.Path(file), False)

    def join_files(self, parts: str, name: str, end: str) -> None:
        """Puts the part files of a folder inside this one together, in order, and `end` behind."""
        hadoop = self.jvm.org.apache.hadoop
        folder = hadoop.fs.Path(self.path, parts)
        stream = self.files.create(hadoop.fs.Path(self.path, name), True)
        for file in sorted(f.getPath().toString() for f in self.files.listStatus(folder)):
            if file.rsplit("/", 1)[1].startswith("part-"):
                source = self.files.open(hadoop.fs.Path(file))
                hadoop.io.IOUtils.copyBytes(source, stream, self.conf, False)
                source.close()
        stream.write(bytearray(end.encode()))
        stream.close()
        self.files.delete(folder, True)

    def put(self, name: str, text: str) -> bool:
        """Writes a file whole, unless there is one of that name."""
        hadoop = self.jvm.org.apache.hadoop.fs
        draft = hadoop.Path(self.path, f"_{uuid.uuid4().hex}")
        stream = self.files.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = hadoop.FileContext.getFileContext(self.files.getUri(), self.conf)
        no_options = self.gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(hadoop.Path(self.path, name)), no_options)
        except Py4JJavaError as error:
            self.files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
                return False
            raise
        return True


@dataclass(frozen=True)
class Revision:
    number: int
    name: str
    schema: StructType
    splits: dict[str, list[str]]


class Dataset:
    """Revisions kept under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def revisions(self) -> list[Revision]:
        """All revisions, oldest first."""
        log = Folder(self.spark, f"{self.root}/revisions")
        files = [f"{self.root}/revisions/{n}" for n in log.names() if n.endswith(".json")]
        if not files:
            return []
        rows = self.spark.read.text(files, wholetext=True).collect()
        found = (json.loads(r["value"]) for r in rows)
        made = [Revision(f["number"], f["name"], StructType.fromJson(f["schema"]), f["splits"]) for f in found]
        return sorted(made, key=lambda r: r.number)

    def revision(self, name: str | None = None) -> Revision:
        """The newest one of that name, or of all."""
        found = [r for r in self.revisions() if name in (None, r.name)]
        if not found:
            raise LookupError(f"no revision {name or ''} in {self.root}")
        return found[-1]

    def read(self, split: str | None = None, revision: str | None = None) -> DataFrame:
        """One split, or all with a column `split`; files of other splits are not listed."""
        return self.read_from(self.revision(revision), split)

    def read_from(self, chosen: Revision, split: str | None = None) -> DataFrame:
        names = list(chosen.splits) if split is None else [split]
        parts = []
        for name in names:
            # Files may hold more columns than the set has.
            rows = self.spark.read.schema(chosen.schema).parquet(*(f"{self.root}/{p}" for p in chosen.splits[name]))
            parts.append(rows if split is not None else rows.withColumn("split", F.lit(name)))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionAll(part)
        return whole

    def publish(self, name: str, schema: StructType, splits: dict[str, list[str]]) -> Revision:
        """Makes folders that are written a revision. Of writers at the same time each gets a number."""
        log = Folder(self.spark, f"{self.root}/revisions")
        while True:
            taken = [int(n.split(".")[0]) for n in log.names() if n.endswith(".json")]
            made = Revision(max(taken, default=0) + 1, name, schema, splits)
            text = json.dumps({"number": made.number, "name": name, "schema": schema.jsonValue(), "splits": splits})
            if log.put(f"{made.number:08d}.json", text):
                return made

    def _new_folder(self, part: str) -> str:
        return f"data/{uuid.uuid4().hex}/{part}"

    def write(self, name: str, splits: dict[str, DataFrame], max_bytes: int = MAX_FILE_BYTES) -> Revision:
        """Writes and publishes splits of one schema."""
        paths = {}
        for split, rows in splits.items():
            paths[split] = [self._new_folder(split)]
            write_bounded(rows, f"{self.root}/{paths[split][0]}", max_bytes)
        return self.publish(name, next(iter(splits.values())).schema, paths)

    def write_split(
        self, name: str, rows: DataFrame, of: int, test_size: int, seed: int, max_bytes: int = MAX_FILE_BYTES
    ) -> Revision:
        """Writes rows once and publishes them as test and train, exactly `test_size` of them test.

        `of` is how many rows there are at most, or nearly. The rows lie in two ranges of their
        draws, the lower one somewhat larger than the test set. The cut is found among the draws
        that were written; the range it falls into is parted, the other one is taken as it is.
        """
        staged = self._new_folder("ranges")
        path = f"{self.root}/{staged}"
        draw = split_draw(seed)
        low = draw < draw_bound(4 * test_size, of)
        ranged = rows.withColumns({_DRAW: draw, _RANGE: F.when(low, "low").otherwise("high")})
        write_bounded(ranged, path, max_bytes, _RANGE)
        known = f"id {rows.schema['id'].dataType.simpleString()}, {_DRAW} bigint, {_RANGE} string"
        draws = self.spark.read.schema(known).parquet(path).withColumnRenamed(_DRAW, "draw")
        cut = cut_among(draws.where(F.col(_RANGE) == "low"), test_size)
        halves, divided = {"train": ["high"], "test": []}, "low"
        if cut is None:  # all of the lower range are test, and some of the upper one
            cut, halves, divided = cut_among(draws, test_size), {"train": [], "test": ["low"]}, "high"
        present = {p.split(f"{_RANGE}=")[1].split("/")[0] for p in Folder(self.spark, path).sizes()}
        splits = {s: [f"{staged}/{_RANGE}={h}" for h in names if h in present] for s, names in halves.items()}
        if divided in present:
            some = self.spark.read.parquet(f"{path}/{_RANGE}={divided}")
            is_test = F.lit(True) if cut is None else cut.holds(F.col(_DRAW))
            for split, keep in (("test", is_test), ("train", ~is_test)):
                part = self._new_folder(split)
                write_bounded(some.where(keep), f"{self.root}/{part}", max_bytes)
                splits[split].append(part)
        for split, parts in splits.items():
            if not parts:  # a split without rows still has its columns
                parts.append(self._new_folder(split))
                rows.limit(0).write.parquet(f"{self.root}/{parts[0]}")
        return self.publish(name, rows.schema, splits)


def write_bounded(rows: DataFrame, path: str, max_bytes: int = MAX_FILE_BYTES, *by: str) -> None:
    """Parquet files of at most `max_bytes`, one row per file at least.

    Sizes are those of the written files: what is too large is read and written once more with
    fewer rows to a file, until nothing is.
    """
    rows.write.partitionBy(*by).parquet(path)
    spark, folder = rows.sparkSession, Folder(rows.sparkSession, path)
    for share in (0.9, 0.5, 0.2, 0.0):
        large = {file: size for file, size in folder.sizes().items() if size > max_bytes}
        for file, size in large.items():
            some = spark.read.parquet(file)
            fewer = max(1, math.floor(some.count() * share * max_bytes / size))
            some.write.option("maxRecordsPerFile", fewer).mode("append").parquet(file.rsplit("/", 1)[0])
            folder.remove(file)
        if not large:
            return

