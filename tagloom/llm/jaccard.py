"""Jaccard join over word shingles: size bands, tiles, bitmaps, sorted arrays.

* Documents with the same set of shingles are one class; only classes are compared.
* Classes are banded by size. For a threshold t, sets A (the smaller) and B that are linked differ
  in at most |A| * (1 - t) / t shingles; in a band that is at most H. The shingles are dealt into
  H + 1 + spare segments by hash. A difference spoils one segment, so linked sets agree on 1 +
  spare of them, and hence on one of the H + 1 fullest segments of each. These are a class's
  tiles; linked classes share one. No link is lost, whatever the data.
* Classes that share a tile come together under the least class of the tile. Such blocks are cut
  into chunks of bounded size, and every two chunks are compared: first hashed bitmaps, whose
  differing bits bound the overlap from above, then exact intersections of sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import (
    PART_ROWS,
    Memo,
    add_columns,
    checkpointed,
    fields,
    keep_rows,
    text_bytes,
    text_key,
    whole_text,
)
from tagloom.llm.components import connected_components

#: Classes, and shingles, of a block that are compared at once with as many others.
CHUNK_CLASSES, CHUNK_SHINGLES = 256, 1_000_000
_BAND = 1.5
_TILE_BYTES = 6
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.hash = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()  # of bytes: A-Z, and ASCII white space
        hashes = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        if width == 0:
            return hashes
        n = len(words) - width + 1
        rolled = np.full(n, np.uint64(width))
        for i in range(width):
            rolled = _mixed(rolled * _C1 + hashes[i : i + n])
        return np.unique(rolled)


class Bands:
    """Size bands for links of at least `percent` per cent, and the tiles of a set in them."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.slack = 100 - percent

    def differing(self, smaller: int) -> int:
        """The most shingles in which linked sets differ, the smaller being of this size."""
        return smaller * self.slack // self.percent

    def of(self, size: int) -> Iterator[tuple[int, int, int]]:
        """(start, H, segments) of each band in which a set of this size is compared.

        A pair is compared in the band of the smaller set; the larger one may lie beyond its end.
        """
        start = 1
        while self.differing(start) == 0:  # smaller sets are linked to equal ones only
            start += 1
        while start <= size:
            after = max(start + 1, int(start * _BAND))
            if size * self.percent <= (after - 1) * 100:
                most = self.differing(after - 1)
                yield start, most, most + 1 + max(2, (most + 1) // 2)
            start = after

    def tiles(self, shingles: np.ndarray) -> np.ndarray:
        found = [np.empty(0, np.uint64)]
        for start, most, segments in self.of(len(shingles)):
            spread = _mixed(shingles + _C2)
            place = (spread % np.uint64(segments)).astype(np.int64)
            full = np.bincount(place, minlength=segments)
            order = np.argsort(place, kind="stable")
            held = np.flatnonzero(full)
            content = np.zeros(segments, np.uint64)
            content[held] = np.add.reduceat(_mixed(spread)[order], np.cumsum(full[held]) - full[held])
            named = _mixed(content + full.astype(np.uint64) * _C1 + np.arange(segments, dtype=np.uint64) * _C3)
            named = _mixed(named + np.uint64(start * int(_C2) % 2**64))
            found.append(named[np.lexsort((named, -full))[: most + 1]])
        return np.concatenate(found)


def _packed(tiles: np.ndarray) -> bytes:
    """Tiles cut to _TILE_BYTES; those that become equal only bring more sets together."""
    return tiles.view(np.uint8).reshape(-1, 8)[:, :_TILE_BYTES].tobytes()


def _tiles(found: DataFrame) -> DataFrame:
    """tile, c1: one row per tile of every set, dealt by tile."""
    schema = fields(tile="long", c1="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS)):
            packed = batch.column(1).cast(pa.large_binary())
            counts = pc.binary_length(packed).to_numpy() // _TILE_BYTES
            wide = np.zeros((counts.sum(), 8), np.uint8)
            wide[:, :_TILE_BYTES] = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, _TILE_BYTES)
            c1 = np.repeat(batch.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(wide.view(np.int64).ravel()), pa.array(c1)], ["tile", "c1"])

    told = found.where("n > 0 and tiles is not null").select("c1", "tiles")
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return told.mapInArrow(run, schema).repartition(partitions, "tile")


def _signatures(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """row, id, n, c1 and c2 (128-bit hash of the set), tiles (packed; a task tells a set's once)."""

    def setup():
        shingler, bands = Shingler(width), Bands(percent)
        told: set[bytes] = set()

        def work(texts):
            columns: list[list] = [[], [], [], []]
            for t in text_bytes(texts):
                shingles = shingler(t.as_py())
                name = xxhash.xxh3_128_digest(shingles.tobytes())
                digest = np.frombuffer(name, dtype="<i8")
                tiles = None if name in told else _packed(bands.tiles(shingles))
                told.add(name)
                row = (len(shingles), int(digest[0]), int(digest[1]), tiles)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return columns

        return work

    outputs = fields(n="long", c1="long", c2="long", tiles="binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), whole_text(text).alias("text"))
    return add_columns(rows, ["text"], outputs, setup, ["row", "id"])


def _with_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """The wanted classes with `shingles`, from the texts of their least ids."""

    def setup():
        shingler = Shingler(width)

        def work(texts):
            columns: list[list] = [[], [], []]
            for t in text_bytes(texts):
                shingles = shingler(t.as_py())
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype="<i8")
                for column, value in zip(columns, (int(digest[0]), int(digest[1]), shingles.view(np.int64)), strict=True):
                    column.append(value)
            return columns

        return work

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text).alias("text"))
    rows = rows.join(wanted, rows["id"].eqNullSafe(wanted["least_id"])).drop("id", "least_id")
    outputs = fields(s1="long", s2="long", shingles="array<long>")
    found = add_columns(rows, ["text"], outputs, setup, [c for c in rows.columns if c != "text"])
    # Rows of one id may have other sets.
    return found.where("s1 = c1 and s2 = c2")


class _Job:
    """Classes of one or two chunks of a block, compared with each other."""

    def __init__(self, root: int, i: int, j: int, rows: list[dict], percent: int) -> None:
        self.root, self.percent = root, percent
        rows.sort(key=lambda r: (r["chunk"], r["cid"]))
        # A class comes twice if rows of one id have equal sets.
        rows = [r for k, r in enumerate(rows) if not k or r["cid"] != rows[k - 1]["cid"]]
        self.across = i != j
        self.split = sum(r["chunk"] == i for r in rows)
        self.cid = np.array([r["cid"] for r in rows])
        self.copies = np.array([r["copies"] for r in rows])
        self.sets = [r["shingles"] for r in rows]
        self.size = np.array([len(s) for s in self.sets])
        self.roots = [r["roots"] for r in rows]
        self.first_root = np.array([r["roots"][0] for r in rows])
        self.bits = self._bitmaps()

    def _bitmaps(self) -> np.ndarray:
        width = 1 << max(6, int(self.size.max() - 1).bit_length())
        width = min(width, 1 << 14)
        bits = np.zeros((len(self.sets), width), dtype=bool)
        for row, s in zip(bits, self.sets, strict=True):
            row[s.view(np.uint64) % np.uint64(width)] = True
        return np.packbits(bits, axis=1).view(np.uint64)

    def _enough(self, common: np.ndarray, a, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)

    def _linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are linked to i, each pair in its first block only."""
        n, sizes = self.size[i], self.size[others]
        differ = np.bitwise_count(self.bits[i] ^ self.bits[others]).sum(axis=1, dtype=np.int64)
        others = others[self._enough((n + sizes - differ) // 2, n, sizes)]
        if not len(others):
            return others
        sizes = self.size[others]
        every = np.concatenate([self.sets[j] for j in others])
        own = self.sets[i]
        at = np.searchsorted(own, every)
        hit = own[np.minimum(at, n - 1)] == every
        common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        others = others[self._enough(common, n, sizes)]
        here = (self.first_root[others] == self.root) & (self.first_root[i] == self.root)
        own_roots = set(self.roots[i])
        for k in np.flatnonzero(~here):
            here[k] = min(own_roots.intersection(self.roots[others[k]])) == self.root
        return others[here]

    def run(self) -> Iterator[tuple[int, int, int | None]]:
        """(class, weight of its links, None) and (class, 0, linked class), a spanning forest."""
        count = len(self.sets)
        links = np.zeros(count, dtype=np.int64)
        label = np.arange(count)
        for i in range(self.split if self.across else count):
            start = self.split if self.across else i + 1
            near = self._linked(i, np.arange(start, count)) if start < count else []
            if not len(near):
                continue
            links[i] += self.copies[near].sum()
            links[near] += self.copies[i]
            apart = near[label[near] != label[i]]
            for other, k in zip(*np.unique(label[apart], return_index=True), strict=True):
                yield int(self.cid[i]), 0, int(self.cid[apart[k]])
                label[label == other] = label[i]
        for i in np.flatnonzero(links):
            yield int(self.cid[i]), int(links[i]), None


def _compare(members: DataFrame, percent: int) -> DataFrame:
    """cid, links, other: what the jobs of all blocks find."""
    keys = ["root", "i", "j"]
    columns = [*keys, "chunk", "cid", "copies", "roots", "shingles"]
    schema = fields(cid="long", links="long", other="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["cid", "links", "other"])

        for batch in batches:
            plain = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "chunk", "cid", "copies")]
            lists = []
            for c in ("roots", "shingles"):
                column = batch.column(c)
                values, ends = column.values.to_numpy(), column.offsets.to_numpy()
                lists.append((values, ends))
            for k in range(batch.num_rows):
                now = tuple(int(p[k]) for p in plain[:3])
                if now != key:
                    if rows:
                        out.extend(_Job(*key, rows, percent).run())
                    key, rows = now, []
                chunk, cid, copies = (int(p[k]) for p in plain[3:])
                roots, shingles = (v[e[k] : e[k + 1]] for v, e in lists)
                # Hashes are sorted as unsigned numbers; copies, as the batch goes.
                shingles = np.sort(shingles.copy())
                rows.append({"chunk": chunk, "cid": cid, "copies": copies, "roots": roots.tolist(), "shingles": shingles})
            if len(out) > 50_000:
                yield flush()
        if rows:
            out.extend(_Job(*key, rows, percent).run())
        yield flush()

    dealt = members.select(columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def _needed(inside: DataFrame) -> DataFrame:
    """c1, root without the blocks whose members all are in one earlier block too.

    The earliest block of its members is always kept, so every two members still meet.
    """
    inside = checkpointed(inside)
    first = inside.groupBy("c1").agg(F.min("root").alias("first"))
    spread = inside.join(first, "c1").groupBy("root").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    return inside.join(spread.where("low < high or low = root").select("root"), "root")


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 3,
    percent: int = 90,
    chunk_classes: int = CHUNK_CLASSES,
    chunk_shingles: int = CHUNK_SHINGLES,
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, n_links, set_hash.

    Words are split at ASCII white space, A-Z in lower case; the set holds the distinct shingles
    of `width` words, of shorter texts the whole sequence. Rows link when their intersection is
    at least `percent` per cent of their union; component_id is the least id reachable, n_links
    the number of rows linked directly, copies and repeated rows included. Null, empty and
    wordless texts have an empty set, no links and their own id as component. Null ids take part,
    but are no component_id unless nothing else is in reach; an empty table stays empty. Copies
    of any number count as one class, blocks of any size are cut into bounded chunks, and a very
    long text is a set like any other.
    """
    found = checkpointed(_signatures(docs, id_col, text, width, percent))
    keys = ["c1", "c2"]
    classes = found.where("n > 0").groupBy(*keys).agg(
        F.min("row").alias("cid"),
        F.min("id").alias("least_id"),
        F.count(F.lit(1)).alias("copies"),
        F.max("n").alias("n"),
    )
    tiles = _tiles(found)  # exchanged once, read for the tiles' least sets and again for their others
    shared = tiles.groupBy("tile").agg(F.min("c1").alias("root"), F.max("c1").alias("last")).where("root <> last")
    inside = _needed(tiles.join(shared, "tile").select("c1", "root").distinct())
    with_roots = inside.groupBy("c1").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    known = classes.join(with_roots, "c1")
    known = checkpointed(known)  # cid, c1, c2, least_id, copies, n, roots of the classes to compare
    members = known.select("cid", "n", F.explode("roots").alias("root"))
    blocks = members.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / chunk_classes), F.ceil(F.sum("n") / chunk_shingles)
        ).cast("int").alias("chunks")
    )
    blocks = checkpointed(blocks)  # so that Spark can split a large block in the join
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    placed = members.join(blocks, "root").withColumn("chunk", chunk)
    jobs = placed.select("cid", "root", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    jobs = jobs.select("cid", "root", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    # A class takes its jobs along to its text, so that its array is dealt once, to the jobs.
    of_each = jobs.groupBy("cid").agg(F.collect_list(F.struct("root", "chunk", "i", "j")).alias("jobs"))
    wanted = known.drop("n").join(of_each, "cid")
    sets = _with_sets(docs, wanted, id_col, text, width)
    compared = checkpointed(_compare(sets.select("*", F.inline("jobs")), percent))

    links = compared.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = compared.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    roots = connected_components(edges).toDF("cid", "component")
    joined = roots.join(known.select("cid", "least_id"), "cid")
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = joined.join(least, "component").select("cid", "component_id").join(links, "cid")
    of_class = classes.drop("n").join(linked, "cid", "left").select(
        *keys, "copies", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
    rows = found.select("id", "n", *keys)
    whole = rows.join(of_class, (rows["n"] > 0) & (rows["c1"] == of_class["c1"]) & (rows["c2"] == of_class["c2"]), "left")
    return whole.select(
        rows["id"].alias(id_col),
        rows["n"].alias("n_shingles"),
        F.coalesce("component_id", rows["id"]).alias("component_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
        F.concat(F.hex(rows["c1"]), F.lit(":"), F.hex(rows["c2"])).alias("set_hash"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with the least id of each component, columns as they are.

    Rows link when their sets of five-word shingles share 80 per cent or more of their union; the
    defaults of `jaccard_join` are those of op9's result instead.
    Rows of one id are told apart by their text, of repeated rows one stays; null ids come last.
    Rows without words are linked with nothing and stay.
    """
    given, whole = F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")
    # Ordered by id, then by text; the least one of a component is kept.
    name = F.struct(given.isNull().alias("no_id"), given.alias("id"), text_key(whole, given).alias("key"))
    found = jaccard_join(docs.select(name.alias("name"), whole.alias("text")), "name", "text", width, percent)
    kept = found.where(F.col("name") == F.col("component_id")).select("name.key").distinct()
    return keep_rows(docs, text_key(whole, given), kept, one_each=True)
