"""Ranked search: range-maximum tables over posting lists, documents taken best first.

* Queries are dealt into blocks of bounded size. Of a block's terms, and no others, one scan of
  the documents notes how often each occurs; counts of documents, terms and lengths follow.
* A task turns its documents into shards of bounded size. Of each term a shard has a posting list
  in order of documents, with a sparse table that gives the place of the greatest impact between
  any two postings.
* Per query a heap holds intervals of documents under the sum of their terms' greatest impacts.
  The highest one is split at the document where the largest of these stands, which is scored;
  small intervals are scored whole. The search ends where no interval can beat the k-th best, and
  what a task has found so far counts for its next shard.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import add_columns, checkpointed, fields, text_bytes, whole_text

#: Documents of a shard, documents of an interval scored whole, and terms of a block of queries.
SHARD_DOCS, LEAF_DOCS, BLOCK_TERMS = 16_384, 256, 100_000
_SCALE, _B = 1_000_000_000, 75
#: Bytes to what they count as: letters in lower case, digits, all else a blank.
_AS_TERMS = bytes(
    b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(raw: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and all beyond ASCII; A-Z in lower case."""
    return raw.translate(_AS_TERMS).split()


class SparseTable:
    """Where the greatest of any range of values stands, by tables of ranges of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.rows = [np.arange(len(values))]
        span = 1
        while 2 * span <= len(values):
            a, b = self.rows[-1][:-span], self.rows[-1][span:]
            self.rows.append(np.where(values[a] >= values[b], a, b))
            span *= 2

    def at(self, low: int, high: int) -> int:
        """Place of the greatest value from low to high (exclusive, and above low)."""
        row = (high - low).bit_length() - 1
        a, b = self.rows[row][low], self.rows[row][high - (1 << row)]
        return int(a if self.values[a] >= self.values[b] else b)


class Shard:
    """Posting lists of some documents, in order of their ids."""

    def __init__(self, ids: Sequence, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, length: np.ndarray, total: tuple[int, int]) -> None:
        n_docs, n_terms = total
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = 100 - _B + (_B * length * n_docs) // max(1, n_terms)
        doc = np.repeat(np.arange(len(ids)), sizes)
        impact = (_SCALE * tf) // (1000 * tf + 8 * m[doc])
        doc = place[doc]
        by_term = np.lexsort((doc, terms))
        self.terms, starts = np.unique(terms[by_term], return_index=True)
        self.starts = np.append(starts, len(terms))
        self.docs, self.impacts = doc[by_term], impact[by_term]
        self.tables: dict[int, tuple] = {}

    def postings(self, term: int) -> tuple[np.ndarray, SparseTable] | None:
        """Documents and table of a term's impacts; built when first asked for."""
        if term not in self.tables:
            at = int(np.searchsorted(self.terms, term))
            found = None
            if at < len(self.terms) and self.terms[at] == term:
                some = slice(self.starts[at], self.starts[at + 1])
                found = self.docs[some], SparseTable(self.impacts[some])
            self.tables[term] = found
        return self.tables[term]


class Best:
    """The k best of a query so far: higher scores first, then lower ids, none at last."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, []

    def key(self, score: int, doc) -> tuple:
        return -score, doc is None, doc or 0

    def add(self, score: int, doc) -> None:
        if score > 0:
            self.found.append((self.key(score, doc), doc))
            self.found.sort(key=lambda f: f[0])
            del self.found[self.k :]

    def open_to(self, score: int, doc) -> bool:
        """Whether a document of this id could still come in with this score."""
        return score > 0 and (len(self.found) < self.k or self.key(score, doc) < self.found[-1][0])


def search(shard: Shard, query: Sequence[tuple[int, int]], best: Best, leaf: int) -> int:
    """Adds the shard's best documents for (term, weight) pairs; returns how many were scored."""
    lists = []
    for term, weight in query:
        found = shard.postings(term)
        if found is not None and weight > 0:
            lists.append((weight, *found))
    scored = 0

    def bounded(low: int, high: int, ranges: list[tuple[int, int]]):
        """Heap entry of documents low to high: bound, ranges of postings, document to split at."""
        bound, greatest, split, inner = 0, -1, -1, []
        for (weight, docs, table), (a, b) in zip(lists, ranges, strict=True):
            # Only the part of the list within the interval.
            a, b = a + int(docs[a:b].searchsorted(low)), a + int(docs[a:b].searchsorted(high))
            inner.append((a, b))
            if a < b:
                at = table.at(a, b)
                value = weight * int(table.values[at])
                bound += value
                if value > greatest:
                    greatest, split = value, int(docs[at])
        return -bound, low, high, split, inner

    heap = [bounded(0, len(shard.ids), [(0, len(docs)) for _, docs, _ in lists])]
    while heap:
        bound, low, high, split, ranges = heapq.heappop(heap)
        if not best.open_to(-bound, shard.ids[low]):
            if not bound or bound > best.found[-1][0][0]:
                break  # the highest bound left is below the k-th score
            continue
        if high - low <= leaf:
            sums = np.zeros(high - low, np.int64)
            for (weight, docs, table), (a, b) in zip(lists, ranges, strict=True):
                sums[docs[a:b] - low] += weight * table.values[a:b]
            scored += high - low
            for i in np.argsort(-sums, kind="stable")[: best.k].tolist():
                if best.open_to(int(sums[i]), shard.ids[low + i]):
                    best.add(int(sums[i]), shard.ids[low + i])
            continue
        score = 0
        for (weight, docs, table), (a, b) in zip(lists, ranges, strict=True):
            at = a + int(docs[a:b].searchsorted(split))
            if at < b and docs[at] == split:
                score += weight * int(table.values[at])
        scored += 1
        if best.open_to(score, shard.ids[split]):
            best.add(score, shard.ids[split])
        for a, b in ((low, split), (split + 1, high)):
            if a < b:
                part = bounded(a, b, ranges)
                if best.open_to(-part[0], shard.ids[a]):
                    heapq.heappush(heap, part)
    return scored


def _noted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """id, n (terms), terms and tfs (of the queries' terms) of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def setup():
        known = shared.value

        def work(texts):
            columns: list[list] = [[], [], []]
            for t in text_bytes(texts):
                counts = Counter(terms_of(t.as_py()))
                held = [(known[term], counts[term]) for term in known.keys() & counts.keys()]
                columns[0].append(counts.total())
                columns[1].append([term for term, _ in held])
                columns[2].append([n for _, n in held])
            return columns

        return work

    outputs = fields(n="long", terms="array<int>", tfs="array<int>")
    return add_columns(docs, ["text"], outputs, setup, ["id"]).where("n > 0")


def _searched(noted: DataFrame, queries: list[list[tuple[int, int]]], total: tuple[int, int], k: int, shard_docs: int, leaf: int) -> DataFrame:
    """query, doc, score: the k best of every task."""
    shared = noted.sparkSession.sparkContext.broadcast(queries)
    schema = fields(query="int", doc="long", score="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]
        held: list[pa.RecordBatch] = []

        def look() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
            shard = Shard(
                table.column("id").to_pylist(),
                terms.value_lengths().to_numpy(),
                terms.flatten().to_numpy().astype(np.int64),
                tfs.flatten().to_numpy().astype(np.int64),
                table.column("n").to_numpy(),
                total,
            )
            for query, mine in zip(shared.value, best, strict=True):
                search(shard, query, mine, leaf)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, shard_docs):
                held.append(batch.slice(at, shard_docs))
                if sum(b.num_rows for b in held) >= shard_docs:
                    look()
        if held:
            look()
        rows = [(q, doc, -key[0]) for q, b in enumerate(best) for key, doc in b.found]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return noted.mapInArrow(run, schema)


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list]:
    """Rows (number, id, terms of the item), block by block; a block has few terms, or one item."""
    block, size = [], 0
    for row in items.toLocalIterator():
        terms = terms_of((row["text"] or "").encode())
        if block and size + len(terms) > block_terms:
            yield block
            block, size = [], 0
        block.append((row["id"], Counter(terms)))
        size += len(terms)
    if block:
        yield block


def rank_documents(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    shard_docs: int = SHARD_DOCS,
    leaf_docs: int = LEAF_DOCS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """query id, rank, id, score: the k documents of highest score above 0 for each row of queries.

    A term is a maximal run of letters and digits (all beyond ASCII included), A-Z in lower case.
    With N documents that have terms, L terms in all, n in a document, df documents with a term and
    tf occurrences: m = 25 + (75 n N) div L, and a score sums floor(1000 ln((2 N + 2) / (2 df + 1)))
    * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, repeats included. Equal scores go by
    ascending id, null ids last; repeated rows are documents of their own, and repeated queries
    queries of their own. Null and wordless texts are no documents, such queries have no rows; empty
    tables give none. Queries come to the driver in blocks of at most `block_terms` terms (or of one
    query), each searched in one go; whole texts are read, however long.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text).alias("text"))
    items = queries.select(F.col(f"`{query_id}`").alias("id"), F.col(f"`{query_text}`").cast("string").alias("text"))
    id_type = items.schema["id"].dataType.simpleString()
    results = []
    for block in _blocks(items, block_terms):
        numbers = {term: i for i, term in enumerate(sorted(set().union(*(terms for _, terms in block))))}
        noted = checkpointed(_noted(rows, numbers))
        n_docs, n_terms = noted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row per term of the block.
        df = dict(noted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        inside = np.array([df.get(i, 0) for i in range(len(numbers))], np.float64)
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * inside + 1))).astype(np.int64).tolist()
        asked = [[(numbers[t], q * weights[numbers[t]]) for t, q in terms.items()] for _, terms in block]
        found = _searched(noted, asked, (n_docs, n_terms), k, shard_docs, leaf_docs)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item {id_type}")
        first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        results.append(
            ranked.join(F.broadcast(names), "query").select(
                F.col("item").alias(query_id), "rank", F.col("doc").alias(id_col), "score"
            )
        )
    if not results:
        return spark.createDataFrame([], f"`{query_id}` {id_type}, rank int, `{id_col}` long, score long")
    return reduce(DataFrame.unionAll, results)
