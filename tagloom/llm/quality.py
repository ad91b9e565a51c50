"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space.

A text is a bag of hashed terms: its words, the shapes of its words, and, for a word that repeats
the one before, a repeat term in its place. The space is fitted on a bounded sample of labelled rows; its vectors are broadcast, and
every text is compared with all of them, block by block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Memo, add_columns, checkpointed, fields, text_bytes

WORD_TERMS, SHAPE_TERMS, REPEAT_TERMS = 4096, 2048, 32
TERMS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS
_BLOCK = 512
_CLASSES = bytes.maketrans(
    bytes(range(256)),
    bytes(
        ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128
        else ord("d") if 48 <= b <= 57 else b
        for b in range(256)
    ),
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


@dataclass(frozen=True)
class VoteParams:
    """The sample holds at most `per_label` rows of each label; memory grows with it alone."""

    per_label: int = 1500
    rank: int = 64
    neighbours: int = 31
    threshold: float = 0.5
    seed: int = 17


@dataclass(frozen=True)
class LabelledSpace:
    """Weight of each term, basis of the space, unit vectors of the labelled texts, labels."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, each weighted by its cosine; the
        prior where none has a positive one."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        unit = _unit((np.log1p(counts) * self.weight) @ self.basis)
        cosine = unit @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
        total = vote.sum(axis=1)
        good = (vote * self.labels[near]).sum(axis=1)
        return np.where(total > 0, good / np.where(total > 0, total, 1), self.prior)


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def _terms(word: bytes) -> int:
    """Term of a word and term of its shape, packed into one number."""
    plain = word.lower().strip(b".,;:!?")
    shape = _RUN.sub(rb"\1", word.translate(_CLASSES))
    a = xxhash.xxh3_64_intdigest(plain) % WORD_TERMS
    b = xxhash.xxh3_64_intdigest(shape, seed=1) % SHAPE_TERMS
    return a << 32 | b


class TermCounter:
    def __init__(self) -> None:
        self.terms = Memo(_terms)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Dense term counts, one row per text."""
        out = np.zeros((len(texts), TERMS), dtype=np.float32)
        for row, raw in zip(out, texts, strict=True):
            words = raw.split()
            packed = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
            new = np.ones(len(packed), dtype=bool)
            new[1:] = packed[1:] != packed[:-1]
            row[:WORD_TERMS] = np.bincount(packed[new] >> 32, minlength=WORD_TERMS)
            shapes = np.bincount(packed & 0xFFFFFFFF, minlength=SHAPE_TERMS)
            row[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = shapes
            again = (packed[~new] >> 32) % REPEAT_TERMS
            row[-REPEAT_TERMS:] = np.bincount(again, minlength=REPEAT_TERMS)
        return out


def fit(texts: list[bytes], labels: list[int], params: VoteParams) -> LabelledSpace:
    """Inverse document frequency, then a truncated singular value decomposition by subspace
    iteration from a fixed random start."""
    counts = TermCounter().counts(texts)
    n = len(labels)
    weight = np.log((n + 1) / ((counts > 0).sum(axis=0) + 1)).astype(np.float32) + 0.1
    matrix = np.log1p(counts, out=counts)
    matrix *= weight
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    rank = max(1, min(params.rank, n))
    basis = np.random.default_rng(params.seed).standard_normal((TERMS, rank)).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    return LabelledSpace(
        weight, basis, _unit(matrix @ basis), np.asarray(labels, dtype=np.float64), params.neighbours
    )


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, params: VoteParams, label: str = "quality"
) -> DataFrame:
    """(doc_id, text, label) of at most `per_label` rows a label, the first by hash of the id.

    Of several labels of one id the larger counts, of several texts the smallest. The ids are
    chosen first, so only the chosen texts move.
    """
    marked = labels.where(f"doc_id is not null and {label} in (0, 1)")
    one = marked.groupBy("doc_id").agg(F.max(label).alias("label"))
    # A label may be of a document that is not there (any more).
    known = one.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for value in (0, 1):
        part = (
            known.where(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(params.per_label)
        )
        chosen = part if chosen is None else chosen.union(part)
    chosen = F.broadcast(checkpointed(chosen))  # at most 2 * per_label ids
    texts = docs.join(chosen, "doc_id").groupBy("doc_id")
    return texts.agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


def fit_votes(docs: DataFrame, labels: DataFrame, params: VoteParams, label: str = "quality") -> LabelledSpace:
    """The space of a labelled sample; the sample, at most 2 * per_label texts, is fetched."""
    rows = labelled_sample(docs, labels, params, label).orderBy("doc_id").collect()
    return fit([r["text"].encode() for r in rows], [r["label"] for r in rows], params)


def score_quality(
    df: DataFrame,
    space: LabelledSpace,
    text: str = "text",
    threshold: float = 0.5,
    keep: list[str] | None = None,
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on).

    Pure map over the broadcast space: no shuffle. Null, empty and wordless texts get the sample's
    share of label 1, and 0.5 where no row is labelled. Repeated rows score alike, an empty table
    stays empty, input columns of the names added are replaced; every word of a very long text
    counts. A score at the threshold is a 1.
    """
    shared = df.sparkSession.sparkContext.broadcast(space)

    def setup():
        counter = TermCounter()

        def work(texts):
            raw = [t.as_py() for t in text_bytes(texts)]
            scores = [
                shared.value.score(counter.counts(raw[at : at + _BLOCK]))
                for at in range(0, len(raw), _BLOCK)
            ]
            score = np.concatenate([np.empty(0), *scores])
            return score, (score >= threshold).astype(np.int32)

        return work

    outputs = fields(**{names[0]: "double", names[1]: "int"})
    return add_columns(df.withColumn(text, F.col(text).cast("string")), [text], outputs, setup, keep)


def keep_good(df: DataFrame, space: LabelledSpace, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows scored at least `threshold`, columns as they are."""
    names, taken = ["score", "predicted"], {c.lower() for c in df.columns}
    for i, name in enumerate(names):
        while name in taken:
            name += "_"
        names[i] = name
    scored = score_quality(df, space, text, threshold, names=tuple(names))
    return scored.where(F.col(names[1]) == 1).select(*(F.col(f"`{c}`") for c in df.columns))
