"""Quality by nearest neighbours in a latent-semantic space.

A text's terms are its words and the shapes of its words (letters, capitals,
digits and marks), alone and in pairs, and how often a word repeats the one
before. TF-IDF vectors of a bounded sample of labelled texts give the space by
a singular value decomposition; the sample's vectors are broadcast. Every text
of the corpus is projected, compared with all of them by exact cosine products
in blocks, and its nearest neighbours vote with their similarity as weight.

The sample has `SAMPLE_PER_CLASS` texts for each label at most, the first by a
hash of their ids, so its size, and that of what is broadcast, is fixed. Null
texts count as empty. A text without terms is like none and scores the share
of good labels among its equals in the sample, or 0.5. Repeated rows score
alike, other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_blocks

SAMPLE_PER_CLASS = 1500
SHAPE_TERMS, WORD_TERMS = 1024, 1024
DIMENSIONS = 32
NEIGHBOURS = 15
#: The words' share of a vector; shapes have the rest.
WORD_SHARE = 0.3
FOLDS, HELD_OUT = 3, 1

_SHAPE = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"([Xx0])\1+|([^Xx0\s])\2+")


def term_counts(text: str) -> tuple[Counter, Counter]:
    """Counts of hashed shape terms and word terms of a whole text."""
    raw = text.encode()
    words = raw.lower().split()
    shapes = _RUNS.sub(rb"\1\2", raw.translate(_SHAPE)).split()
    by_shape: Counter = Counter()
    for shape, n in Counter(shapes).items():
        by_shape[zlib.crc32(shape) % SHAPE_TERMS] += n
    for (a, b), n in Counter(zip(shapes, shapes[1:], strict=False)).items():
        by_shape[zlib.crc32(a + b" " + b) % SHAPE_TERMS] += n
    again = sum(map(bytes.__eq__, words, words[1:]))
    for share in (0.05, 0.2, 0.5):  # strong terms for texts that repeat words
        if again > share * len(words):
            by_shape[zlib.crc32(b"same word %g" % share) % SHAPE_TERMS] += len(words) ** 2
    by_word: Counter = Counter()
    for word, n in Counter(words).items():
        by_word[zlib.crc32(word) % WORD_TERMS] += n
    return by_shape, by_word


def term_matrix(texts: list[str]) -> np.ndarray:
    """Raw counts, a row for each text."""
    out = np.zeros((len(texts), SHAPE_TERMS + WORD_TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        by_shape, by_word = term_counts(text)
        row[list(by_shape)] = list(by_shape.values())
        row[[SHAPE_TERMS + k for k in by_word]] = list(by_word.values())
    return out


@dataclass
class LatentSpace:
    """TF-IDF weights, the projection, and the labelled texts' unit vectors."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Unit vectors of shapes and of words, joined by their shares."""
        x = np.log1p(counts) * idf
        for part, share in ((slice(0, SHAPE_TERMS), 1 - WORD_SHARE), (slice(SHAPE_TERMS, None), WORD_SHARE)):
            norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
            x[:, part] *= np.sqrt(share) / np.maximum(norm, 1e-12)
        return x

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray) -> LatentSpace:
        df = np.count_nonzero(counts, axis=0)
        idf = np.log((1 + len(counts)) / (1 + df)).astype(np.float32) + np.float32(0.1)
        x = cls.weigh(counts, idf)
        _, axes = np.linalg.eigh(x.T @ x)
        axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS], dtype=np.float32)
        out = cls(idf, axes, np.zeros((0, axes.shape[1]), np.float32), labels.astype(np.float32))
        out.vectors = out.project(counts)
        return out

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = self.weigh(counts, self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled texts."""
        if not len(self.vectors):
            return np.full(len(vectors), 0.5)
        k = min(NEIGHBOURS, len(self.vectors))
        out = np.empty(len(vectors))
        for a in range(0, len(vectors), 256):
            sims = vectors[a : a + 256] @ self.vectors.T
            near = np.argpartition(sims, len(self.vectors) - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(sims, near, axis=1), 1e-6).astype(np.float64) ** 4
            out[a : a + 256] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(self.vote(self.project(term_matrix(texts))), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> LatentSpace:
    """From documents with a label whose id isn't in the held-out fold.

    `labels` may repeat an id; its least label counts. Null ids and labels count
    as none. Of several texts of one id the least counts.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min("quality").alias("label"))
    )
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS)
        chosen = some if chosen is None else chosen.union(some)
    rows = sorted({(r["id"], r["label"]) for r in chosen.collect()})
    # The sample is bounded, so its ids can be part of the scan's filter.
    picked = docs.select("doc_id", "text").where(F.col("doc_id").isin([i for i, _ in rows]) if rows else F.lit(False))
    picked = picked.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = term_matrix([t or "" for t in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["doc_id", "counts"]
            )

    found = {r["doc_id"]: np.frombuffer(zlib.decompress(r["counts"]), np.float32) for r in picked.mapInArrow(count, "doc_id long, counts binary").collect()}
    ids = [(i, y) for i, y in rows if i in found]
    size = SHAPE_TERMS + WORD_TERMS
    counts = np.stack([found[i] for i, _ in ids]) if ids else np.zeros((0, size), np.float32)
    return LatentSpace.fit(counts, np.array([y for _, y in ids]))


def scored(docs: DataFrame, space: LatentSpace) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            s = shared.value.score([t or "" for t in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(s)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, space: LatentSpace) -> DataFrame:
    """Rows that score 0.5 or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            s = shared.value.score([t or "" for t in block.column("text").to_pylist()])
            yield pc.filter(block, pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
