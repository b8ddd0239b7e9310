"""Operator 6, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbouring words and pairs with one word between them, hashed to DIMENSIONS
places. Training visits a bounded sample of labelled rows in a fixed order, with a learning rate per coordinate and an L1
penalty that leaves few weights; those are broadcast and every whole text is scored where it is read.

A label counts only if crc32 of its doc_id as text is not 1 modulo 3; labels, lang, source and doc_id never enter a score.

Defined cases: a null or empty text has no features and gets the score of the bias; without labels, or with one class only,
every score is the (smoothed) share of toxic labels; of repeated labels the largest counts; a repeated document is scored
as often as it occurs and learnt from once, by its largest text; documents without doc_id are scored and count as not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DIMENSIONS = 1 << 20
#: Labelled rows used for training at most: those with the smallest hash of doc_id; and bytes of their features at most,
#: beyond which the rows with the largest hashes are left out.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 16_000, 256 << 20
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.01
PREDICT_FROM = 0.7
_CACHE_WORDS = 200_000
_BLOCK_WORDS = 1 << 20

_PAIR, _SKIP, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


class WordHasher:
    """Hashes of the words of a text: runs of letters, digits and underscores, in lower case."""

    def __init__(self) -> None:
        import re

        import xxhash

        self.words, self.hash, self.known = re.compile(r"\w+").findall, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words((text or "").lower())
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.hash(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def features(h: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Distinct feature places of a text, ascending, from the hashes of its words."""
    found = np.zeros(0, dtype=np.int64)
    shift = np.uint64(64 - (dimensions.bit_length() - 1))
    for at in range(0, len(h), _BLOCK_WORDS):
        x = h[at : at + _BLOCK_WORDS + 2]
        parts = [x[: _BLOCK_WORDS] * _MIX, (x[:-1] * _PAIR ^ x[1:]) * _MIX, (x[:-2] * _SKIP ^ x[2:]) * _MIX]
        part = np.unique((np.concatenate(parts) >> shift).astype(np.int64))
        found = part if not at else np.union1d(found, part)
    return found


class Ftrl:
    """FTRL-proximal logistic regression on sparse binary features, with an unpenalised bias."""

    def __init__(self, dimensions: int = DIMENSIONS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dimensions), np.zeros(dimensions)
        self.bias = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = sigmoid(self.bias + w.sum())
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= self.alpha * g / (self.beta + self.bias_n**0.5)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """h, text, toxic of the sample: most rows at most, one for each doc_id, so the chosen labels may be broadcast."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    per_doc = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = per_doc.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.first("h").alias("h"), F.max("text").alias("text"), F.first("toxic").alias("toxic")).select("h", "text", "toxic")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            places = [features(hasher(x)).astype("<i4").tobytes() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("toxic"), pa.array(places, pa.binary())], names=["h", "toxic", "places"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, places, weights) with the places whose weight is not zero.

    Features are extracted in parallel; one task then learns from the bounded sample and returns the sparse weights,
    DIMENSIONS of them at most.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(x, dtype="<i4")) for b in batches for y, x in zip(b.column("toxic").to_pylist(), b.column("places").to_pylist(), strict=True)]
        toxic = sum(y for y, _ in rows)
        model = Ftrl()
        model.bias = float(np.log((toxic + 0.5) / (len(rows) - toxic + 0.5)))
        if 0 < toxic < len(rows):
            for _ in range(EPOCHS):
                for y, x in rows:
                    model.learn(x, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([model.bias, *w[at].tolist()], pa.float64())], names=["place", "weight"])

    scratch = Scratch(spark, "toxicity")
    rows = scratch.save(training_rows(docs, labels, most).mapInArrow(_extract, "h long, toxic int, places binary"), "features")
    used, last = 0, None
    for r in rows.select("h", F.octet_length("places").alias("size")).orderBy("h").collect():
        used += r["size"]
        if used > MAX_TRAINING_BYTES:
            break
        last = r["h"]
    rows = rows if last is None else rows.where(F.col("h") <= last)
    found = rows.repartition(1).sortWithinPartitions("h", "places").mapInArrow(learn, "place long, weight double").collect()
    bias = sum(r.weight for r in found if r.place < 0)
    sparse = sorted((r.place, r.weight) for r in found if r.place >= 0)
    return bias, np.array([p for p, _ in sparse], dtype=np.int64), np.array([w for _, w in sparse], dtype=np.float64)


def score(spark: SparkSession, docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names) and score."""
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    position = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        bias, places, values = shared.value
        dense = np.zeros(DIMENSIONS)
        dense[places] = values
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = pc.struct_field(part.column(0), position).to_pylist()
                scores = [sigmoid(bias + dense[features(hasher(x))].sum()) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(task, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    model = train(spark, docs, labels, most)
    scored = score(spark, docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under PREDICT_FROM, with all their columns."""
    return score(spark, docs, train(spark, docs, labels)).where(F.col("score") < PREDICT_FROM).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
