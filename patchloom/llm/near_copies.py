"""Operator 3 for texts that are alike rather than nearly equal: five-word shingles, similarity of 0.8 or more.

At such a similarity fingerprints differ in some ten bits, too many for files of equal blocks. Documents are filed under their
KEYS smallest shingle hashes instead (two documents at 0.8 share none with a chance of 0.2 ** KEYS), files are compared
bit-sliced as in simhash, here with five carry-save counters and RADIUS 24, and what is within the radius is confirmed by
the similarity of the two sets of shingles. A pair that earlier links already connect is not looked at again.

Files with over FILE members (a common line is the smallest shingle of all its documents) are cut into blocks, and every two
blocks are compared in a task of their own, so no task holds more than two blocks and no pair of a file is left out.

Defined cases: texts under five words are one shingle; null, empty and blank texts are alike; equal sets are alike; repeated
doc_ids are one group; documents without doc_id are never dropped; an empty table gives an empty result; other
columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .components import connected_components
from .simhash import SEED, planes

WIDTH = 5
SIMILARITY = 0.8
KEYS = 6
RADIUS = 24
#: Members of a file that are compared in one task at most.
FILE = 2048

_ODD = np.random.default_rng(20240608).integers(1 << 62, 1 << 63, size=(KEYS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = "doc_id long, fp long, keys array<long>, shingles binary"


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; ASCII letters in lower case."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - width + 1))


def sketch(h: np.ndarray) -> tuple[int, list[int]]:
    """(fingerprint, smallest hashes by KEYS orders), as signed longs."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]
    keys = []
    for a, b in _ODD:
        x = (h ^ a) * b
        keys.append(int(((x ^ (x >> np.uint64(31))) * a).min().view(np.int64)))
    return int(fp), keys


def sketches(docs: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes = [shingle_hashes(x) for x in part.column("text").to_pylist()]
                made = [sketch(h) for h in hashes]
                sets = [np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for h in hashes]
                columns = [part.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "keys", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, _SKETCH)


def within_radius(vertical: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Lanes within RADIUS of each query: five counters hold distances up to 31, over what passes that."""
    counters = [np.zeros(np.broadcast_shapes(vertical.shape[1:], query.shape[1:]), dtype=np.uint64) for _ in range(5)]
    over = np.zeros_like(counters[0])
    for p in range(len(vertical)):
        carry = vertical[p] ^ query[p]
        for i in range(5):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if p % 8 == 7:
            # RADIUS is 24: beyond it both high counters are set and one of the low ones
            over |= counters[4] & counters[3] & (counters[2] | counters[1] | counters[0])
            if not (~over).any():
                break
    return ~over


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared)


def links(ids: np.ndarray, fps: np.ndarray, sets: list[bytes], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the links of one file."""
    n = len(ids)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    arrays = [np.frombuffer(s, dtype="<u4") for s in sets]
    bits = list(range(64))
    vertical, found = planes(fps, bits)[:, None, :], []
    step = max(1, (1 << 20) // max(1, vertical.shape[2] * 64))
    for at in range(0, n, step):
        query = np.stack([(np.uint64(0) - ((fps[at : at + step] >> np.uint64(b)) & np.uint64(1)))[:, None] for b in bits])
        hits = np.unpackbits(within_radius(vertical, query).view(np.uint8), axis=1, bitorder="little")[:, :n]
        for i in range(len(hits)):
            x = at + i
            for y in np.flatnonzero(hits[i, :x]).tolist():
                if find(x) != find(y) and similar(arrays[x], arrays[y], least):
                    root[find(x)] = find(y)
                    found.append((int(ids[x]), int(ids[y])))
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file; a file may span batches."""
    key, ids, fps, sets = None, [], [], []

    def flush() -> pa.RecordBatch:
        found = links(np.array(ids, dtype=np.int64), np.array(fps, dtype=np.int64).view(np.uint64), sets) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "uid", "fp", "shingles")), strict=True):
            if row[:2] != key:
                if len(ids) > 1:
                    yield flush()
                key, ids, fps, sets = row[:2], [], [], []
            ids.append(row[2])
            fps.append(row[3])
            sets.append(row[4])
    yield flush()


def files(rows: DataFrame, scratch: Scratch, most: int = FILE) -> DataFrame:
    """file, part, uid of all files of two members or more; part tells block pairs of files over the limit."""
    chosen = [F.xxhash64(F.lit(1), F.struct(F.lit(i), F.element_at("keys", i + 1))) for i in range(KEYS)]
    filed = scratch.save(rows.select("uid", F.explode(F.array_distinct(F.array(*chosen))).alias("file")), "filed")
    sizes = scratch.save(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    every = filed.join(sizes, "file")
    blocks = F.ceil(F.col("n") / most)
    own = F.pmod(F.xxhash64("uid"), blocks)
    # block pairs (i, j) with i <= j that a member's own block belongs to
    others = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    part = F.when(F.col("n") <= most, F.array(F.lit(0).cast("long"))).otherwise(others)
    return every.select("file", "uid", F.explode(part).alias("part"))


def similar_groups(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, most: int = FILE) -> DataFrame:
    """uid, doc_id, root: a row per document, root the uid that stands for its group."""
    scratch = scratch or Scratch(spark, "near-copies")
    rows = scratch.save(sketches(docs).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    filed = scratch.save(files(rows.select("uid", "keys"), scratch, most), "files")
    scratch.release()
    compared = filed.join(rows.select("uid", "fp", "shingles"), "uid")
    compared = compared.repartition(shuffle_partitions(spark), "file", "part").sortWithinPartitions("file", "part", "uid")
    roots = connected_components(compared.select("file", "part", "uid", "fp", "shingles").mapInArrow(_compare, "a long, b long"), scratch)
    return rows.select("uid", "doc_id").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without those whose group has a smaller doc_id, all columns kept."""
    scratch = Scratch(spark, "near-copies")
    groups = scratch.save(similar_groups(spark, docs, scratch), "groups")
    linked = groups.join(groups.where("uid <> root").select("root").distinct(), "root")
    least = scratch.save(linked.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    gone = scratch.save(linked.join(least, "root").where("doc_id <> least").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    scratch.release()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__gone"], "left_anti")
