"""Operator 3, SimHash near-duplicates with bit-sliced comparison.

Fingerprints are counted per bit over the hashes of 3-word shingles. Equal fingerprints become one. For the comparison,
the 64 bits are cut into 8 blocks; fingerprints at RADIUS 2 or less agree on at least 6 of them, so each is filed under
the 28 choices of 6 blocks. What shares a file can differ in 16 bits only, so a file holds 65,536 distinct
fingerprints at most, whatever the input. Within a file, bit planes are stored vertically, one machine word for 64
fingerprints; carry-save counters add up many distances at once, and a block of them is abandoned once all exceed the radius.

A file yields a spanning forest of its links, never its pairs. Components come from the union of these forests.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; repeated rows share a
fingerprint; a null doc_id is a member like any other and never gives a component its id (a component without any
doc_id has a null one); an empty table gives an empty result; further columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup, shuffle_partitions, table
from .components import connected_components

WIDTH = 3
SEED = 42
RADIUS = 2
BLOCKS, BLOCK_BITS = 8, 8
#: For each file kind, the bits that its members may differ in.
FREE = [sorted(b * BLOCK_BITS + i for b in pair for i in range(BLOCK_BITS)) for pair in combinations(range(BLOCKS), RADIUS)]
_COUNTED = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is set if over half of the shingles' hashes have it."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    for at in range(0, n, _COUNTED):
        bits = np.unpackbits(hashes[at : at + _COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(x) for x in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, fp long")


def planes(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """Vertical form: row p has bit bits[p] of every fingerprint, 64 to a word."""
    words = -(-len(fps) // 64)
    out = np.zeros((len(bits), words * 64), dtype=np.uint8)
    for p, bit in enumerate(bits):
        out[p, : len(fps)] = (fps >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def near(vertical: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Words of a bit for each lane within RADIUS of the query. vertical: (planes, ..., words); queries: all-ones or zero words.

    Two carry-save counters hold each lane's distance up to 3; RADIUS is 2, so both set means beyond it, for good.
    """
    ones, twos, over = (np.zeros(np.broadcast_shapes(vertical.shape[1:], queries.shape[1:]), dtype=np.uint64) for _ in range(3))
    for p in range(len(vertical)):
        differ = vertical[p] ^ queries[p]
        carry = ones & differ
        ones ^= differ
        over |= twos & (carry | ones)
        twos |= carry
        if p % 4 == 3 and not (~over).any():
            break
    return ~over


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b connect it with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links in files of 2 to 64 members, all files at once: a word has the members of one file."""
    file_of = np.repeat(np.arange(len(starts)), sizes)
    rows = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    lane = (rows - starts[file_of]).astype(np.uint64)
    mine = fps[rows]
    vertical = np.zeros((len(bits), len(starts)), dtype=np.uint64)
    queries = np.zeros((len(bits), len(rows)), dtype=np.uint64)
    for p, bit in enumerate(bits):
        on = (mine >> np.uint64(bit)) & np.uint64(1)
        vertical[p] = np.bitwise_or.reduceat(on << lane, starts_in := np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        queries[p] = np.uint64(0) - on
    hit = near(vertical[:, file_of], queries)
    bit_rows, lanes = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    ok = (lanes < sizes[file_of[bit_rows]]) & (lanes < lane[bit_rows].astype(np.int64))
    bit_rows, lanes = bit_rows[ok], lanes[ok]
    root = _forest(len(rows), bit_rows, starts_in[file_of[bit_rows]] + lanes)
    child = np.flatnonzero(root != np.arange(len(rows)))
    return mine[child], mine[root[child]]


def _large(fps: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links in one file of over 64 members, some queries at a time."""
    vertical = planes(fps, bits)[:, None, :]
    root = np.arange(len(fps))
    step = max(1, (1 << 22) // max(1, vertical.shape[2] * 64))
    for at in range(0, len(fps), step):
        queries = np.stack([(np.uint64(0) - ((fps[at : at + step] >> np.uint64(b)) & np.uint64(1)))[:, None] for b in bits])
        hits = np.unpackbits(near(vertical, queries).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
        for i in range(len(hits)):
            met = np.unique(root[np.flatnonzero(hits[i])])
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def links_of_files(kinds: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of all files in rows sorted by kind and key; fingerprints within a file are distinct."""
    left, right = [], []
    edge = np.flatnonzero((kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1])) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    for kind in np.unique(kinds[starts[sizes > 1]]):
        here = (kinds[starts] == kind) & (sizes > 1)
        some = here & (sizes <= 64)
        if some.any():
            a, b = _small(fps, starts[some], sizes[some], FREE[kind])
            left.append(a)
            right.append(b)
        for s, n in zip(starts[here & (sizes > 64)], sizes[here & (sizes > 64)], strict=True):
            a, b = _large(fps[s : s + n], FREE[kind])
            left.append(a)
            right.append(b)
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition, batch by batch; the last file of a batch waits for the next one."""
    held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64)]

    def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(rows[0]) > 1:
            a, b = links_of_files(*rows)
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        rows = [np.concatenate([h, r.view(h.dtype) if r.dtype.itemsize == 8 else r.astype(h.dtype)]) for h, r in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [r[cut:] for r in rows]
        yield from emit([r[:cut] for r in rows])
    yield from emit(held)


def near_links(spark: SparkSession, distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links at RADIUS or less between the distinct fingerprints fp."""
    masks = [~sum(1 << b for b in bits) & (2**64 - 1) for bits in FREE]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    files = F.array(*[F.struct(F.lit(i).cast("long").alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    filed = distinct.select("fp", F.explode(files).alias("file")).select("file.kind", "file.key", "fp")
    n = shuffle_partitions(spark)
    return filed.repartition(n, "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_compare, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, fp and component_id."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(fingerprints(docs), "fingerprints")
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "distinct")
    roots = connected_components(near_links(spark, distinct.select("fp")), scratch)
    linked = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    groups = scratch.save(linked.select("fp", "least", "size", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = scratch.save(groups.groupBy("root").agg(F.min("least").alias("component_id")), "firsts")
    groups = scratch.save(groups.join(firsts, "root").select("fp", "size", "component_id"), "groups")
    return lookup(rows, groups, "fp", "size", rows.count()).select("doc_id", "fp", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one that gives the component its id.

    Documents without doc_id all stay, as nothing tells them apart; of rows that repeat a doc_id one stays.
    """
    scratch = Scratch(spark, "simhash-keep")
    found = near_duplicates(spark, docs)
    keep = scratch.save(found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct(), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.where("doc_id IS NOT NULL").select(row.alias("row"), F.col("doc_id").cast("long").alias("__id"))
    stay = marked.join(keep.hint("shuffle_hash"), "__id", "left_semi")
    one = F.row_number().over(Window.partitionBy("__id").orderBy("__id"))
    return stay.withColumn("place", one).where("place = 1").select("row.*").unionByName(docs.where("doc_id IS NULL"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
