"""Operator 9, removal of repeated substrings by a hash-compared suffix sort.

A string of LENGTH bytes is owned by an anchor: the K bytes in it with the smallest hash, the first of equals. Equal strings
have equal anchors at equal offsets, so texts are cut into pieces, one for each run of strings with the same anchor, and
only pieces with equal anchors are ever compared:

1. Equal pieces are counted by digest. All strings of a piece that occurs twice are repeated; a piece whose anchor occurs
   nowhere else has none. On real text this settles nearly everything, and copies of a document cost as much as one.
2. The rest, pieces at the ends of repeated passages, are brought together by anchor with their bytes. The suffixes at
   the anchors are sorted by a merge sort that compares by prefix hashes and binary search; from each suffix a walk over its
   neighbours, in both directions, meets common extensions in falling order, and the backward extension at each tells which
   strings of the two are equal. What a hash says is verified on the bytes.
3. An anchor with more than GROUP different pieces (a very common passage) is split first: its pieces are cut at fixed
   offsets into halves, whose key is the hash of the bytes that all strings of the half share, and step 1 runs again on those. At
   single strings, step 1 decides alone, so no group is ever too large and nothing is capped.

Defined cases: a null or empty text has no bytes and keeps the digest of nothing; texts under LENGTH bytes stay whole; equal
texts are handled once and repeated rows all lose what occurs twice; a null doc_id is kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup, shuffle_partitions, table
from .suffix_sort import BASES, Collision, PrefixHash, extension, mixed, sort_suffixes

LENGTH = 400
K = 100
#: Words of the shortest passage that n_shared always tells of, and of the longest that it never does.
PASSAGE, GRAM = 51, 40
#: Different pieces of one anchor that are compared in one place at most.
GROUP = 256
#: Bytes that are hashed together at most; positions in a block take 24 bits.
_BLOCK = 1 << 19
_POSITION = np.uint64((1 << 24) - 1)

_RECORD = "d1 long, d2 long, mult long, kh long, c1 long, c2 long, lo long, nwin int, aoff int"
_PIECE = "d1 long, d2 long, kh long, m long, lo long, nwin int, aoff int, data binary"
_SPLIT = "kh long, c1 long, c2 long, m long, d1 long, d2 long, lo long, nwin int, aoff int, data binary"
_SPANS = "d1 long, d2 long, lo long, nwin int"


def _digest(data: bytes) -> tuple[int, int]:
    return _two_longs(hashlib.sha256(data).digest())


def _two_longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a block of texts laid end to end (ends: where each text ends): first string, strings, anchor place, anchor hash."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h = PrefixHash(data)
    grams = mixed(h(np.arange(len(data) - k + 1), k))
    # the place breaks ties, so the first of equal grams wins in every string
    place = sliding_minimum((grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64), length - k + 1) & _POSITION
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    has = ends - starts >= length
    np.add.at(inside, starts[has], 1)
    np.add.at(inside, ends[has] - length + 1, -1)
    valid = np.cumsum(inside)[: len(place)] > 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    text_start = np.zeros(len(data) + 1, dtype=bool)
    text_start[starts] = True
    opens |= valid & text_start[: len(place)]
    lo = np.flatnonzero(opens)
    piece = np.cumsum(opens) - 1
    nwin = np.bincount(piece[valid], minlength=len(lo)) if len(lo) else none
    anchor = place[lo].astype(np.int64)
    return lo, nwin.astype(np.int64), anchor, grams[anchor]


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to _BLOCK bytes; a longer text is a run of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BLOCK, "right")) - 1)
        yield a, b
        a = b


def _records(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece of each text. A text longer than a block is met in overlapping parts."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        d1, d2, mult = (batch.column(c).to_numpy() for c in ("d1", "d2", "mult"))
        for a, b in _blocks(offsets):
            start, end = int(offsets[a]), int(offsets[b])
            for at in range(start, max(start + 1, end - (length - 1 if b == a + 1 else 0)), _BLOCK):
                stop = min(end, at + _BLOCK + length - 1) if b == a + 1 else end
                part = data[at:stop]
                ends = offsets[a + 1 : b + 1] - at if b > a + 1 else np.array([stop - at])
                lo, nwin, anchor, kh = anchors(part, ends, length, k)
                raw = part.tobytes()
                classes = [_digest(raw[i : i + n + length - 1]) for i, n in zip(lo.tolist(), nwin.tolist(), strict=True)]
                c1, c2 = (np.array([c[i] for c in classes], dtype=np.int64) for i in (0, 1))
                text = a + np.searchsorted(ends, lo, "right")
                columns = [d1[text], d2[text], mult[text], kh.view(np.int64), c1, c2, lo + at - offsets[text], nwin.astype(np.int32), (anchor - lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["d1", "d2", "mult", "kh", "c1", "c2", "lo", "nwin", "aoff"])
                if b > a + 1:
                    break


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    """Rows as dictionaries, few at a time."""
    for batch in batches:
        part = batch.select(names)
        for at in range(0, part.num_rows, 128):
            yield from part.slice(at, 128).to_pylist()


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that each text is asked for."""
    for row in _rows(batches, ["d1", "d2", "text", "pieces"]):
        data = row["text"].encode()
        out = [(row["d1"], row["d2"], p["kh"], p["m"], p["lo"], p["nwin"], p["aoff"], data[p["lo"] : p["lo"] + p["nwin"] + length - 1]) for p in row["pieces"]]
        names = ["d1", "d2", "kh", "m", "lo", "nwin", "aoff", "data"]
        types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _split(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces cut where the anchor's offset passes a multiple of width; keyed by what all strings of such a stretch share."""
    import xxhash

    names = ["kh", "c1", "c2", "m", "d1", "d2", "lo", "nwin", "aoff", "data"]
    types = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()]
    for batch in batches:
        out = []
        for r in _rows([batch], batch.schema.names):
            data, top = r["data"], r["aoff"]
            o = top
            while o > top - r["nwin"]:
                bottom = max(top - r["nwin"] + 1, o // width * width)
                skip, n = top - o, o - bottom + 1
                hull = data[skip : skip + n + length - 1]
                block = o // width * width
                shared = data[top - block : max(top - block, top - block - width + 1 + length)]
                key = xxhash.xxh3_64_intdigest(shared, seed=(r["kh"] ^ block) & (2**64 - 1))
                c1, c2 = _digest(key.to_bytes(8, "little") + hull)
                out.append((key - 2**64 if key >= 2**63 else key, c1 ^ o, c2, r["m"], r["d1"], r["d2"], r["lo"] + skip, n, o, hull))
                o = bottom - 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def repeated_strings(group: np.ndarray, single: np.ndarray, aoff: np.ndarray, nwin: np.ndarray, pieces: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(piece, first string, strings) of the repeated strings of single pieces; pieces of a group share their anchor."""
    for base in BASES:
        try:
            return _repeated_strings(group, single, aoff, nwin, pieces, length, base)
        except Collision:
            continue
    raise Collision("every base collides")


def _repeated_strings(group: np.ndarray, single: np.ndarray, aoff: np.ndarray, nwin: np.ndarray, pieces: list[bytes], length: int, base: int) -> list[tuple[int, int, int]]:
    n = len(pieces)
    raw = b"".join(pieces)
    data = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    anchor, right = begin + aoff, sizes - aoff
    h = PrefixHash(data, base)
    order = sort_suffixes(data, h, group, anchor, right)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    same = np.concatenate([group[order][1:] == group[order][:-1], [False]])
    following = np.zeros(n, dtype=np.int64)  # common extension of each suffix with the next one in order
    if n > 1:
        x, y = order[:-1], order[1:]
        following[:-1] = np.where(same[:-1], extension(h, anchor[x], anchor[y], np.minimum(right[x], right[y])), 0)
        # equal bytes up to the extension, and a hash that differs one byte on, prove the order and the extension
        for p, q, shared in zip(anchor[x].tolist(), anchor[y].tolist(), following[:-1].tolist(), strict=True):
            if raw[p : p + shared] != raw[q : q + shared]:
                raise Collision
    found: list[tuple[int, int, int]] = []
    covered = [np.zeros(k, dtype=bool) if s else None for k, s in zip(nwin.tolist(), single.tolist(), strict=True)]
    for step in (1, -1):
        live = np.flatnonzero(single)
        place, reach = rank[live], np.minimum(right[live], length)
        while live.size:
            nxt = place + step
            ok = (nxt >= 0) & (nxt < n)
            live, place, nxt, reach = live[ok], place[ok], nxt[ok], reach[ok]
            reach = np.minimum(reach, following[np.minimum(place, nxt)])
            other = order[nxt]
            # a string needs length bytes: reach to the right of the anchor, the rest to its left
            ok = (group[other] == group[live]) & (reach + aoff[live] >= length)
            live, nxt, reach, other = live[ok], nxt[ok], reach[ok], other[ok]
            if not live.size:
                break
            left = extension(h, anchor[live], anchor[other], np.minimum(aoff[live], aoff[other]), backwards=True)
            hit = np.flatnonzero(left + reach >= length)
            for i in hit.tolist():
                x, y, lo_o, hi_o = int(live[i]), int(other[i]), max(length - int(reach[i]), int(aoff[live[i]] - nwin[live[i]] + 1)), int(left[i])
                if hi_o < lo_o:
                    continue
                a, b = int(aoff[x]) - hi_o, int(aoff[x]) - lo_o
                if covered[x][a : b + 1].all():
                    continue
                ax, ay, size = int(anchor[x]) - hi_o, int(anchor[y]) - hi_o, hi_o - lo_o + length
                if raw[ax : ax + size] != raw[ay : ay + size]:
                    raise Collision
                covered[x][a : b + 1] = True
            place = nxt
            full = np.array([covered[x].all() for x in live.tolist()])
            live, place, reach = live[~full], place[~full], reach[~full]
    for x, c in enumerate(covered):
        if c is not None and c.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
            found += [(x, int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return found


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of a partition sorted by anchor; the last group of a batch waits for the next batch."""
    held: pa.Table | None = None

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = t.column("kh").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < len(keys):  # some groups at a time: hashes take many times the bytes
            stop = int(starts[max(np.searchsorted(starts, at, "right"), np.searchsorted(starts, at + GROUP, "right") - 1)])
            yield spans(t.slice(at, stop - at))
            at = stop

    def spans(t: pa.Table) -> pa.RecordBatch:
        kh, m, aoff, nwin, lo, d1, d2 = (t.column(c).to_numpy().astype(np.int64) for c in ("kh", "m", "aoff", "nwin", "lo", "d1", "d2"))
        found = repeated_strings(kh, m == 1, aoff, nwin, t.column("data").to_pylist(), length)
        x, a, n = (np.array([f[i] for f in found], dtype=np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(d1[x]), pa.array(d2[x]), pa.array(lo[x] + a), pa.array(n.astype(np.int32))], names=["d1", "d2", "lo", "nwin"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        keys = t.column("kh").to_numpy()
        other = np.flatnonzero(keys != keys[-1]) if len(keys) else np.zeros(0)
        cut = int(other[-1]) + 1 if len(other) else 0
        held = t.slice(cut)
        yield from emit(t.slice(0, cut))
    if held is not None:
        yield from emit(held)


def _clean(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    names = ["d1", "d2", "mult", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64()] * 6 + [pa.string()]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for row in _rows(batches, ["d1", "d2", "mult", "text", "spans"]):
        data = row["text"].encode()
        kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
        for lo, hi in sorted((s["lo"], s["lo"] + s["nwin"] + length - 1) for s in row["spans"] or ()):
            if lo > at or not runs:
                kept.update(data[at:lo])
                runs += 1
                at = lo
            if hi > at:
                removed += hi - at
                at = hi
        kept.update(data[at:])
        out.append((row["d1"], row["d2"], row["mult"], len(data), removed, runs, kept.hexdigest()))
        if len(out) == 4096:
            yield flush()
            out.clear()
    yield flush()


def _settle(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(spans of single records whose piece occurs twice, classes that are still open with their group size).

    records: rid, kh, c1, c2, m. A class is a set of equal pieces; it is open while it is single and its key has other
    classes, and a class that is not single stays as a partner of those.
    """
    classes = scratch.save(records.groupBy("c1", "c2").agg(F.min("kh").alias("kh"), F.sum("m").alias("m"), F.min("rid").alias("rid")), "classes")
    groups = classes.groupBy("kh").agg(F.count("*").alias("n"), F.count_if(F.col("m") == 1).alias("singles")).where("n > 1 AND singles > 0")
    repeated = records.join(classes.where("m > 1").select("c1", "c2"), ["c1", "c2"]).select("d1", "d2", "lo", "nwin")
    still = classes.select("kh", "rid", "m").join(scratch.save(groups.select("kh", "n"), "groups"), "kh")
    return scratch.save(repeated.distinct(), "repeated"), scratch.save(still, "open")


def _word_anchors(batches: Iterator[pa.RecordBatch], passage: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of the passages of each text, as two hashes of their words."""
    import xxhash

    known: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [x.encode().split() for x in part.column("text").to_pylist()]
            if len(known) > 200_000:
                known.clear()
            for w in set().union(*texts) - known.keys():
                known[w] = xxhash.xxh3_64_intdigest(w)
            ends = np.cumsum([len(x) for x in texts])
            words = np.fromiter((known[w] for x in texts for w in x), dtype=np.uint64, count=int(ends[-1]))
            rows, g1, g2 = [], [], []
            for a, b in _blocks(np.concatenate([[0], ends])):
                start, end = int(ends[a - 1]) if a else 0, int(ends[b - 1])
                for lower in range(start, max(start + 1, end - (passage - 1 if b == a + 1 else 0)), _BLOCK):
                    stop = min(end, lower + _BLOCK + passage - 1) if b == a + 1 else end
                    data = words[lower:stop]
                    bounds = ends[a:b] - lower if b > a + 1 else np.array([stop - lower])
                    lo, _, anchor, kh = anchors(data, bounds, passage, gram)
                    rows.append(a + np.searchsorted(bounds, lo, "right"))
                    g1.append(kh)
                    g2.append(PrefixHash(data, BASES[1])(anchor, gram) if len(lo) else kh)
                    if b > a + 1:
                        break
            found = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(g1), np.concatenate(g2)]), axis=1)
            text = found[0].astype(np.int64)
            columns = [part.column(c).to_numpy()[text] for c in ("d1", "d2", "mult")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, found[1].view(np.int64), found[2].view(np.int64))], names=["d1", "d2", "mult", "g1", "g2"])


def shared_passages(spark: SparkSession, texts: DataFrame, scratch: Scratch, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """d1, d2, n_shared of the distinct texts (d1, d2, mult, text) that have anchors of another document."""
    found = texts.mapInArrow(lambda b: _word_anchors(b, passage, gram), "d1 long, d2 long, mult long, g1 long, g2 long")
    found = scratch.save(found, "anchors")
    shared = found.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.sum("mult").alias("documents")).where("documents > 1")
    shared = scratch.save(shared, "shared")
    hits = lookup(found.drop("mult"), shared.drop("documents"), ["g1", "g2"], "n", found.count()).where(F.col("n").isNotNull())
    counts = scratch.save(hits.groupBy("d1", "d2").agg(F.count("*").alias("n_shared")), "shared-by-text")
    scratch.drop(found, shared)
    return counts


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared."""
    scratch = Scratch(spark, "substring-dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = lambda i: F.conv(F.substring(F.sha2(text, 256), i, 16), 16, -10).cast("long")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), half(1).alias("d1"), half(17).alias("d2"), text.alias("text"))
    n = shuffle_partitions(spark)
    # distinct texts, bucketed by digest: this is the only time that texts are shuffled
    name = f"texts_{uuid.uuid4().hex}"
    texts = marked.groupBy("d1", "d2").agg(F.first("text").alias("text"), F.count("*").alias("mult"))
    texts.write.format("parquet").bucketBy(n, "d1", "d2").saveAsTable(name)
    texts = spark.table(name)
    rows = scratch.save(marked.select("doc_id", "d1", "d2"), "rows")
    shared = shared_passages(spark, texts, scratch)
    scratch.release()

    records = texts.mapInArrow(lambda b: _records(b, length, k), _RECORD)
    records = scratch.save(records.withColumn("rid", F.monotonically_increasing_id()).withColumnRenamed("mult", "m"), "records")
    spans, still = _settle(records, scratch)
    found = [spans]
    asked = still.withColumnRenamed("m", "total").join(records.drop("kh", "m", "c1", "c2"), "rid")
    asked = asked.groupBy("d1", "d2").agg(F.collect_list(F.struct("kh", F.col("total").alias("m"), "lo", "nwin", "aoff")).alias("pieces"))
    pieces = texts.join(asked.hint("shuffle_hash"), ["d1", "d2"]).select("d1", "d2", "text", "pieces").mapInArrow(lambda b: _cut_out(b, length), _PIECE)
    sized = still.select("kh", "n").distinct()
    pieces = scratch.save(pieces.join(sized, "kh"), "pieces")
    scratch.release()

    # offsets of an anchor take length - k + 1 values; the first cut is at half of them or more
    ready, width = [pieces.where(F.col("n") <= group).drop("n")], 1 << max(0, (length - k).bit_length() - 1)
    large = pieces.where(F.col("n") > group)
    while not large.isEmpty():
        w = width
        parts = large.drop("n", "rid").mapInArrow(lambda b, w=w: _split(b, w, length), _SPLIT)
        parts = scratch.save(parts.withColumn("rid", F.monotonically_increasing_id()), f"split-{w}")
        spans, still = _settle(parts, scratch)
        found.append(spans)
        kept = scratch.save(still.withColumnRenamed("m", "total").join(parts.drop("kh", "m"), "rid"), "parts")
        kept = kept.select("d1", "d2", "kh", F.col("total").alias("m"), "lo", "nwin", "aoff", "data", "n")
        ready.append(kept.where(F.col("n") <= group).drop("n"))
        large, width = kept.where(F.col("n") > group), max(1, width // 2)

    for part in ready:
        sorted_part = part.repartition(n, "kh").sortWithinPartitions("kh")
        found.append(sorted_part.mapInArrow(lambda b: _compare(b, length), _SPANS))
    spans = found[0]
    for other in found[1:]:
        spans = spans.unionByName(other)
    by_text = scratch.save(spans.distinct().groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "nwin")).alias("spans")), "spans")
    cleaned = texts.join(by_text.hint("shuffle_hash"), ["d1", "d2"], "left").select("d1", "d2", "mult", "text", "spans")
    schema = "d1 long, d2 long, mult long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cleaned = cleaned.mapInArrow(lambda b: _clean(b, length), schema).join(shared, ["d1", "d2"], "left")
    cleaned = scratch.save(cleaned.withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long"))), "cleaned")
    spark.sql(f"DROP TABLE {name}")
    scratch.release()
    return lookup(rows, cleaned, ["d1", "d2"], "mult", rows.count()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
