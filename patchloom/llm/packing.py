"""Operator 1, sequence packing: vector bin packing with a dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens). A sequence starts with full remaining capacity in all three
dimensions; it repeatedly takes the example that fits and whose dot product with the remaining capacity is largest, each
dimension scaled by its limit. When none fits, one is cut where the tightest limit allows. A sequence that a limit closes
early is shortened to a power of two, so no sequence needs padding.

Examples are packed where they are read, in a stream with a bounded window, so packing adds no shuffle and no task sees
more than its share of the input.

Defined cases: a null or empty text is the end mark alone; an example longer than a sequence fills sequences of its own and
its rest is packed; repeated rows are packed as often as they occur; an empty table gives an empty result; a null doc_id
is kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .tokens import WordCachedTokenizer

SEQUENCE = 2048
MAX_SEGMENTS = 256
END_ID = 1
#: Examples that wait for a place at most, per task.
WINDOW = 512

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("loss_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class Example:
    """The part of a document that is still to be placed: ids[start:], and the running count of its loss-bearing ids."""

    __slots__ = ("doc_id", "ids", "loss", "start")

    def __init__(self, doc_id: int | None, ids: np.ndarray, loss: np.ndarray | None) -> None:
        self.doc_id, self.ids, self.start = doc_id, ids, 0
        self.loss = None if loss is None else np.concatenate([[0], np.cumsum(loss, dtype=np.int64)])

    def left(self) -> int:
        return len(self.ids) - self.start

    def loss_of(self, n: int) -> int:
        """Loss-bearing ids among the next n."""
        return n if self.loss is None else int(self.loss[self.start + n] - self.loss[self.start])

    def longest(self, tokens: int, loss: int) -> int:
        """Ids that may be taken next under both limits."""
        n = min(tokens, self.left())
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1 - self.start)


class Packer:
    """Places examples into sequences; done(pieces) gets each finished one as a list of (example, start, length)."""

    def __init__(self, done: Callable[[list], None], tokens: int = SEQUENCE, segments: int = MAX_SEGMENTS, loss: int = SEQUENCE, window: int = WINDOW) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.done, self.limits, self.window = done, (tokens, segments, loss), window
        self.pool: list[Example] = []
        self.sizes = np.zeros((0, 2))

    def add(self, example: Example) -> None:
        tokens, _, loss = self.limits
        while example.left() >= tokens and example.loss_of(tokens) <= loss:
            self.done([(example, example.start, tokens)])
            example.start += tokens
        if example.left():
            self.pool.append(example)
        if len(self.pool) >= 2 * self.window:
            self._drain(self.window)

    def finish(self) -> None:
        self._drain(0)

    def _drain(self, keep: int) -> None:
        tokens, _, loss = self.limits
        self.sizes = np.array([(x.left(), x.loss_of(x.left())) for x in self.pool], dtype=np.float64).reshape(-1, 2)
        while len(self.pool) > keep:
            self._sequence()

    def _remove(self, i: int) -> None:
        self.pool[i] = self.pool[-1]
        self.sizes[i] = self.sizes[len(self.pool) - 1]
        self.pool.pop()

    def _sequence(self) -> None:
        tokens, segments, loss = self.limits
        room, slots, room_loss, pieces = tokens, segments, loss, []
        while room and slots and room_loss and self.pool:
            sizes = self.sizes[: len(self.pool)]
            fit = (sizes[:, 0] <= room) & (sizes[:, 1] <= room_loss)
            # the dot product of each example with what is left; its one segment adds the same to all of them
            dot = sizes[:, 0] * (room / tokens**2) + sizes[:, 1] * (room_loss / loss**2) + slots / segments**2
            if slots > 1 and fit.any():
                i = int(np.argmax(np.where(fit, dot, -1.0)))
            else:
                i = int(np.argmax(dot))
            example = self.pool[i]
            n = example.longest(room, room_loss)
            if not n:
                break
            pieces.append((example, example.start, n))
            room, slots, room_loss = room - n, slots - 1, room_loss - example.loss_of(n)
            example.start += n
            if example.left():
                self.sizes[i] = (example.left(), example.loss_of(example.left()))
            else:
                self._remove(i)
        used = tokens - room
        surplus = used - (1 << (used.bit_length() - 1)) if room else 0
        while surplus:
            example, start, n = pieces.pop()
            back = min(n, surplus)
            surplus -= back
            if back < n:
                pieces.append((example, start, n - back))
            self._give_back(example, start + n - back)
        self.done(pieces)

    def _give_back(self, example: Example, start: int) -> None:
        waiting = example.left() > 0
        example.start = min(start, example.start)
        size = (example.left(), example.loss_of(example.left()))
        if waiting:
            self.sizes[next(i for i, x in enumerate(self.pool) if x is example)] = size
            return
        if len(self.pool) == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros((max(8, len(self.sizes)), 2))])
        self.sizes[len(self.pool)] = size
        self.pool.append(example)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    tokens: int = SEQUENCE,
    segments: int = MAX_SEGMENTS,
    loss: int = SEQUENCE,
    loss_column: str | None = None,
) -> DataFrame:
    """Pieces of the documents (doc_id, text) with their place and their ids (little-endian unsigned 32-bit integers).

    Every id bears loss unless loss_column names a boolean column; then the ids of rows where it is not true bear none.
    tokenizer is the path of a tokenizers file.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = WordCachedTokenizer.shared(tokenizer)
        out: list[list] = [[] for _ in _ARROW]
        serial = TaskContext.get().partitionId() << 40

        def done(pieces: list) -> None:
            nonlocal serial
            offset = 0
            for x, start, n in pieces:
                bearing = n if x.loss is None else int(x.loss[start + n] - x.loss[start])
                for column, value in zip(out, (x.doc_id, start, n, x.ids[start : start + n].tobytes(), len(x.ids), bearing, serial, offset), strict=True):
                    column.append(value)
                offset += n
            serial += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
            for column in out:
                column.clear()
            return batch

        packer = Packer(done, tokens, segments, loss)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("doc_id").to_pylist()
                bears = part.column(loss_column).to_pylist() if loss_column else [True] * len(ids)
                for doc_id, found, bear in zip(ids, tok.encode(part.column("text").to_pylist()), bears, strict=True):
                    found = np.concatenate([np.frombuffer(found, dtype="<u4"), end])
                    packer.add(Example(doc_id, found, None if bear else np.zeros(len(found), dtype=np.int8)))
                if len(out[0]) >= 2048:
                    yield flush()
        packer.finish()
        yield flush()

    bound_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    columns += [F.col(loss_column).cast("boolean").alias(loss_column)] if loss_column else []
    return docs.select(*columns).mapInArrow(task, PIECES)


def packed_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack(table(spark, sf_dir, "documents")))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations under three limits that all bind: 2048 tokens, 16 segments, 1024 loss-bearing tokens.

    Only what an assistant says bears loss. A row per piece; loss_tokens are its ids that bear loss.
    """
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select((F.col("conv_id") * 1024 + F.col("turn")).alias("doc_id"), "text", (F.col("role") == "assistant").alias("bears"))
    pieces = pack(rows, segments=16, loss=1024, loss_column="bears")
    return pieces.select("doc_id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset")
