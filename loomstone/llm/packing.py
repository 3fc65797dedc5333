"""Packing: harmonic classes of reciprocal capacity, each bin filled with a fixed count of documents.

A text of n tokens is of class k if capacity / (k + 1) < n <= capacity / k, and a bin of class k takes
k texts of it, whole and in a row. Only what exceeds the capacity is cut: full sequences, and a rest
that is a text of its own. Workers pack apart, each the texts of its partition, in one pass and with
one open bin for each class, of which there are 2 * sqrt(capacity) at most.

The room that k texts leave in their bin is not padded. When the rooms that wait hold a whole large
text between them, it is cut to fill them, oldest first: about one cut for each bin, and none for
other texts. At the end of a partition the texts of the open bins, and of the newest sequences with
room, fill the rooms that are left and then sequences in a row; the last one is split at its powers
of two. So no sequence needs padding.

A sequence is numbered in its partition; a table of one count for each partition makes that a number
of the whole.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomstone.llm import shared, textkit

CAPACITY = 4096
END_ID = 2
#: Texts of a class up to this are cut to fill rooms that hold them; those of others only if so many rooms wait.
FILLERS, ROOMS = 3, 64
_KEPT_CHUNKS = 1_500_000
_opened: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer:
    """Ids of a text, by way of its chunks between ASCII white space.

    The tokenizer turns white space into breaks and cuts no token across it, so a text's ids are those
    of its chunks in a row. A chunk is tokenized when first seen and found by its 64-bit hash after
    that; when 1.5 million are kept, the worker starts anew.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.slots = textkit.Slots(_KEPT_CHUNKS)
        self.clear()

    @classmethod
    def opened(cls, path: str) -> ChunkTokenizer:
        """One for each worker process, for all its tasks."""
        if path not in _opened:
            _opened[path] = cls(path)
        return _opened[path]

    def clear(self) -> None:
        self.slots.clear()
        self.starts = np.zeros(1024, np.int64)
        self.pool = np.empty(4096, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    def _learn(self, chunks: list[bytes], hashed: np.ndarray) -> None:
        slots = self.slots.add(hashed)
        lengths = []
        for k in range(0, len(chunks), 8192):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks[k : k + 8192]], add_special_tokens=False)]
            lengths += map(len, ids)
            flat = [i for x in ids for i in x]
            while self.used + len(flat) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        if not lengths:
            return
        while slots[-1] + 2 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        self.starts[slots + 1] = self.starts[slots[0]] + np.cumsum(lengths)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        data, offsets = textkit.utf8(column)
        starts, ends, counts = textkit.runs(data, offsets, textkit.NOT_WHITE)
        hashed = textkit.hashes(data, starts, ends)
        slot = self.slots.find(hashed)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh = new[textkit.first_of_each(hashed[new])]
            if self.slots.full(len(fresh)):
                self.clear()
                new, fresh = np.arange(len(hashed)), textkit.first_of_each(hashed)
            self._learn(textkit.span_bytes(data, starts[fresh], ends[fresh]), hashed[fresh])
            slot[new] = self.slots.find(hashed[new])
        begins = self.starts[slot]
        lengths = self.starts[slot + 1] - begins
        ids = self.pool[textkit.spread(begins, lengths)].astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


class Text(NamedTuple):
    """A document's tokens from `base` on, as little-endian 32-bit ids."""

    doc: object
    size: int
    base: int
    ids: bytes

    def after(self, start: int) -> Text:
        return Text(self.doc, self.size, start, bytes(self.ids[4 * (start - self.base) :]))

    def crc(self, start: int, length: int) -> int:
        return zlib.crc32(self.ids[4 * (start - self.base) : 4 * (start - self.base + length)])


class Piece(NamedTuple):
    text: Text
    start: int
    length: int
    sequence: int
    offset: int


class Packer:
    """The bins of one partition. `pieces` are those of sequences that are done.

    Sequences with room are held: as many as ROOMS, or as it takes until their rooms hold a text.
    """

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.pieces: list[Piece] = []
        self.held: dict[int, list[Piece]] = {}
        self.open: dict[int, list[tuple[Text, int, int]]] = {}
        #: (sequence, offset, tokens) of the rooms that wait, and what they amount to.
        self.rooms: deque[tuple[int, int, int]] = deque()
        self.room = 0
        self._next = 0
        self._free: list[int] = []

    def put(self, text: Text) -> None:
        start, length = text.base, text.size
        while length - start >= self.capacity:
            self._row([(text, start, self.capacity)])
            start += self.capacity
        rest = length - start
        if not rest:
            return
        if start > text.base:
            text = text.after(start)
        kind = self.capacity // rest
        if rest <= self.room and (kind <= FILLERS or len(self.rooms) >= ROOMS):
            self._fill(text, start, rest)
            return
        members = self.open.setdefault(kind, [])
        members.append((text, start, rest))
        if len(members) == kind:
            self._row(self.open.pop(kind))

    def _row(self, members: list[tuple[Text, int, int]]) -> None:
        """A new sequence of texts in a row; what is left of it waits as a room."""
        if self._free:
            sequence = self._free.pop()
        else:
            sequence = self._next
            self._next += 1
        row, at = [], 0
        for text, start, length in members:
            row.append(Piece(text, start, length, sequence, at))
            at += length
        if at < self.capacity:
            self.held[sequence] = row
            self.rooms.append((sequence, at, self.capacity - at))
            self.room += self.capacity - at
        else:
            self.pieces += row

    def _fill(self, text: Text, start: int, length: int) -> None:
        while length:
            sequence, at, room = self.rooms.popleft()
            used = min(room, length)
            self.held[sequence].append(Piece(text, start, used, sequence, at))
            if used < room:
                self.rooms.appendleft((sequence, at + used, room - used))
            else:
                self.pieces += self.held.pop(sequence)
            self.room -= used
            start, length = start + used, length - used

    def close(self) -> None:
        """Place the texts of the open bins, and those of the newest sequences with room, in the rooms; one sequence isn't full in the end."""
        waiting = deque(member for kind in sorted(self.open) for member in self.open[kind])
        self.open.clear()
        while waiting or len(self.rooms) > 1:
            while waiting and self.room:
                text, start, length = waiting.popleft()
                used = min(length, self.room)
                self._fill(text, start, used)
                if used < length:
                    waiting.appendleft((text, start + used, length - used))
            if waiting:
                row, left = [], self.capacity
                while waiting and left:
                    text, start, length = waiting.popleft()
                    used = min(length, left)
                    row.append((text, start, used))
                    left -= used
                    if used < length:
                        waiting.appendleft((text, start + used, length - used))
                self._row(row)
            elif len(self.rooms) > 1:
                sequence, _, room = self.rooms.pop()
                self.room -= room
                self._free.append(sequence)
                waiting.extend(p[:3] for p in self.held.pop(sequence))
        if self.rooms:
            sequence, size, _ = self.rooms.pop()
            self.room = 0
            self._split(self.held.pop(sequence), sequence, size)

    def _split(self, row: list[Piece], sequence: int, size: int) -> None:
        """Sequences of the binary digits of what one holds."""
        left, at = 1 << (size.bit_length() - 1), 0
        for text, start, length, _, _ in row:
            while length:
                used = min(length, left - at)
                self.pieces.append(Piece(text, start, used, sequence, at))
                start, length, size, at = start + used, length - used, size - used, at + used
                if at == left and size:
                    sequence, left, at = self._next, 1 << (size.bit_length() - 1), 0
                    self._next += 1


def pack(spark: SparkSession, documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone, so every row of documents has a piece; repeated rows
    are documents of their own. An empty table gives no piece. Sequences hold `capacity` tokens, or a
    power of two: nothing is padded.
    """
    shared.ship(spark)
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = ChunkTokenizer.opened(path), TaskContext.get().partitionId()
        packer = Packer(capacity)

        def placed() -> pa.RecordBatch:
            rows = [(p.text.doc, p.start, p.length, p.text.crc(p.start, p.length), p.text.size, p.sequence, p.offset, part) for p in packer.pieces]
            packer.pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

        for batch in textkit.slices(batches, "text", 1 << 20):
            ids, lengths = tokens.encode(batch.column("text"))
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist()):
                packer.put(Text(doc, n + 1, 0, np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4").tobytes()))
                at += n
            yield placed()
        packer.close()
        yield placed()

    texts = shared.only(documents, "doc_id", "text")
    kind = texts.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__local", "offset", "__part"]
    kinds = [to_arrow_type(kind), *[pa.int64()] * 6, pa.int32()]
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, __local long, offset long, __part int"
    cuts = shared.written(spark, texts.mapInArrow(pieces, schema), "pieces")
    # One row for each partition, so the window and the broadcast are of the size of a task list.
    counts = cuts.groupBy("__part").agg((F.max("__local") + 1).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return cuts.join(F.broadcast(base), "__part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("__before") + F.col("__local")).alias("sequence_id"), "offset")
