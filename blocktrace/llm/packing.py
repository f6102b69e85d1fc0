"""Sum-of-squares online packing of token ids into training sequences.

A document becomes its ids and one closing id. Full windows are cut off its
front; what is left is an item for the packer. Each partition of documents
has a packer of its own, so nothing is shuffled: it keeps the open windows and
a level array, the number of open windows at each fill level, and puts an item
where the sum of the squared counts grows least. Mixed fill levels leave a
partner for nearly every item.

When the documents of a partition end (or too many windows are open), the open
windows are closed: the emptiest ones are cut to fill the fullest ones, and
the last ids go to sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from blocktrace.llm.common import bounded, slices
from blocktrace.llm.vocabularies import default_path, json_vocabulary

#: Open windows that a packer keeps; beyond it they are closed early. Bounds its memory to 4 * capacity bytes each.
OPEN_WINDOWS = 8192
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")
ARROW = pa.schema([pa.field(part.split()[0], pa.int64()) for part in SCHEMA.split(", ")])


class Packer:
    """Windows of one partition. A piece is (doc_id, start, ids as bytes, tokens of its document)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity = capacity
        self.next_id = first_id
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def document(self, doc_id: int | None, ids: bytes) -> None:
        tokens, step = len(ids) // 4, 4 * self.capacity
        full = tokens // self.capacity
        for k in range(full):
            self._emit([(doc_id, k * self.capacity, ids[k * step:(k + 1) * step], tokens)])
        if tokens % self.capacity:
            self._place((doc_id, full * self.capacity, ids[full * step:], tokens))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        levels = np.arange(self.capacity - size + 1)
        cost = 2 * (self.counts[levels + size] - self.counts[levels]) + 2
        cost[0] = 2 * self.counts[size] + 1
        full = self.capacity - size
        cost[full] = 1 - 2 * self.counts[full] if full else 0
        cost[1:][self.counts[1:full + 1] == 0] = np.iinfo(np.int64).max
        # Of equal costs the fullest window wins.
        level = int(full - np.argmin(cost[::-1]))
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            self._emit(window)
            return
        self.open.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > OPEN_WINDOWS:
            self.close()

    def close(self) -> None:
        """Fill the fullest open windows with cut pieces of the emptiest ones."""
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        last = len(windows) - 1
        for i, window in enumerate(windows):
            if i > last:
                break
            room = self.capacity - sum(len(p[2]) // 4 for p in window)
            while room and last > i:
                donor = windows[last]
                doc_id, start, ids, tokens = donor.pop()
                size = len(ids) // 4
                if size > room:
                    # The tail moves; the head stays at the end of its window.
                    donor.append((doc_id, start, ids[:4 * (size - room)], tokens))
                    window.append((doc_id, start + size - room, ids[4 * (size - room):], tokens))
                    room = 0
                else:
                    window.append((doc_id, start, ids, tokens))
                    room -= size
                if not donor:
                    last -= 1
            if room:
                self._powers(window, self.capacity - room)
            else:
                self._emit(window)

    def _powers(self, window: list[tuple], left: int) -> None:
        """Cut a window into sequences whose lengths are powers of two."""
        pieces = list(reversed(window))
        while left:
            length = 1 << (left.bit_length() - 1)
            left -= length
            sequence = []
            while length:
                doc_id, start, ids, tokens = pieces.pop()
                size = len(ids) // 4
                if size > length:
                    pieces.append((doc_id, start + length, ids[4 * length:], tokens))
                    ids, size = ids[:4 * length], length
                sequence.append((doc_id, start, ids, tokens))
                length -= size
            self._emit(sequence)

    def _emit(self, window: list[tuple]) -> None:
        offset, total = 0, sum(len(p[2]) // 4 for p in window)
        for doc_id, start, ids, tokens in window:
            size = len(ids) // 4
            self.rows.append((doc_id, start, size, zlib.crc32(ids), tokens, self.next_id, offset, total))
            offset += size
        self.next_id += 1

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [()] * len(ARROW)
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=ARROW)


def pack(docs: DataFrame, *, capacity: int = 1024, closing_id: int = 0, path: str | None = None,
         added_tokens: bool = False) -> DataFrame:
    """Pieces of all documents and their places.

    Returns one row per piece: `doc_id`, `start` (ids of the document before
    it), `length`, `ids_crc32` (of its ids as little-endian 32-bit integers),
    `doc_tokens`, `sequence_id`, `offset` in the sequence and the
    `sequence_length`. A null or empty text has the closing id alone. Equal
    rows are packed each by itself, a null id stays null. An empty table gives
    no pieces. The same input partitions give the same sequences.

    `path` is a JSON file of the library `tokenizers`, with the rank file of
    the same name beside it. With `added_tokens` the strings of its added
    tokens become their ids, as that library reads them by default; without,
    they are ordinary text.
    """
    path = path or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = json_vocabulary(path, added_tokens)
        closing = np.array([closing_id], dtype="<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.array(vocabulary.encode(text or ""), dtype="<u4").tobytes()
                packer.document(doc_id, ids + closing)
            yield packer.take()
        packer.close()
        yield packer.take()

    return bounded(docs).select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)
