"""Best-fit packing of token pieces into fixed-length training sequences.

Bounded-space online best-fit: a task keeps a fixed number of open bins, filed
by their free space; a bitset of the free spaces in use finds the tightest bin
in one step, and when all bins are in use the fullest closes.  Tasks pack
shares of the pieces; what lies in bins that are still open at a task's end is
packed again in fewer tasks, down to one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .scratch import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class OpenBins:
    """At most ``limit`` open bins of ``capacity``; ``put`` returns the bins that it closes.

    A bin is the list of its (item, length).  Ties between bins of equal free
    space go to the one used last.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.filed: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f: some open bin has f free
        self.open = 0

    def _take(self, free: int) -> list:
        found = self.filed[free].pop()
        if not self.filed[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def put(self, item, length: int) -> list[list]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"length {length} does not fit a bin of {self.capacity}")
        closed = []
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            into = self._take(free)
        else:
            free, into = self.capacity, []
            if self.open == self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        into.append((item, length))
        if free == length:
            closed.append(into)
        else:
            self.filed[free - length].append(into)
            self.bits |= 1 << (free - length)
            self.open += 1
        return closed

    def rest(self) -> list[tuple[int, list]]:
        """The open bins with their free space, fullest first."""
        return [(free, found) for free, bins in enumerate(self.filed) for found in bins]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``PIECES``: each document's ids and the end id, in one piece if they fit ``length``.

    Longer documents are cut so that all pieces but the first have full length.
    A null text counts as empty: its only id is the end id.  Repeated rows give
    repeated pieces; a null id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                n, at = len(ids), 0
                for k in range(-(-n // length)):
                    size = (n - 1) % length + 1 if k == 0 else length
                    rows.append((doc, k, at, size, zlib.crc32(ids[at : at + size])))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _PIECE.types, strict=True)], schema=_PIECE)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def _packer(capacity: int, limit: int, layer: int, last: bool, full_enough: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (layer << 56) + (TaskContext.get().partitionId() << 32)
        bins = OpenBins(capacity, limit)

        def placed(closed: list[list]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for one in closed:
                at = 0
                for item, length in one:
                    rows.append((*item, number, at))
                    at += length
                number += 1
            return table(rows)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _PLACED.types, strict=True)], schema=_PLACED)

        def put(items: list[tuple]) -> pa.RecordBatch:
            closed: list[list] = []
            for item in sorted(items, key=lambda x: -x[3]):
                closed += bins.put(item, item[3])
            return placed(closed)

        waiting: list[tuple] = []
        for batch in batches:
            waiting += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(waiting) >= limit:
                yield put(waiting[:limit])
                waiting = waiting[limit:]
        yield put(waiting)
        rest = bins.rest()
        yield placed([one for free, one in rest if last or free <= full_enough])
        yield table([(*item, None, None) for free, one in rest if not last and free > full_enough for item, _ in one])

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 1024, open_bins: int = 4096, pieces_per_task: int = 1 << 17) -> DataFrame:
    """Adds ``sequence_id`` and the gapless ``offset`` to rows of ``PIECES``.

    Pieces arrive in an order by hash, the same in every attempt of a task; as
    many as there are bins wait together and go in longest first (with 4096,
    about 0.2 % more sequences than the sum of lengths needs).  Open bins at a task's end are final if at most 1/128 of them is free.
    Each round has at most half the tasks of the one before, so that pieces of
    which no bin ever gets full (all of one awkward length) end in one task too;
    what is left for it are the open bins of two tasks.
    """
    todo, done, layer, most = staged(pieces, "pieces"), [], 0, None
    while True:
        tasks = max(1, -(-todo.count() // pieces_per_task))
        tasks = min(tasks, max(1, most // 2)) if most else tasks
        most = tasks
        mixed = F.xxhash64("doc_id", "piece", F.lit(layer))
        dealt = todo.repartition(tasks, mixed) if tasks > 1 else todo.repartition(1)
        dealt = dealt.sortWithinPartitions(mixed, "doc_id", "piece", "start", "length", "ids_crc32")
        out = dealt.mapInArrow(_packer(capacity, open_bins, layer, tasks == 1, capacity >> 7), PLACED)
        if tasks == 1:
            done.append(out)
            break
        out = staged(out, f"packed{layer}")
        done.append(out.where("sequence_id IS NOT NULL"))
        todo = out.where("sequence_id IS NULL").drop("sequence_id", "offset")
        layer += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, **how) -> DataFrame:
    """Rows of ``PLACED`` for all documents; an empty table gives an empty one."""
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity), capacity, **how)
