"""Packing documents into sequences by multiway differencing.

Each task reads its documents, encodes them and packs blocks of a bounded number
of tokens; neither texts nor ids are shuffled. Whole windows of a long document
are sequences of their own. What is left is cut into pieces of at most ``piece``
ids, and a block's pieces are dealt to as few windows as can hold them: every
piece is a partition with one filled window, and the two partitions with the
largest imbalance are merged, the fullest window of one with the emptiest of the
other, until one is left. If a window is then over its capacity, there is one
window more, and the block is dealt again.

Defined results: null and empty texts have one id, the closing one; rows with a
null or repeated ``doc_id`` are packed like any other; an empty table gives an
empty result. Sequence ids are the task's number and a count within it, so a task
that runs again gives the same.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import struct_of
from scorelane.llm.encoding import worker_encoder

CAPACITY = 2048
PIECE = 512
#: Windows that a block fills about.
WINDOWS = 128
#: The id that closes a document.
CLOSING = 1

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def _merged(one: list, two: list, windows: int, nodes: list) -> list:
    """Two partitions as one: windows as (sum, node), fullest first, empty ones left out."""
    if len(one) < len(two):
        one, two = two, one
    alone = windows - len(one)
    rest = two[alone:]
    if not rest:
        return sorted(one + two, reverse=True)
    kept = one[: len(one) - len(rest)] + two[:alone]
    for (a, left), (b, right) in zip(reversed(one), rest, strict=False):
        nodes.append((left, right))
        kept.append((a + b, len(nodes) - 1))
    kept.sort(reverse=True)
    return kept


def differencing(lengths: Sequence[int], windows: int) -> list[list[int]]:
    """The places of ``lengths`` dealt to ``windows``, with near-equal sums."""
    nodes: list = list(range(len(lengths)))
    heap = [(-length, i, [(length, i)]) for i, length in enumerate(lengths)]
    if windows == 1:
        return [list(range(len(lengths)))]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, one = heapq.heappop(heap)
        both = _merged(one, heap[0][2], windows, nodes)
        spread = both[0][0] - (both[-1][0] if len(both) == windows else 0)
        heapq.heapreplace(heap, (-spread, order, both))
    dealt = []
    for _, node in heap[0][2] if heap else []:
        found, open_ = [], [node]
        while open_:
            held = nodes[open_.pop()]
            if isinstance(held, tuple):
                open_.extend(held)
            else:
                found.append(held)
        dealt.append(found)
    return dealt


def windows_of(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The places of ``lengths`` in as few near-equal windows as hold them."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        dealt = differencing(lengths, windows)
        if all(sum(lengths[i] for i in window) <= capacity for window in dealt):
            return dealt
        windows += 1


def pack(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    windows: int = WINDOWS,
) -> DataFrame:
    """A row per piece of a document, with its sequence and its offset there."""
    block = capacity * windows
    schema = struct_of(PIECES)
    kinds = [pa.int64()] * len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        first = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        left: list[tuple] = []
        tokens = sequences = 0
        closing = CLOSING.to_bytes(4, "little")

        def out() -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            pieces.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names
            )

        def deal() -> None:
            nonlocal sequences
            for window in windows_of([p[2] for p in left], capacity):
                offset = 0
                for i in window:
                    pieces.append((*left[i], first + sequences, offset))
                    offset += left[i][2]
                sequences += 1
            left.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + closing
                size = len(ids) // 4
                whole = size - size % capacity
                for start in range(0, whole, capacity):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + capacity)])
                    pieces.append((doc, start, capacity, crc, size, first + sequences, 0))
                    sequences += 1
                for start in range(whole, size, piece):
                    end = min(size, start + piece)
                    left.append((doc, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), size))
                tokens += size - whole
                if tokens >= block:
                    deal()
                    tokens = 0
                    yield out()
            if pieces:
                yield out()
        if left:
            deal()
        if pieces:
            yield out()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
