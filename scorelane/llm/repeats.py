"""Substring dedup: a count-min prefilter, then exact grouping of what it lets through.

A window is 13 consecutive words of one document. A word goes if a window over it
also starts in a document with a smaller ``doc_id``. Documents are dealt once to
blocks of at most 8 MB of text, in a table that is bucketed by block, so that the
passes below move no text.

1. Each block counts its windows in a count-min sketch of two rows. A sketch is
   kept sparse (its sorted cells, each at most twice) and cut into slices. All
   sketches of a slice are merged in one group, and each block is told by a bit
   which of its cells were counted twice or more. Width and slices follow from the
   bytes of text, so neither the share of false hits nor a group grows with the
   table, and no sketch is ever held or sent whole.
2. Windows whose estimate is below two in either row occur once. Of the others a
   block sends each distinct window once, with its smallest ``doc_id``. They are
   grouped exactly, by 96 bits of hash, and a block gets back those that start in
   a smaller document elsewhere. A window that a third of all documents have is a
   row per block by then.
3. Blocks remove words: windows known from elsewhere, and those of a smaller
   document of their own.

An estimate is never below the true count, so no repeated window is lost.

Defined results: a null text has no words; a document of fewer than 13 words has
no window and keeps all; a null ``doc_id`` comes after all others, and rows with
equal ``doc_id`` (repeated rows, ties) take nothing from each other; a window that
repeats in one document only stays; an empty table gives no rows. A very long text
is a block of its own and is read 1 MB at a time: 24 bytes a word are held. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import anchored, shards_for, staged, struct_of
from scorelane.session import work_path

WORDS = 13
#: Bytes of text in a block at most, unless it is one document.
BLOCK_BYTES = 8 << 20
#: Bytes of text that a task of the bucketed table reads about, and buckets at most.
TASK_BYTES = 16 << 20
BUCKETS = 50_000
#: Cells that a slice of the merged sketch is given about.
SLICE_CELLS = 1 << 22
#: Cells per window that the text can hold, which bounds the share of false hits.
SPARE = 4
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20

LAST = np.iinfo(np.int64).max
FIRST = np.iinfo(np.int64).min

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers, one for each of the two hashes.
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of a bounded size; ``split`` knows the same six spaces."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def _mixed(values: np.ndarray, turn: int) -> np.ndarray:
    """Each value's bits spread over all 64."""
    values = (values ^ (values >> np.uint64(30 + turn))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27 - turn))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _window_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each ``size`` consecutive word hashes."""
    count = max(0, len(words) - size + 1)
    found = []
    for turn, factor in enumerate(_FACTORS):
        mixed, total = _mixed(words, turn), np.zeros(count, np.uint64)
        for k in range(size):
            total = total * factor + mixed[k : k + count]
        found.append(_mixed(total, turn))
    return found[0], found[1]


class Block:
    """Windows of a block's documents: hashes, first words and the order of their documents."""

    def __init__(self, rows: pd.DataFrame, size: int):
        self.size = size
        self.texts = [text.encode() if isinstance(text, str) else b"" for text in rows["text"]]
        self.ids = np.where(rows["none"], LAST, rows["doc_id"]).astype(np.int64)
        digest = xxhash.xxh3_64_intdigest
        parts, counts = [np.empty(0, np.uint64)], []
        for text in self.texts:
            counts.append(0)
            for words in _word_lists(text):
                parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
                counts[-1] += len(words)
        self.words = np.concatenate(parts)
        self.edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        first, second = _window_hashes(self.words, size)
        whole = owner[: len(first)] == owner[size - 1 :] if len(first) else np.empty(0, bool)
        self.at = np.flatnonzero(whole)
        self.hashes = (first[whole], second[whole])
        self.order = self.ids[owner[self.at]]


def _packed(values: np.ndarray) -> bytes:
    """Values byte by byte: all lowest bytes, then all next ones, which compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _squeezed(cells: np.ndarray) -> bytes:
    """Sorted cells of a slice: the first, and the steps between them, whose higher bytes are mostly small."""
    steps = np.diff(cells, prepend=cells[:1]).astype(np.uint32)
    planes = _packed(steps)
    return int(cells[0]).to_bytes(8, "little") + planes[: len(steps)] + zlib.compress(planes[len(steps) :], 1)


def _spread(data: bytes, count: int) -> np.ndarray:
    planes = data[8 : 8 + count] + zlib.decompress(data[8 + count :])
    return np.cumsum(_unpacked(planes, np.uint32), dtype=np.uint64) + np.uint64(int.from_bytes(data[:8], "little"))


class Sketch:
    """The form of the sketches: bits of a cell's number and of a slice's."""

    def __init__(self, windows: int, slice_cells: int = SLICE_CELLS, spare: int = SPARE):
        self.bits = max(8, (spare * max(1, windows) - 1).bit_length())
        self.slice_bits = min(self.bits, max(0, (windows // slice_cells).bit_length()), 24)

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def slices(self, cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(slice, start, end) of sorted cells."""
        inner = np.uint64(self.bits - self.slice_bits)
        own = cells >> inner
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
            if end > start:
                yield int(own[start]), start, end

    def sparse(self, hashes: np.ndarray) -> np.ndarray:
        """A block's row of the sketch: sorted cells, as often as they are counted, twice at most."""
        cells = np.sort(self.cells(hashes))
        keep = np.ones(len(cells), bool)
        keep[2:] = cells[2:] != cells[:-2]
        return cells[keep]


CELLS = "row int, slice int, block bigint, count bigint, cells binary"
ANSWERS = "block bigint, row int, slice int, bits binary"
SENT = "part int, block bigint, first binary, second binary, ids binary"
ELSEWHERE = "block bigint, first binary, second binary"
RESULT = "doc_id bigint, none boolean, n_words bigint, n_removed bigint, kept string"


def _counted(sketch: Sketch, size: int):
    """Pass 1 in a block: its sketch, a row per slice."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, rows = Block(frame, size), []
        for row, hashes in enumerate(block.hashes):
            cells = sketch.sparse(hashes)
            for part, start, end in sketch.slices(cells):
                rows.append((row, part, frame["block"].iloc[0], end - start, _squeezed(cells[start:end])))
        return pd.DataFrame(rows, columns=["row", "slice", "block", "count", "cells"])

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """The sketches of a slice added up: for each block, which of its cells are counted twice."""
    sent = [_spread(data, count) for data, count in zip(frame["cells"], frame["count"], strict=True)]
    every = np.sort(np.concatenate(sent))
    often = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for cells in sent:
        own = np.unique(cells)
        bits.append(np.packbits(_among(own, often)).tobytes())
    return pd.DataFrame(
        {"block": frame["block"], "row": frame["row"], "slice": frame["slice"], "bits": bits},
        columns=["block", "row", "slice", "bits"],
    )


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


def _least(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows by hashes and id, where each distinct one starts, and its number by place."""
    order = np.lexsort((ids, second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _suspected(sketch: Sketch, parts: int, size: int):
    """Pass 2 in a block: its windows that are estimated repeated, each once."""

    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["part", "block", "first", "second", "ids"]
        if not len(texts):
            return pd.DataFrame([], columns=columns)
        block = Block(texts, size)
        known = {(r, s): data for r, s, data in zip(answers["row"], answers["slice"], answers["bits"], strict=True)}
        repeated = np.ones(len(block.at), bool)
        for row, hashes in enumerate(block.hashes):
            cells, place = np.unique(sketch.cells(hashes), return_inverse=True)
            often = np.zeros(len(cells), bool)
            for part, start, end in sketch.slices(cells):
                bits = np.frombuffer(known[row, part], np.uint8)
                often[start:end] = np.unpackbits(bits, count=end - start)
            repeated &= often[place]
        first = block.hashes[0][repeated]
        second = (block.hashes[1][repeated] >> np.uint64(32)).astype(np.uint32)
        ids = block.order[repeated]
        order, starts, _ = _least(first, second, ids)
        lead = order[starts]
        first, second, ids = first[lead], second[lead], ids[lead]
        own = ((first >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(own, np.unique(own)).tolist()
        rows = [
            (int(own[start]), texts["block"].iloc[0], *(_packed(x[start:end]) for x in (first, second, ids)))
            for start, end in zip(cuts, [*cuts[1:], len(own)], strict=False)
        ]
        return pd.DataFrame(rows, columns=columns)

    return run


def _grouped(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows grouped exactly: for each block, those that start in a smaller document elsewhere."""
    sent = [
        [_unpacked(data, kind) for data in frame[name]]
        for name, kind in (("first", np.uint64), ("second", np.uint32), ("ids", np.int64))
    ]
    sizes = [len(x) for x in sent[0]]
    first, second, ids = (np.concatenate(x) for x in sent)
    order, starts, place = _least(first, second, ids)
    later = np.empty(len(order), bool)
    later[order] = ids[order] > ids[order[starts]][place]
    rows, at = [], 0
    for block, n in zip(frame["block"], sizes, strict=True):
        taken = np.flatnonzero(later[at : at + n]) + at
        if len(taken):
            rows.append((block, _packed(first[taken]), _packed(second[taken])))
        at += n
    return pd.DataFrame(rows, columns=["block", "first", "second"])


def _removed(block: Block, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which words go; ``first`` and ``second`` are the windows known from elsewhere."""
    own = np.sort(block.hashes[0])
    often = np.unique(np.concatenate([own[1:][own[1:] == own[:-1]], first]))
    chosen = np.flatnonzero(_among(block.hashes[0], often))
    heads = np.concatenate([block.hashes[0][chosen], first])
    tails = np.concatenate([(block.hashes[1][chosen] >> np.uint64(32)).astype(np.uint32), second])
    ids = np.concatenate([block.order[chosen], np.full(len(first), FIRST)])
    order, starts, place = _least(heads, tails, ids)
    later = np.empty(len(order), bool)
    later[order] = ids[order] > ids[order[starts]][place]
    at = block.at[chosen[later[: len(chosen)]]]
    change = np.zeros(len(block.words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + block.size, -1)
    return np.cumsum(change)[:-1] > 0


def _cleaned(size: int):
    """Pass 3 in a block: its documents without the repeated words."""

    def run(texts: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "none", "n_words", "n_removed", "kept"]
        if not len(texts):
            return pd.DataFrame([], columns=columns)
        block = Block(texts, size)
        known = [
            np.concatenate([np.empty(0, kind), *(_unpacked(data, kind) for data in elsewhere[name])])
            for name, kind in (("first", np.uint64), ("second", np.uint32))
        ]
        gone = _removed(block, *known)
        rows = []
        for number, text in enumerate(block.texts):
            start, end = block.edges[number : number + 2].tolist()
            kept, at = [], start
            for words in _word_lists(text):
                drop = gone[at : at + len(words)]
                at += len(words)
                chosen = words if not drop.any() else [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                if chosen:
                    kept.append(b" ".join(chosen))
            rows.append((end - start, int(gone[start:end].sum()), b" ".join(kept).decode()))
        found = pd.DataFrame(rows, columns=columns[2:])
        return found.assign(doc_id=texts["doc_id"].to_numpy(), none=texts["none"].to_numpy())[columns]

    return run


def blocks_of(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The documents in a table bucketed by ``block``, and the bytes of their texts.

    Texts of one size class that lie near each other in a file make a block: as many
    rows as the class's largest texts would need to fill it, so its size is bounded.
    """
    rows = anchored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "repeats-input")
    place = rows.metadataColumn("_metadata")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = rows.withColumn("bytes", size).withColumns({"file": place["file_path"], "number": place["row_index"]})
    # Sizes are rounded up to the next power of four.
    level = F.ceil(F.log2(F.greatest("bytes", F.lit(1))) / 2)
    per_block = F.greatest(F.lit(1.0), F.floor(F.lit(float(block_bytes)) / F.pow(F.lit(4.0), level)))
    block = F.xxhash64("file", level, F.floor(F.col("number") / per_block))
    # Ids cross to Python without nulls, which would make them doubles there.
    keyed = rows.select(
        block.alias("block"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"),
        "text",
    )
    spark = documents.sparkSession
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = min(BUCKETS, shards_for(total, TASK_BYTES))
    name = f"repeats_{uuid.uuid4().hex}"
    (
        keyed.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block")
        .option("compression", "zstd").option("path", work_path(spark, "repeats-blocks")).saveAsTable(name)
    )
    return spark.table(name), total


def deduplicated(documents: DataFrame, size: int = WORDS) -> DataFrame:
    """A row per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words that stay.

    See the module for the method, nulls and ties.
    """
    blocks, total = blocks_of(documents)
    windows = total // 2 + 1
    sketch, parts = Sketch(windows), shards_for(windows, SLICE_CELLS)
    by_block = blocks.groupBy("block")
    cells = by_block.applyInPandas(_counted(sketch, size), struct_of(CELLS))
    answers = cells.groupBy("row", "slice").applyInPandas(_merged, struct_of(ANSWERS))
    sent = by_block.cogroup(answers.groupBy("block")).applyInPandas(
        _suspected(sketch, parts, size), struct_of(SENT)
    )
    elsewhere = staged(sent.groupBy("part").applyInPandas(_grouped, struct_of(ELSEWHERE)), "repeats-elsewhere")
    cleaned = by_block.cogroup(elsewhere.groupBy("block")).applyInPandas(_cleaned(size), struct_of(RESULT))
    return cleaned.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")
