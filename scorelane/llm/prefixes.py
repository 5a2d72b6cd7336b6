"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A turn is known by 16 bytes of the SHA-256 of its role and text, and a prefix by 16
bytes that add up from its turns and their places, so two turns agree in their prefix
exactly if their conversations agree up to them. A conversation is a string of such
prefixes. Strings are sorted by ranges, so that strings with a common prefix are
neighbours, also across tasks.

Within a run of sorted strings each pair of neighbours is an edge, as deep as their
longest common prefix (LCP). Edges are taken in descending depth, and a union-find
merges the components on both sides: the component that comes out is a branching node
at that depth, its children are those that went in. Between a node and the one above
it lies a chain of nodes without branches.

Runs are cut by size as well as by task. Nodes on the path of a run's first or last
string may go on in the next run: they stay open. Their forest is contracted to what
one row per open node says about the closed nodes below it, and forests are merged
across boundaries by prefix. Then only open nodes are left to add up: there are at
most two paths per run.

Long conversations are cut into strings of ``CHUNK`` turns, each below the prefix it
starts with. The deepest are done first, and a string carries what hangs below its end.

Defined results: rows without ``conv_id`` belong to no conversation and are left out;
null roles and texts are empty; a null turn comes first; turns of one number (ties,
repeated rows) are all kept, in the order of their digests; empty texts are turns like
others; texts of any length are hashed inside the JVM; an empty table has no root. Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import staged, struct_of
from scorelane.llm.order import PLACE, numbered
from scorelane.session import few

#: Turns in a string at most.
CHUNK = 4096
#: Bytes of strings and strings in a run about.
RUN_BYTES = 16 << 20
RUN_STRINGS = 50_000
#: Ids of ended conversations that are passed on as one piece of text.
PIECE_IDS = 500
UNIT = 16

ROOT = b"\0" * UNIT
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What a run says of a node: closed ones are whole, open ones are parts, ends are pieces of text.
NODES = (
    "kind string, id binary, parent binary, depth bigint, bytes bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string"
)
STRINGS = "conv_id bigint, chunk bigint, key binary, sizes binary, over boolean"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, place, digest and size of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(said, 256), 1, 2 * UNIT)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return numbered(staged(rows, "turns"), "conv_id", ["turn", "digest"], "turn-places").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and all conversations, each with ``n_turns``.

    A conversation takes the first ``h`` turns of the one whose id is the multiple of
    five below it, and then its own from the ``h``-th on.
    """
    own = F.col("conv_id")
    counts = staged(turns.groupBy("conv_id").agg((F.max(PLACE) + 1).alias("n")), "conversations")
    checksum = F.crc32(own.cast("string").cast("binary")) % 9
    bases = counts.select(own.alias("base"), F.col("n").alias("n_base"))
    convs = counts.select("conv_id", (own - own % 5).alias("base"), checksum.alias("h"), "n")
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = staged(
        convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt"
    )
    first = turns.where(F.col(PLACE) < 8).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").where(F.col(PLACE) < F.col("h"))
    # One row per conversation meets its turns, so Spark can split the turns of a long one.
    kept = turns.join(convs, "conv_id").where(F.col(PLACE) >= F.col("h"))
    kept = kept.withColumn(PLACE, F.col(PLACE) - F.col("h") + F.col("taken"))
    columns = ["conv_id", PLACE, "digest", "bytes", "n_turns"]
    return taken.select(*columns).unionByName(kept.select(*columns)), convs


def _marks(places: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """What turns at their places add to the prefixes that hold them: two 64-bit numbers each."""
    place = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = digests ^ np.stack([place, ~place], axis=1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        found = (found ^ (found >> np.uint64(shift))) * np.uint64(factor)
    return found ^ (found >> np.uint64(31))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the lists of turns, and places, digests and sizes of all turns in them."""
    edges = column.offsets.to_numpy() - column.offsets[0].as_py()
    turns = column.flatten()
    place, digest, size = (turns.field(i) for i in range(3))
    digests = np.frombuffer(b"".join(digest.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    return edges, place.to_numpy(), digests, size.to_numpy()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a string's turns add up to."""
    for batch in batches:
        edges, places, digests, _ = _flat(batch.column(2))
        sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(_marks(places, digests), axis=0)])
        both = (sums[edges[1:]] - sums[edges[:-1]]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both[:, 0]), pa.array(both[:, 1])],
            names=["conv_id", "chunk", "low", "high"],
        )


def _starts(frame: pd.DataFrame) -> pd.DataFrame:
    """The prefix that each string of one conversation starts with: a row per ``CHUNK`` turns."""
    frame = frame.sort_values("chunk")
    sums = np.cumsum(frame[["low", "high"]].to_numpy().astype(np.uint64), axis=0)
    before = np.concatenate([np.zeros((1, 2), np.uint64), sums[:-1]])
    return pd.DataFrame(
        {"conv_id": frame["conv_id"], "chunk": frame["chunk"], "start": [row.astype(">u8").tobytes() for row in before]}
    )


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings as keys: the prefix they start with, and the prefix after each of their turns."""
    for batch in batches:
        edges, places, digests, sizes = _flat(batch.column(2))
        marks, keys, held = _marks(places, digests), [], []
        for start, low, high in zip(batch.column(4).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            base = np.frombuffer(start or ROOT, ">u8").astype(np.uint64)
            keys.append((start or ROOT) + (base + np.cumsum(marks[low:high], axis=0)).astype(">u8").tobytes())
            held.append(sizes[low:high].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(held, pa.binary()), batch.column(3)],
            names=["conv_id", "chunk", "key", "sizes", "over"],
        )


def strings(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The strings of all conversations, as a stage; one without turns has the empty string."""
    part = F.floor(F.col(PLACE) / chunk)
    gathered = turns.groupBy("conv_id", part.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct(PLACE, "digest", "bytes"))).alias("turns"),
        (F.max("n_turns") > (part + 1) * chunk).alias("over"),
    )
    gathered = staged(gathered.select("conv_id", "chunk", "turns", "over"), "gathered")
    parted = gathered.where(F.col("over") | (F.col("chunk") > 0))
    totals = parted.mapInArrow(_totals, struct_of("conv_id bigint, chunk bigint, low bigint, high bigint"))
    starts = totals.groupBy("conv_id").applyInPandas(_starts, struct_of("conv_id bigint, chunk bigint, start binary"))
    whole = gathered.where(~F.col("over") & (F.col("chunk") == 0)).withColumn("start", F.lit(None).cast("binary"))
    known = whole.unionByName(parted.join(starts, ["conv_id", "chunk"]).select(*whole.columns))
    spelled = known.select("conv_id", "chunk", "turns", "over", "start").mapInArrow(_spelled, struct_of(STRINGS))
    silent = convs.where(F.col("n_turns") == 0).select(
        "conv_id", F.lit(0).cast("long").alias("chunk"), F.lit(ROOT).alias("key"), F.lit(b"").alias("sizes"),
        F.lit(False).alias("over"),
    )
    return staged(spelled.unionByName(silent), "strings")


class _Part:
    """A component of the union-find: strings ``left`` to ``right``, below one node at ``depth``."""

    __slots__ = ("left", "right", "depth", "least", "members", "children", "leaves", "saved", "below", "ends", "tail")

    def __init__(self, at: int, depth: int, ids: list[int], ends: list[int], tail: tuple[int, int, int]):
        self.left = self.right = at
        self.depth, self.least, self.members = depth, ids[0], len(ids)
        self.children = self.leaves = self.saved = 0
        #: What hangs below the end of a string that goes on. Of an open node it is added where forests are merged.
        self.tail = tail
        #: Numbers of the closed nodes right below, which learn this node's smallest member.
        self.below: list[int] = []
        self.ends = ends


class Forest:
    """The nodes of a run of sorted strings."""

    def __init__(self, rows: list[tuple], depth: int):
        """``rows`` are (conv_id, key, sizes, over, tail), sorted by key and id; ``depth`` is that of their start."""
        self.depth = depth
        self.nodes: list[list] = []
        self.keys: list[bytes] = []
        self.sizes: list[bytes] = []
        parts: list[_Part] = []
        start = 0
        while start < len(rows):
            end, key = start, rows[start][1]
            while end < len(rows) and rows[end][1] == key:
                end += 1
            same = rows[start:end]
            tail = next((row[4] for row in same if row[3] and row[4]), (0, 0, 0))
            ends = [row[0] for row in same if not row[3]]
            parts.append(_Part(len(parts), len(key) // UNIT - 1, [row[0] for row in same], ends, tail))
            self.keys.append(key)
            self.sizes.append(same[0][2])
            start = end
        self.last = len(parts) - 1
        self._join(parts)

    def _common(self, at: int) -> int:
        """Depth of the longest common prefix of two neighbours, -1 if they start differently."""
        a, b = self.keys[at], self.keys[at + 1]
        n = min(len(a), len(b)) // UNIT
        pair = (np.frombuffer(x, "V16", n) for x in (a, b))
        differ = np.flatnonzero(next(pair) != next(pair))
        return (int(differ[0]) if len(differ) else n) - 1

    def _join(self, parts: list[_Part]) -> None:
        leader = list(range(len(parts)))

        def find(at: int) -> int:
            while leader[at] != at:
                leader[at] = leader[leader[at]]
                at = leader[at]
            return at

        depths = np.array([self._common(at) for at in range(self.last)], np.int64)
        for edge in np.argsort(-depths, kind="stable").tolist():
            depth = int(depths[edge])
            if depth < 0:
                break
            one, other = find(edge), find(edge + 1)
            merged = self._risen(parts[one], depth)
            self._add(merged, self._risen(parts[other], depth))
            leader[other] = one
            parts[one] = merged
        for at, part in enumerate(parts):
            if leader[at] == at:
                self._risen(part, -1)

    @staticmethod
    def _add(part: _Part, other: _Part) -> None:
        part.left, part.right = min(part.left, other.left), max(part.right, other.right)
        part.least = min(part.least, other.least)
        part.members += other.members
        part.children += other.children
        part.leaves += other.leaves
        part.saved += other.saved
        part.below += other.below
        part.ends = part.ends or other.ends
        part.tail = max(part.tail, other.tail)

    def _risen(self, part: _Part, depth: int) -> _Part:
        """``part`` as far up as ``depth``: the nodes of the chain down to its own are given out."""
        key, sizes = self.keys[part.left], np.frombuffer(self.sizes[part.left], np.int64)
        edge = part.left == 0 or part.right == self.last
        for at in range(part.depth, depth, -1):
            is_open = edge or at == 0
            size = int(sizes[at - 1]) if at else 0
            parent = key[(at - 1) * UNIT : at * UNIT] if at else None
            node = key[at * UNIT : (at + 1) * UNIT]
            if not is_open:
                children, leaves, saved = part.tail
                part.children += children
                part.saved += saved
                part.leaves = part.leaves + leaves or 1
                part.saved += (part.members - 1) * size
                for child in part.below:
                    self.nodes[child][6] = part.least
            ends = hashlib.sha256(",".join(map(str, part.ends)).encode()).hexdigest() if not is_open else None
            self.nodes.append([
                "open" if is_open else "closed", node, parent, self.depth + at, size, part.least, None,
                part.members, part.children, part.leaves, part.saved, ends,
            ])
            if is_open:
                for start in range(0, len(part.ends), PIECE_IDS):
                    piece = part.ends[start : start + PIECE_IDS]
                    text = ",".join(map(str, piece))
                    self.nodes.append(["piece", node, *[None] * 3, piece[0], *[None] * 5, text])
            closed = not is_open
            part.below = [len(self.nodes) - 1] if closed else []
            part.children, part.ends, part.tail = int(closed), [], (0, 0, 0)
            if not closed:
                part.leaves = part.saved = 0
        part.depth = min(part.depth, depth)
        return part


def _runs(depth: int, run_bytes: int, run_strings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            nodes = Forest(held, depth).nodes
            columns = list(zip(*nodes, strict=True))
            arrays = [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                held.append((*row[:4], row[4:] if row[4] is not None else None))
                size += len(row[1]) + len(row[2])
                if size >= run_bytes or len(held) >= run_strings:
                    yield from given()
                    held, size = [], 0
        if held:
            yield from given()

    schema = pa.schema([
        (part.split()[0], {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}[part.split()[1]])
        for part in NODES.split(", ")
    ])
    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node's pieces, which come in order."""
    now, digest = None, None

    def given(nodes: list, found: list) -> pa.RecordBatch:
        columns = [pa.array(nodes, pa.binary()), pa.array(found, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "ends"])

    for batch in batches:
        nodes, found = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if digest is not None:
                    nodes.append(now)
                    found.append(digest.hexdigest())
                now, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield given(nodes, found)
    if digest is not None:
        yield given([now], [digest.hexdigest()])


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of the open nodes, from the deepest up."""
    frame = frame.sort_values("depth", ascending=False, kind="stable").reset_index(drop=True)
    place = {node: at for at, node in enumerate(frame["id"])}
    up = np.array([place.get(parent, -1) for parent in frame["parent"]], np.int64)
    depths = frame["depth"].to_numpy()
    cuts = np.flatnonzero(np.diff(depths)) + 1
    sums = frame[["n_leaves", "saved"]].to_numpy().copy()
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frame)], strict=True):
        inner = np.arange(start, end)[up[start:end] >= 0]
        np.add.at(sums, up[inner], sums[inner])
    return frame.assign(n_leaves=sums[:, 0], saved=sums[:, 1])


def _level(found: DataFrame, tails: DataFrame | None, first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of a level below its starts, the starts (or the root among the nodes), and open ids."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    is_open = found.where("kind = 'open'")
    same = [F.first(c).alias(c) for c in ("parent", "depth", "bytes")]
    merged = staged(is_open.groupBy("id").agg(*same, F.min("conv_id").alias("conv_id"), *sums), "open-nodes")
    children = merged.groupBy("parent").agg(F.count(F.lit(1)).alias("more")).withColumnRenamed("parent", "id")
    pieces = found.where("kind = 'piece'").select("id", "conv_id", "ends").repartition("id")
    pieces = pieces.sortWithinPartitions("id", "conv_id").select("id", "ends")
    ends = pieces.mapInArrow(_ends, struct_of("id binary, ends string"))
    merged = merged.join(children, "id", "left").join(ends, "id", "left")
    zero = F.lit(0).cast("long")
    extra = {"n_children": F.col("n_children") + F.coalesce("more", zero)}
    if tails is not None:
        merged = merged.join(tails, "id", "left")
        extra["n_children"] += F.coalesce("tail_children", zero)
        extra["n_leaves"] = F.col("n_leaves") + F.coalesce("tail_leaves", zero)
        extra["saved"] = F.col("saved") + F.coalesce("tail_saved", zero)
    merged = merged.withColumns(extra)
    own = F.when(F.col("parent").isNull(), zero).otherwise((F.col("n_convs") - 1) * F.col("bytes"))
    merged = merged.withColumns({
        "n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": F.col("saved") + own,
        "ends": F.coalesce("ends", F.lit(NO_ENDS)),
    })
    columns = ["id", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    merged = merged.select(*columns)
    # Two paths per run, so this is a small part of a level whatever the level's size.
    total = staged(merged.groupBy().applyInPandas(_summed, merged.schema), "open-sums")
    closed = found.where("kind = 'closed'").select(*columns, "parent_conv_id")
    nodes = closed.unionByName(
        total.where(F.lit(first) | F.col("parent").isNotNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    return nodes, total.where("parent IS NULL"), total.select("id", "conv_id")


def _resolved(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes with the smallest member of their parents, where it is not known yet."""
    known = few(known.select(F.col("id").alias("parent"), F.col("conv_id").alias("found")), "trie-parents")
    waits = F.col("parent").isNotNull() & F.col("parent_conv_id").isNull()
    met = nodes.where(waits).join(known, "parent", "left")
    met = met.withColumn("parent_conv_id", F.col("found")).select(*nodes.columns)
    return nodes.where(~waits).unionByName(met)


def trie(
    conversations: DataFrame, chunk: int = CHUNK, run_bytes: int = RUN_BYTES, run_strings: int = RUN_STRINGS
) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations.

    ``conv_id`` is its smallest member and ``depth`` its turns; ``prefix`` names it.
    See the module for nulls and ties.
    """
    every = strings(*rebuilt(turns_of(conversations)), chunk)
    deepest = every.agg(F.coalesce(F.max("chunk"), F.lit(0)).alias("n")).first()["n"]
    none = [F.lit(None).cast("long").alias(c) for c in ("tail_children", "tail_leaves", "tail_saved")]
    done, tails, below, starts = [], None, None, None
    for number in range(deepest, -1, -1):
        rows = every.where(F.col("chunk") == number).select("conv_id", "key", "sizes", "over")
        if tails is None:
            rows = rows.select("*", *none)
        else:
            end = F.substring("key", -UNIT, UNIT)
            rows = rows.join(tails, F.when(F.col("over"), end) == tails["id"], "left").drop("id")
        dealt = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        found = staged(dealt.mapInArrow(_runs(number * chunk, run_bytes, run_strings), struct_of(NODES)), "trie-runs")
        nodes, roots, known = _level(found, tails, number == 0)
        if below is not None:
            # The starts of the strings below are nodes of this level.
            above = staged(nodes.join(starts.select("id"), "id", "left_semi").select("id", "conv_id"), "trie-starts")
            done.append(_resolved(below, above))
        below = _resolved(nodes, known if number == 0 else known.join(roots.select("id"), "id", "left_anti"))
        starts = roots
        tails = roots.select(
            "id", F.col("n_children").alias("tail_children"), F.col("n_leaves").alias("tail_leaves"),
            F.col("saved").alias("tail_saved"),
        )
    done.append(below)
    found = done[0]
    for frame in done[1:]:
        found = found.unionByName(frame)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"), F.hex("id").alias("prefix"),
    )
