"""Edit-aware token counts with segment trees of pre-tokens.

A text is cut into segments at single spaces between other characters, where the
tokenizer's own pattern always starts a new pre-token, so a text has as many
tokens as its segments. A binary tree over the segments holds sums of characters
and tokens. An edit finds its segments through the tree, joins them, and takes in
neighbours until both edges are such places again; only that region is encoded
anew, and the sums above it are updated.

Defined results: null and empty texts have no tokens; edits beyond the end of a
text are cut off there; null edits are left out; repeated rows are counted each;
a very long text is cut into as many segments as it has such places, and is one
segment if it has none; an empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import kept_by_worker, struct_of

SEGMENT = 1024
_CUT = re.compile(r"(?<=\S) (?=\S)")

Edit = tuple[int, int, str]


def is_cut(before: str, after: str) -> bool:
    """Whether a pre-token always starts between two texts that follow each other."""
    return not before or not after or (
        after[0] == " " and len(after) > 1 and not after[1].isspace() and not before[-1].isspace()
    )


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """``text`` in parts of at least ``size`` characters that may be encoded one by one."""
    found, start = [], 0
    while cut := _CUT.search(text, start + size):
        found.append(text[start : cut.start()])
        start = cut.start()
    found.append(text[start:])
    return found


class CountedText:
    """A text's segments, with sums of their characters and tokens in a tree."""

    def __init__(
        self,
        text: str,
        count: Callable[[str], int],
        size: int = SEGMENT,
        state: tuple[list[int], list[int]] | None = None,
    ):
        self.count, self.size = count, size
        #: Characters that were encoded since the counts were first made.
        self.encoded = 0
        if state is None:
            parts = segments(text, size)
            self._build(parts, [count(part) for part in parts])
        else:
            ends = [0]
            for length in state[0]:
                ends.append(ends[-1] + length)
            if ends[-1] != len(text):
                raise ValueError("the segments are not those of this text")
            self._build([text[a:b] for a, b in zip(ends, ends[1:], strict=False)], list(state[1]))

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        self.parts = parts
        self.leaves = 1 << max(0, len(parts) - 1).bit_length()
        empty = [0] * (self.leaves - len(parts))
        self.chars = [0] * self.leaves + [len(p) for p in parts] + empty
        self.tokens = [0] * self.leaves + tokens + empty
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def state(self) -> tuple[list[int], list[int]]:
        """Characters and tokens by segment, from which the tree can be made again."""
        held = [i for i, part in enumerate(self.parts) if part]
        return [len(self.parts[i]) for i in held], [self.tokens[self.leaves + i] for i in held]

    def _find(self, at: int) -> tuple[int, int]:
        """The segment that holds character ``at``, and the characters before it."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.leaves, len(self.parts) - 1), before

    def _set(self, leaf: int, part: str, tokens: int) -> None:
        self.parts[leaf] = part
        node = leaf + self.leaves
        more, extra = len(part) - self.chars[node], tokens - self.tokens[node]
        while node and (more or extra):
            self.chars[node] += more
            self.tokens[node] += extra
            node //= 2

    def _beside(self, leaf: int, step: int) -> int:
        """The next segment that is not empty, or -1."""
        leaf += step
        while 0 <= leaf < len(self.parts):
            if self.parts[leaf]:
                return leaf
            leaf += step
        return -1

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Put ``inserted`` in the place of ``removed`` characters at ``at`` of the text as it is now."""
        at = min(max(at, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - at)
        first, before = self._find(at)
        last = first if not removed else self._find(at + removed - 1)[0]
        held = "".join(self.parts[first : last + 1])
        start = at - before
        region = held[:start] + inserted + held[start + removed :]
        while (left := self._beside(first, -1)) >= 0 and not (region and is_cut(self.parts[left], region)):
            first, region = left, self.parts[left] + region
        while (right := self._beside(last, 1)) >= 0 and not (region and is_cut(region, self.parts[right])):
            last, region = right, region + self.parts[right]
        self.encoded += len(region)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)
        if len(region) <= 4 * self.size:
            self._set(first, region, self.count(region))
            return
        # A region that has grown is cut again, and the tree made anew from its sums.
        parts = segments(region, self.size)
        tokens = self.tokens[self.leaves : self.leaves + len(self.parts)]
        self._build(
            self.parts[:first] + parts + self.parts[last + 1 :],
            tokens[:first] + [self.count(p) for p in parts] + tokens[last + 1 :],
        )


def worker_count(path: str, pattern: str) -> Callable[[str], int]:
    """How many tokens a text has, with the tokenizer of this Python worker."""

    def load() -> tiktoken.Encoding:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    encode = kept_by_worker(("ranks", path, pattern), load).encode_ordinary
    return lambda text: len(encode(text))


#: What personal data looks like.
_SIGN = re.compile(r"@|\d+(?:\.\d+)*")
_BEFORE_AT = re.compile(r"[\w.+-]{1,64}\Z")
_AFTER_AT = re.compile(r"@[\w-]{1,63}(?:\.[\w-]{1,63})+")
_ADDRESS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_NUMBER = re.compile(r"\d{9,19}")


def redactions(text: str) -> list[Edit]:
    """Edits that put a name in the place of mail addresses, IPv4 addresses and long numbers.

    The last one comes first, so each has its place in the original text.
    """
    found: list[tuple[int, int, str]] = []
    for sign in _SIGN.finditer(text):
        start, end, kind = *sign.span(), ""
        if sign[0] == "@":
            left = _BEFORE_AT.search(text, max(0, start - 64), start)
            right = _AFTER_AT.match(text, start)
            if left and right:
                start, end, kind = left.start(), right.end(), "[mail]"
        elif _ADDRESS.fullmatch(sign[0]):
            kind = "[address]"
        elif _NUMBER.fullmatch(sign[0]):
            kind = "[number]"
        if not kind:
            continue
        # A mail address takes in the numbers before its sign, and those behind it are passed.
        while found and kind == "[mail]" and found[-1][0] >= start:
            found.pop()
        if not found or start >= found[-1][1]:
            found.append((start, end, kind))
    return [(start, end - start, kind) for start, end, kind in reversed(found)]


def edited_counts(
    documents: DataFrame,
    path: str,
    pattern: str,
    edits_of: Callable[[str], Iterable[Edit]] = redactions,
    size: int = SEGMENT,
) -> DataFrame:
    """A row per document: tokens before and after its edits, and what was encoded for them.

    Edits that are derived from the text itself need no join, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_count(path, pattern)
        for batch in batches:
            found = []
            for text in batch.column(1):
                held = CountedText(text.as_py() or "", count, size)
                before, chars, made = held.total, held.chars[1], 0
                for edit in edits_of(text.as_py() or ""):
                    held.edit(*edit)
                    made += 1
                found.append((chars, before, made, held.total, held.encoded))
            columns = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names
            )

    schema = struct_of(
        "doc_id bigint, n_chars bigint, tokens_before bigint, n_edits bigint, n_tokens bigint, "
        "encoded_chars bigint"
    )
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


STATE = "doc_id bigint, text string, chars array<int>, tokens array<int>"


def count_states(documents: DataFrame, path: str, pattern: str, size: int = SEGMENT) -> DataFrame:
    """Documents with their segments' characters and tokens, to be kept for later edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_count(path, pattern)
        for batch in batches:
            states = [CountedText(t.as_py() or "", count, size).state() for t in batch.column(1)]
            yield _states(batch.column(0), batch.column(1), states)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, struct_of(STATE))


def _states(ids, texts, states) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [ids, texts, pa.array([s[0] for s in states], kind), pa.array([s[1] for s in states], kind)],
        names=["doc_id", "text", "chars", "tokens"],
    )


def apply_edits(states: DataFrame, edits: DataFrame, path: str, pattern: str, size: int = SEGMENT) -> DataFrame:
    """``states`` after ``edits`` (``doc_id``, ``step``, ``at``, ``removed``, ``inserted``), in order of ``step``.

    Edits of one document depend on each other, so they come together; documents
    without edits are not encoded again.
    """
    step = F.struct("step", "at", "removed", F.coalesce("inserted", F.lit("")).alias("inserted"))
    known = edits.where("doc_id IS NOT NULL AND step IS NOT NULL AND at IS NOT NULL AND removed IS NOT NULL")
    listed = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(step)).alias("edits"))
    rows = states.join(listed, "doc_id", "left").select("doc_id", "text", "chars", "tokens", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_count(path, pattern)
        for batch in batches:
            texts, states_ = [], []
            for row in batch.slice(0).to_pylist():
                text, state = row["text"], (row["chars"], row["tokens"])
                if row["edits"]:
                    held = CountedText(text or "", count, size, state if state[0] else None)
                    for edit in row["edits"]:
                        held.edit(edit["at"], edit["removed"], edit["inserted"])
                    text, state = held.text, held.state()
                texts.append(text)
                states_.append(state)
            yield _states(batch.column(0), pa.array(texts, pa.string()), states_)

    return rows.mapInArrow(run, struct_of(STATE))
