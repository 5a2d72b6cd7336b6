"""Token and audio arrays: padding, masks, labels and cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelane.schemas import IGNORE_ID, PAD_ID


def pad(values: Column, width: Column, fill: Column, side: str = "right") -> Column:
    """``values`` brought to ``width`` with ``fill`` on one side."""
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, not {side!r}")
    missing = F.array_repeat(fill, (width - F.size(values)).cast("int"))
    return F.concat(missing, values) if side == "left" else F.concat(values, missing)


def pad_ids(ids: Column, width: Column, side: str = "left") -> Column:
    return pad(ids, width, F.lit(PAD_ID).cast("bigint"), side)


def pad_block(values: Column, sizes: Sequence[Column], fill: Column) -> Column:
    """A nested array of any rank brought to ``sizes``, one for each dimension from the outermost.

    ``fill`` is the value that is put in; whole rows and planes of it where one is missing.
    Blocks that are to be joined along a dimension keep their own size there.
    """
    if len(sizes) == 1:
        return pad(values, sizes[0], fill)
    row = fill
    for size in reversed(sizes[1:]):
        row = F.array_repeat(row, size.cast("int"))
    return pad(F.transform(values, lambda inner: pad_block(inner, sizes[1:], fill)), sizes[0], row)


def block_sizes(values: Column, rank: int) -> list[Column]:
    """The size of a nested array of ``rank`` dimensions: in each the longest array there, 0 if none."""
    sizes, level = [F.greatest(F.size(values), F.lit(0))], values
    for depth in range(1, rank):
        longest = F.array_max(F.transform(level, lambda inner: F.size(inner)))
        sizes.append(F.greatest(F.coalesce(longest, F.lit(0)), F.lit(0)))
        if depth + 1 < rank:
            level = F.flatten(level)
    return sizes


def pad_frames(frames: Column, rows: Column, columns: Column) -> Column:
    """A list of frames brought to ``rows`` frames of ``columns`` values each."""
    return pad_block(frames, [rows, columns], F.lit(0.0).cast("float"))


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda token: (token != PAD_ID).cast("int"))


def length_mask(length: Column, width: Column) -> Column:
    """True for each own frame, then false up to ``width``."""
    own = F.array_repeat(F.lit(True), length.cast("int"))
    return F.concat(own, F.array_repeat(F.lit(False), (width - length).cast("int")))


def training_ids(prompt_ids: Column, answer_ids: Column) -> Column:
    return F.concat(prompt_ids, answer_ids)


def _ignored(ids: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE_ID).cast("bigint"), F.size(ids))


def training_labels(prompt_ids: Column, answer_ids: Column) -> Column:
    """The answer, behind a stretch that the loss ignores."""
    return F.concat(_ignored(prompt_ids), answer_ids)


def evaluation_labels(prompt_ids: Column, answer_ids: Column) -> Column:
    """The answer alone; where it is empty, all of the prompt is ignored."""
    return F.when(F.size(answer_ids) == 0, _ignored(prompt_ids)).otherwise(answer_ids)


def drop_pad(ids: Column) -> Column:
    return F.array_remove(ids, F.lit(PAD_ID).cast("bigint"))


def cut_generated(ids: Column, prompt_length: Column, stop_ids: Sequence[int]) -> Column:
    """What was generated behind the prompt, up to the first stop id if there is one."""
    generated = F.slice(ids, prompt_length + 1, F.greatest(F.size(ids) - prompt_length, F.lit(0)))
    found = [F.array_position(generated, F.lit(stop).cast("bigint")) for stop in stop_ids]
    places = [F.nullif(place, F.lit(0)) for place in found]
    first = (F.least(*places) if len(places) > 1 else places[0]).cast("int")
    return F.when(first > 0, F.slice(generated, 1, first - 1)).otherwise(generated)


def stop_automaton(stops: Sequence[Sequence[int]]) -> tuple[list[int], list[list[int]], list[int]]:
    """What follows several stop sequences at once: the ids in them, a table of states, and lengths.

    A state stands for the longest beginning of a stop that the ids read so far end
    with. Its row in the table has the next state for any other id, and then for each
    id of the stops; its length is that of the longest stop that ends there, or 0.
    """
    alphabet = sorted({token for stop in stops for token in stop})
    states: dict[tuple[int, ...], int] = {}
    for stop in stops:
        for end in range(len(stop) + 1):
            states.setdefault(tuple(stop[:end]), len(states))

    def longest(read: tuple[int, ...]) -> int:
        return next(states[read[cut:]] for cut in range(len(read) + 1) if read[cut:] in states)

    table = [[0, *(longest((*held, token)) for token in alphabet)] for held in states]
    whole = {tuple(stop) for stop in stops}
    lengths = [max((len(held[cut:]) for cut in range(len(held)) if held[cut:] in whole), default=0) for held in states]
    return alphabet, table, lengths


def cut_at_sequences(
    ids: Column, prompt_length: Column, stops: Sequence[Sequence[int]], pad_id: int | None = PAD_ID
) -> Column:
    """What was generated behind the prompt, up to the stop sequence that is complete first.

    Stops of different lengths may come padded with ``pad_id``, which is not part of
    them; ``None`` where no id is padding. Of stops that are complete at one id the
    longest counts. A stop does not begin in the prompt. The ids are read once, however
    many stops there are; a null among them is no id of a stop.
    """
    bare = [tuple(token for token in stop if token != pad_id) for stop in stops]
    if not bare or not all(bare):
        raise ValueError("a stop sequence has at least one id that is not padding")
    alphabet, table, lengths = stop_automaton(bare)
    generated = F.slice(ids, prompt_length + 1, F.greatest(F.size(ids) - prompt_length, F.lit(0)))
    known = F.array(*(F.lit(token).cast("bigint") for token in alphabet))
    rows = F.array(*(F.array(*(F.lit(state) for state in row)) for row in table))
    ends = F.array(*(F.lit(length) for length in lengths))

    def step(now: Column, token: Column) -> Column:
        place = F.coalesce(F.array_position(known, token.cast("bigint")), F.lit(0)).cast("int")
        state = F.get(F.get(rows, now["state"]), place)
        read = now["read"] + 1
        found = F.when(F.get(ends, state) > 0, read - F.get(ends, state))
        return F.struct(
            state.alias("state"), read.alias("read"), F.coalesce(now["kept"], found).alias("kept")
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("kept"))
    kept = F.aggregate(generated, start, step, lambda last: last["kept"])
    return F.when(kept.isNotNull(), F.slice(generated, 1, kept)).otherwise(generated)
