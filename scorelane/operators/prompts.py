"""Prompts, chat templates, and the example tables that use them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.functions.pairs import grade_to_pair, pair_text
from scorelane.functions.text import add_suffix
from scorelane.operators.hints import HINT_KEYS, attach_hints
from scorelane.operators.position import whole_part, with_position
from scorelane.schemas import AUDIO_MARKER
from scorelane.sources.responses import optional_question, require_columns

HINT_PLACE = "{hint}"
EXAMPLES_PLACE = "{examples}"
VARIANTS = ("audio_first", "question_first", "no_question", "single", "one_line")

# The wording is ours; callers whose model was trained on other words pass their own.
SCORE_RUBRIC = (
    "Grade the spoken English in the recording. Weigh accuracy, fluency, prosody, "
    "completeness, and how well it answers the question.\n"
    "5: natural and fluent. 4: small errors, always clear. 3: slow, some errors, clear. "
    "2: frequent errors and pauses. 1: hard to follow. 0: no answer.\n"
    "{examples}Answer with one number from 0 to 5 with one decimal, such as 3.0.\n"
)
PAIR_RUBRIC = (
    "Decide whether the spoken English in the recording meets the pass standard. Weigh "
    "accuracy, fluency, prosody, completeness, and how well it answers the question.\n"
    "{examples}Answer with 1 for a pass or 0 for a fail, a comma, and your confidence in "
    "that label, such as 1,0.85.\n"
)
HINT_RUBRIC = (
    "Grade the spoken English in the recording from 1 to 5. Weigh accuracy, fluency, prosody, "
    "completeness, and how well it answers the question.\n"
    "A first model's pass or fail with its confidence is given as a guide: after 0 a grade "
    "from 1 to 3 is likely, after 1 a grade of 4 or 5.\n"
    "{examples}Answer with one number with one decimal, such as 3.0.\n"
    "First model: {hint}\n"
)
ONE_LINE = "Grade the speaker's English."


def rubric_text(rubric: str = SCORE_RUBRIC, examples: Sequence[str] = ()) -> str:
    """The rubric with worked examples put in, one a line."""
    return rubric.replace(EXAMPLES_PLACE, "".join(f"{example}\n" for example in examples))


def with_hint(rubric: str, hint: Column) -> Column:
    return F.replace(F.lit(rubric), F.lit(HINT_PLACE), hint)


def user_content(rubric: Column, question: Column, variant: str, ask: bool = True) -> Column:
    """The user message. Without ``ask`` the question is left out of any variant."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}, not {variant!r}")
    audio = F.lit(AUDIO_MARKER)
    question = F.coalesce(question, F.lit(""))
    if variant == "one_line":
        return F.concat(audio, F.lit(ONE_LINE))
    if variant == "no_question":
        return F.concat(rubric, audio)
    if not ask:
        return F.concat(rubric, audio, F.lit(" "))
    if variant == "audio_first":
        return F.concat(rubric, audio, question)
    if variant == "question_first":
        return F.concat(rubric, question, audio)
    return F.concat(rubric, audio, F.lit(" "), question)


def chat_message(role: Column, text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.lit("<|"), role, F.lit("|>"), text, F.lit("<|end|>"))


ASSISTANT_START = "<|assistant|>"


def chat_prompt(content: Column) -> Column:
    """A single user message as a prompt that the assistant is to answer."""
    return F.concat(chat_message(F.lit("user"), content), F.lit(ASSISTANT_START))


def chat_templates(
    messages: DataFrame, part_messages: int, key: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Whole conversations as prompts: ``key``, ``part``, ``prompt``.

    Messages are numbered in the order of their turn, those of one turn in that of
    role and text. Each ``part_messages`` of them are a part, and parts are to be
    read in their order, so no task gathers a conversation of any length, also if
    turn numbers repeat. The assistant's opening closes the last part.
    """
    if part_messages < 1:
        raise ValueError("a part holds at least one message")
    placed = with_position(messages.select(key, turn, "role", "text"), turn, [key], ties=["role", "text"])
    last = F.col("position") == F.col("total") - 1
    shown = F.concat(
        chat_message(F.col("role"), F.col("text")), F.when(last, ASSISTANT_START).otherwise("")
    )
    part = whole_part(F.col("position"), part_messages)
    gathered = placed.groupBy(key, part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("position", shown.alias("shown")))).alias("_pieces")
    )
    text = F.array_join(F.transform("_pieces", lambda piece: piece["shown"]), "")
    return gathered.select(key, "part", text.alias("prompt"))


def answer_text(grade: Column, target: str) -> Column:
    """What the model should answer: the grade, or its pair."""
    if target == "score":
        return grade.cast("string")
    if target == "pair":
        return pair_text(grade_to_pair(grade))
    raise ValueError(f"target must be score or pair, not {target!r}")


def supervised_examples(
    responses: DataFrame,
    target: str = "score",
    variant: str = "question_first",
    rubric: str | None = None,
    examples: Sequence[str] = (),
    ask: bool = True,
) -> DataFrame:
    """Add ``prompt_text``, ``label`` and ``answer``. A projection, without a shuffle.

    Pair examples may do without a question column, score examples may not.
    """
    if target == "pair":
        responses = optional_question(responses)
    require_columns(responses, ["grade", "prompt"])
    rubric = rubric or (PAIR_RUBRIC if target == "pair" else SCORE_RUBRIC)
    content = user_content(F.lit(rubric_text(rubric, examples)), F.col("prompt"), variant, ask)
    return responses.withColumns(
        {"prompt_text": chat_prompt(content), "label": answer_text(F.col("grade"), target)}
    ).withColumn("answer", add_suffix(F.col("label")))


def hint_examples(
    responses: DataFrame,
    hints: DataFrame,
    keys: Sequence[str] = HINT_KEYS,
    variant: str = "question_first",
    rubric: str = HINT_RUBRIC,
    examples: Sequence[str] = (),
) -> DataFrame:
    """Examples of the second stage: the first stage's prediction is in the prompt."""
    require_columns(responses, ["grade", "prompt", *keys])
    hinted = attach_hints(responses, hints, keys)
    filled = with_hint(rubric_text(rubric, examples), F.col("hint"))
    content = user_content(filled, F.col("prompt"), variant)
    return hinted.withColumns(
        {"prompt_text": chat_prompt(content), "label": answer_text(F.col("grade"), "score")}
    ).withColumn("answer", add_suffix(F.col("label")))
