"""Pass/fail pairs: a label with its probability, as struct and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelane.functions.scores import (
    ANY_SPACE,
    OUTER_SPACE,
    PLAIN_NUMBER,
    decimal_text,
    extract_number,
    parse_number,
    parse_score,
    strip_space,
)

# Fixed values.
PASS_GRADE = 4.0
LABEL_OF_PAIR = rf"^{OUTER_SPACE}([+-]?\d+){ANY_SPACE},"
PROB_OF_PAIR = rf"^[^,]*,{ANY_SPACE}{PLAIN_NUMBER}{OUTER_SPACE}\z"
PROB_BEFORE_WORDS = rf"^{OUTER_SPACE}\d+,(\d+\.\d+)"
LEGACY_PASS_PROB = 0.75
LEGACY_FAIL_PROB = 0.25
PROB_TOLERANCE = 0.1
LABEL_WEIGHT = 0.7
PROB_WEIGHT = 0.3

# Probability up to a grade, and the two sloped pieces.
PROB_UP_TO_1 = 0.99
PROB_UP_TO_2 = 0.80
PROB_UP_TO_3 = 0.70
PROB_BEFORE_4 = 0.30
PROB_AT_4 = 0.65
PROB_RISE_TO_5 = 0.20
PROB_FROM_5 = 0.95


def _pair(label: Column, prob: Column) -> Column:
    return F.struct(label.cast("bigint").alias("label"), prob.alias("prob"))


def is_pair(pair: Column) -> Column:
    """Whether both halves could be read."""
    return pair["label"].isNotNull() & pair["prob"].isNotNull()


def grade_to_pair(grade: Column) -> Column:
    """The pass label of a grade, with the confidence in that label."""
    falling = F.lit(PROB_UP_TO_3) - (grade - 3.0) * F.lit(PROB_UP_TO_3 - PROB_BEFORE_4)
    rising = F.lit(PROB_AT_4) + (grade - 4.0) * F.lit(PROB_RISE_TO_5)
    prob = (
        F.when(grade <= 1.0, PROB_UP_TO_1)
        .when(grade <= 2.0, PROB_UP_TO_2)
        .when(grade <= 3.0, PROB_UP_TO_3)
        .when(grade < 4.0, falling)
        .when(grade < 5.0, rising)
        .when(grade >= 5.0, PROB_FROM_5)
    )
    return _pair(grade >= PASS_GRADE, prob)


def pair_text(pair: Column) -> Column:
    """``label,0.dd``; null unless both halves are there."""
    return F.concat(pair["label"].cast("string"), F.lit(","), decimal_text(pair["prob"], 2))


def _legacy_prob(score: Column) -> Column:
    return F.when(score >= PASS_GRADE, LEGACY_PASS_PROB).when(
        score < PASS_GRADE, LEGACY_FAIL_PROB
    )


def _read(text: Column, cut: bool, words: bool) -> Column:
    """A pair from a text with a comma, or a plain score as older models answered.

    ``cut`` ignores what follows the probability; ``words`` ignores what
    follows the first word of a plain score. The patterns skip outer white
    space, so that only the rare text without comma is trimmed.
    """
    comma = text.contains(",")
    label = F.regexp_extract(text, LABEL_OF_PAIR, 1).try_cast("bigint")
    prob = extract_number(text, PROB_OF_PAIR)
    if cut:
        prob = F.coalesce(extract_number(text, PROB_BEFORE_WORDS), prob)
    stripped = strip_space(text)
    score = parse_score(stripped) if words else parse_number(stripped)
    return _pair(
        F.when(comma, label).otherwise((score >= PASS_GRADE).cast("bigint")),
        F.when(comma, prob).otherwise(_legacy_prob(score)),
    )


def parse_pair(text: Column) -> Column:
    """The pair in a model's answer; only a text without comma is read as a score.

    Either half may be null: such an answer is no pair (``is_pair``).
    """
    return _read(text, cut=True, words=True)


def parse_label_pair(text: Column) -> Column:
    """The pair in a label, which has nothing after it."""
    return _read(text, cut=False, words=True)


def normalise_pair_text(text: Column) -> Column:
    """One answer as clean pair text; an answer that is neither pair nor score is only stripped."""
    return F.coalesce(pair_text(_read(text, cut=True, words=False)), strip_space(text))
