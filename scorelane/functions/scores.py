"""Scores: reading them from model text, rounding and pass marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
QUOTE_CHARS = "\"',\\/"
PLAIN_NUMBER = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
ANY_SPACE = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
OUTER_SPACE = ANY_SPACE.replace(r"\s", r"\s\x1c-\x1f")
NUMBER = rf"^{ANY_SPACE}{PLAIN_NUMBER}{ANY_SPACE}\z"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SCORE_TOLERANCE = 0.5
PASS_ABOVE = 3.0


def strip_space(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def extract_number(text: Column, pattern: str) -> Column:
    """The first group of the pattern as a double, or null.

    Spark's cast alone would also take ``3f`` and ``nan``; the pattern decides
    what is a number, and the text is looked at once.
    """
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def parse_number(text: Column) -> Column:
    """The text as a double, or null where it is not one plain number."""
    return extract_number(text, NUMBER)


def parse_score(text: Column) -> Column:
    """The score at the start of a model's answer, or null."""
    first_word = F.substring_index(text, " ", 1)
    return parse_number(F.btrim(first_word, F.lit(QUOTE_CHARS)))


def parse_label_score(text: Column) -> Column:
    """The score of a label, which is never quoted."""
    return parse_number(F.substring_index(text, " ", 1))


def require_score(text: Column) -> Column:
    """The whole text as a score; a text that is none fails the job."""
    problem = F.raise_error(F.concat(F.lit("not a score: "), F.coalesce(text, F.lit("null"))))
    return F.coalesce(parse_number(text), problem.cast("double"))


def round_half_down(score: Column) -> Column:
    """Round so that a fraction up to one half is dropped. Stays a double.

    An infinite score has no fraction and gives null.
    """
    fraction = score % F.lit(1.0)
    return score - fraction + F.when(fraction <= 0.5, 0.0).when(fraction < 1.0, 1.0)


def passes(score: Column) -> Column:
    """Pass mark of score mode: the rounded score is above three."""
    return round_half_down(score) > PASS_ABOVE


def decimal_text(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals, rounded on its exact binary value.

    ``format_string`` would round its shortest decimal form instead, and turn
    0.615 (stored as 0.61499...) into 0.62.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))
