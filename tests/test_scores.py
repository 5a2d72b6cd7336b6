import random

import pytest
from helpers import column

from scorelane.functions.pairs import grade_to_pair, pair_text
from scorelane.functions.scores import (
    decimal_text,
    parse_label_score,
    parse_number,
    parse_score,
    passes,
    require_score,
    round_half_down,
    strip_space,
)

SCORES = {
    "4.5,": 4.5,
    '"4.0"': 4.0,
    "'3.5'": 3.5,
    "\\3.5/": 3.5,
    "3.5 out of 5": 3.5,
    " 3.5": None,
    "": None,
    "0,0.70": None,
    "3.5/10": None,
    "+4": 4.0,
    "-1.5": -1.5,
    ".5": 0.5,
    "5.": 5.0,
    "1e1": 10.0,
    "1e": None,
    "3.0\n": 3.0,
    "3.0\n\n": 3.0,
    "3.0\u3000": 3.0,
    "\x1c4": None,
    "3f": None,
    "3.0d": None,
    "0x1p3": None,
    "nan": None,
    "inf": None,
    "1_0": None,
    "I cannot tell": None,
    ".": None,
    None: None,
}


def test_scores_are_read_from_noisy_text(spark):
    assert column(spark, list(SCORES), parse_score) == list(SCORES.values())


def test_labels_are_not_unquoted(spark):
    texts = ["3.5", "3.5 x", '"3.5"', "4.0,"]
    assert column(spark, texts, parse_label_score) == [3.5, 3.5, None, None]


def test_numbers_agree_with_python(spark):
    """Every text the pattern admits is the number that Python reads."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789.eE+- \n\t\x1c", k=rng.randint(0, 6))) for _ in range(4000)]

    def read(text):
        try:
            return float(text)
        except ValueError:
            return None

    assert column(spark, texts, parse_number) == [read(text) for text in texts]


def test_white_space_of_every_kind_is_stripped(spark):
    texts = ["\u3000 1,0.5\x85\n", "\t\x0b\x0c\x1c a b \u2009", "plain", ""]
    assert column(spark, texts, strip_space) == [text.strip() for text in texts]


def test_half_is_rounded_down(spark):
    cases = {3.5: 3.0, 3.6: 4.0, 4.0: 4.0, 2.51: 3.0, 0.5: 0.0, 0.6: 1.0, -1.6: -1.0, 5.0: 5.0}
    assert column(spark, list(cases), round_half_down, "double") == list(cases.values())


def test_rounding_agrees_with_python(spark):
    rng = random.Random(7)
    values = [rng.uniform(-50, 50) for _ in range(2000)] + [k / 4 for k in range(-40, 40)]
    values += [1e18, -3e25, 2.0**53 - 0.5]

    def expected(value):
        return float(int(value) if value - int(value) <= 0.5 else int(value) + 1)

    assert column(spark, values, round_half_down, "double") == [expected(v) for v in values]


def test_infinite_scores_are_not_rounded(spark):
    values = [float("inf"), float("-inf"), float("nan")]
    assert column(spark, values, round_half_down, "double") == [None, None, None]
    assert column(spark, values, passes, "double") == [None, None, None]


def test_the_two_pass_marks_differ_between_grades(spark):
    grades = [3.0, 3.5, 3.6, 3.99, 4.0]
    assert column(spark, grades, passes, "double") == [False, False, True, True, True]
    by_pair = column(spark, grades, lambda g: grade_to_pair(g)["label"], "double")
    assert by_pair == [0, 0, 0, 0, 1]


GRADES = {
    0.0: "0,0.99",
    1.0: "0,0.99",
    1.5: "0,0.80",
    2.0: "0,0.80",
    2.5: "0,0.70",
    3.0: "0,0.70",
    3.2: "0,0.62",
    3.5: "0,0.50",
    3.75: "0,0.40",
    3.99: "0,0.30",
    4.0: "1,0.65",
    4.25: "1,0.70",
    4.5: "1,0.75",
    5.0: "1,0.95",
    None: None,
}


def test_grades_become_pairs(spark):
    assert column(spark, list(GRADES), lambda g: pair_text(grade_to_pair(g)), "double") == list(
        GRADES.values()
    )


def test_decimals_are_rounded_on_the_stored_value(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 9999) / 1000 for _ in range(5000)]
    values += [k / 8 for k in range(-20, 60)] + [-0.0, -0.001, 0.005, 1e12 + 0.125]
    assert column(spark, values, lambda v: decimal_text(v, 2), "double") == [f"{v:.2f}" for v in values]
    assert column(spark, values, lambda v: decimal_text(v, 4), "double") == [f"{v:.4f}" for v in values]


def test_a_strict_score_fails_the_job(spark):
    assert column(spark, ["3.5", "4\n"], require_score) == [3.5, 4.0]
    for bad in ["3.5 of 5", "", None]:
        with pytest.raises(Exception, match="not a score"):
            column(spark, [bad], require_score)
