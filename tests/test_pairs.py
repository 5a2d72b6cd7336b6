import random
import re

from helpers import column
from pyspark.sql import functions as F

from scorelane.functions.pairs import (
    grade_to_pair,
    is_pair,
    normalise_pair_text,
    pair_text,
    parse_label_pair,
    parse_pair,
)

PAIRS = {
    "1,0.95\n(text)": (1, 0.95),
    "0, 0.80": (0, 0.80),
    " 1,0.75 ": (1, 0.75),
    "1,1": (1, 1.0),
    "1\u2003,\u30000.5": (1, 0.5),
    "7,0.50": (7, 0.50),
    "-1,0.5": (-1, 0.5),
    "1,0.85,0.1": (1, 0.85),
    "4.5": (1, 0.75),
    "4.5 or so": (1, 0.75),
    '"3.0"': (0, 0.25),
    "4.5,": None,
    "1,": None,
    ",0.5": None,
    "1.0,0.5": None,
    "sorry, no": None,
    "sorry": None,
    "": None,
    None: None,
}


def read(spark, texts, function):
    def found(text):
        pair = function(text)
        return F.when(is_pair(pair), F.struct(pair["label"], pair["prob"]))

    return [None if row is None else tuple(row) for row in column(spark, texts, found)]


def test_pairs_are_read_from_noisy_text(spark):
    assert read(spark, list(PAIRS), parse_pair) == list(PAIRS.values())


def test_labels_have_nothing_behind(spark):
    texts = ["1,0.95", " 0,0.70\n", "1,0.95\n(text)", "4.0", "x"]
    expected = [(1, 0.95), (0, 0.70), None, (1, 0.75), None]
    assert read(spark, texts, parse_label_pair) == expected


# Fixed values below: the pattern of a pair, its quotes, and the two older probabilities.
def by_rule(text):
    """The reading rule, stated over Python strings."""
    text = text.strip()
    number = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*")
    if "," in text:
        exact = re.match(r"\d+,\d+\.\d+", text)
        label, prob = (exact.group(0) if exact else text).split(",", 1)
        if re.fullmatch(r"\s*[+-]?\d+\s*", label) and number.fullmatch(prob):
            return int(label), float(prob)
        return None
    word = text.split(" ")[0].strip("\"',\\/")
    if not number.fullmatch(word):
        return None
    return (1, 0.75) if float(word) >= 4 else (0, 0.25)


def test_pairs_agree_with_the_rule_on_random_text(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices("0123459.., \n\u2003\"'-+ex", k=rng.randint(0, 9))) for _ in range(5000)]
    assert read(spark, texts, parse_pair) == [by_rule(text) for text in texts]


def test_reading_a_formatted_pair_gives_it_back(spark):
    grades = [k / 2 for k in range(0, 11)]
    text = column(spark, grades, lambda g: pair_text(grade_to_pair(g)), "double")
    assert column(spark, text, lambda t: pair_text(parse_pair(t))) == text


def test_single_answers_are_normalised(spark):
    cases = {
        " 1,0.955\n(sure)": "1,0.95",
        "0,0.615": "0,0.61",
        "1,1": "1,1.00",
        "4.5": "1,0.75",
        "3": "0,0.25",
        "4.5 or so": "4.5 or so",
        '"4.5"': '"4.5"',
        " no idea, sorry ": "no idea, sorry",
    }
    expected = [f"1,{0.955:.2f}", *list(cases.values())[1:]]
    assert column(spark, list(cases), normalise_pair_text) == expected
