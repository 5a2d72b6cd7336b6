"""Published metrics, recomputed from counts of their prediction and label texts."""

import pytest
from pyspark.sql import functions as F

from scorelane.operators.metrics import metrics

SCORES_90 = """2.0|2.0|1 ; 2.0|2.5|1 ; 2.5|2.0|1 ; 2.5|2.5|4 ; 2.5|3.0|2 ; 3.0|2.5|4 ; 3.0|3.0|18 ;
3.0|3.5|5 ; 3.0|4.0|2 ; 3.5|3.0|3 ; 3.5|3.5|6 ; 3.5|4.0|8 ; 4.0|3.5|3 ; 4.0|4.0|16 ; 4.0|4.5|5 ;
4.5|4.0|3 ; 4.5|4.5|5 ; 4.5|5.0|3"""
SCORES_300 = """2.5|2.5|2 ; 2.5|3.0|4 ; 3.0|2.5|2 ; 3.0|3.0|69 ; 3.0|3.5|28 ; 3.0|4.0|6 ; 3.5|3.0|9 ;
3.5|3.5|19 ; 3.5|4.0|17 ; 3.5|4.5|1 ; 4.0|3.0|4 ; 4.0|3.5|9 ; 4.0|4.0|70 ; 4.0|4.5|19 ; 4.5|4.0|8 ;
4.5|4.5|16 ; 4.5|5.0|16 ; 5.0|5.0|1"""
PAIRS_90 = """0,0.50|0,0.50|9 ; 0,0.50|0,0.70|5 ; 0,0.50|0,0.80|1 ; 0,0.50|1,0.65|8 ; 0,0.70|0,0.50|3 ;
0,0.70|0,0.70|26 ; 0,0.70|0,0.80|1 ; 0,0.70|1,0.65|2 ; 1,0.65|0,0.50|2 ; 1,0.65|0,0.70|1 ;
1,0.65|1,0.65|15 ; 1,0.65|1,0.75|4 ; 1,0.75|1,0.65|4 ; 1,0.75|1,0.75|6 ; 1,0.75|1,0.95|3"""
NOISY_90 = """3.0|2.0|1 ; 3.0|2.5|6 ; 3.0|3.0|15 ; 3.0|3.5|10 ; 3.0|4.0|16 ; 3.0|4.5|8 ; 3.0|5.0|3 ;
3.2|2.5|1 ; 3.2|3.0|5 ; 3.2|3.5|1 ; 3.2|4.0|2 ; 3.5|2.5|1 ; 3.5|3.0|3 ; 3.5|3.5|2 ; 3.5|4.0|8 ;
3.5|4.5|2 ; 4.0|4.0|1 ; X|2.0|1 ; X|2.5|1 ; X|3.5|1 ; X|4.0|2"""

SCORE_NAMES = ("accuracy", "absolute_accuracy", "binary_accuracy")
PAIR_NAMES = ("binary_accuracy", "probability_mse", "probability_accuracy", "combined_score")

CASES = [
    (SCORES_90, "score", dict(zip(SCORE_NAMES, (0.9777777777777777, 0.7555555555555555, 0.8555555555555555)))),
    (SCORES_300, "score", dict(zip(SCORE_NAMES, (0.9633333333333334, 0.8033333333333333, 0.8766666666666667)))),
    (NOISY_90, "score", dict(zip(SCORE_NAMES, (0.5666666666666667, 0.4111111111111111, 0.5111111111111111)))),
    (PAIRS_90, "pair", dict(zip(PAIR_NAMES, (0.8555555555555555, 0.00947222222222222, 0.7444444444444445, 0.8222222222222222)))),
]


def rows_of(spark, counts):
    cells = [cell.strip().split("|") for cell in counts.split(";")]
    table = spark.createDataFrame(
        [(p, label, int(n)) for p, label, n in cells], "prediction string, label string, n int"
    )
    return table.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))


@pytest.mark.parametrize("counts, mode, expected", CASES)
def test_published_metrics(spark, counts, mode, expected):
    found = metrics(rows_of(spark, counts), mode=mode).first()
    assert found.num_samples == sum(int(cell.split("|")[2]) for cell in counts.split(";"))
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, abs=1e-12), name


def test_no_pair_is_a_plain_score(spark):
    assert metrics(rows_of(spark, PAIRS_90), mode="pair").first().accuracy == 0


def test_metrics_do_not_depend_on_partitions(spark):
    rows = rows_of(spark, NOISY_90)
    parts = [metrics(rows.repartition(n)).collect() for n in (1, 3, 8)]
    assert parts[0] == parts[1] == parts[2]
