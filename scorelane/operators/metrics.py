"""Quality metrics: each is a column over counts from one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.functions.pairs import (
    LABEL_WEIGHT,
    PROB_TOLERANCE,
    PROB_WEIGHT,
    is_pair,
    parse_label_pair,
    parse_pair,
)
from scorelane.functions.scores import (
    SCORE_TOLERANCE,
    decimal_text,
    parse_label_score,
    parse_score,
    passes,
    require_score,
    round_half_down,
)
from scorelane.schemas import METRIC_NAMES

METRICS = ("cl", "binary", "both")


def _share(condition: Column) -> Column:
    """Rows that meet the condition among all rows; a null counts as not met."""
    return F.try_divide(F.count_if(condition), F.count("*"))


def _score_metrics(metric: str) -> list[Column]:
    guess, truth = F.col("_guess"), F.col("_truth")
    graded = [
        _share(F.abs(guess - truth) <= SCORE_TOLERANCE).alias("accuracy"),
        _share(round_half_down(guess) == round_half_down(truth)).alias("absolute_accuracy"),
    ]
    passed = [_share(passes(guess) == passes(truth)).alias("binary_accuracy")]
    return {"cl": graded, "binary": passed, "both": graded + passed}[metric]


def _pair_metrics(metric: str) -> list[Column]:
    label, true_label = F.col("_guess_label"), F.col("_true_label")
    prob, true_prob = F.col("_guess_prob"), F.col("_true_prob")
    valid = (
        label.isNotNull() & true_label.isNotNull() & prob.isNotNull() & true_prob.isNotNull()
    )
    gap = F.when(valid, prob - true_prob)
    same = F.when(valid, (label == true_label).cast("double"))
    near = F.when(valid, (F.abs(gap) <= PROB_TOLERANCE).cast("double"))
    plain = [_share(F.abs(F.col("_guess") - F.col("_truth")) <= SCORE_TOLERANCE).alias("accuracy")]
    paired = [
        F.coalesce(F.avg(same), F.lit(0.0)).alias("binary_accuracy"),
        F.avg(gap * gap).alias("probability_mse"),
        F.avg(near).alias("probability_accuracy"),
        (LABEL_WEIGHT * F.avg(same) + PROB_WEIGHT * F.avg(near)).alias("combined_score"),
    ]
    return {"cl": plain, "binary": paired, "both": plain + paired}[metric]


def _parsed(rows: DataFrame, mode: str, metric: str, prediction: str, label: str) -> DataFrame:
    """Rows with what the metrics need, each text read once for all of them."""
    values = {}
    if mode == "score" or metric != "binary":
        values["_guess"] = parse_score(F.col(prediction))
        values["_truth"] = parse_label_score(F.col(label))
    if mode == "pair" and metric != "cl":
        guess, truth = parse_pair(F.col(prediction)), parse_label_pair(F.col(label))
        values.update(_guess_label=guess["label"], _guess_prob=guess["prob"])
        values.update(_true_label=truth["label"], _true_prob=truth["prob"])
    return rows.withColumns(values)


def metrics(
    rows: DataFrame,
    by: Sequence[str] = (),
    mode: str = "score",
    metric: str = "both",
    prediction: str = "prediction",
    label: str = "label",
    failures: bool = False,
) -> DataFrame:
    """One row of metrics per group, and with ``failures`` the counts of ``parse_failures`` beside them.

    Every text is parsed once, and rows are reduced to a handful of sums per
    group before anything is shuffled; a group with most of the rows is as
    cheap as any. In ``score`` mode an answer that cannot be read counts as
    wrong; in ``pair`` mode only readable ones count, but ``num_samples`` has all.
    """
    if mode not in ("score", "pair") or metric not in METRICS:
        raise ValueError(f"unknown mode {mode!r} or metric {metric!r}")
    chosen = _score_metrics(metric) if mode == "score" else _pair_metrics(metric)
    parsed = _parsed(rows, mode, metric, prediction, label)
    if failures:
        parsed = _judged(parsed, prediction, label)
        chosen = [*chosen, *_failures(prediction)]
    return parsed.groupBy(*by).agg(*chosen, F.count("*").alias("num_samples"))


def _judged(parsed: DataFrame, prediction: str, label: str) -> DataFrame:
    """Rows with what tells whether their texts can be read, as far as it is not there already."""
    held = parsed.columns
    return parsed.withColumns(
        {
            "_score": F.col("_guess") if "_guess" in held else parse_score(F.col(prediction)),
            "_label": F.col("_truth") if "_truth" in held else parse_label_score(F.col(label)),
            "_pair": F.struct(F.col("_guess_label").alias("label"), F.col("_guess_prob").alias("prob"))
            if "_guess_label" in held
            else parse_pair(F.col(prediction)),
        }
    )


def _failures(prediction: str) -> list[Column]:
    return [
        F.count_if(F.col("_score").isNull()).alias("no_score"),
        F.count_if(~is_pair(F.col("_pair"))).alias("no_pair"),
        F.count_if(~F.coalesce(F.col(prediction), F.lit("")).contains(",")).alias("no_comma"),
        F.count_if(F.col("_label").isNull()).alias("no_label_score"),
    ]


def metric_sums(
    rows: DataFrame,
    by: Sequence[str] = (),
    mode: str = "score",
    prediction: str = "prediction",
    label: str = "label",
) -> DataFrame:
    """What the metrics of a group follow from, as counts and an exact sum.

    Kept beside a run, the sums of other rows or runs can be added to them
    (``merged_sums``) in any order and grouping, without another look at the texts.
    """
    if mode not in ("score", "pair"):
        raise ValueError(f"unknown mode {mode!r}")
    parsed = _parsed(rows, mode, "both", prediction, label)
    guess, truth = F.col("_guess"), F.col("_truth")
    sums = [F.count("*").alias("num_samples"), F.count_if(F.abs(guess - truth) <= SCORE_TOLERANCE).alias("near_scores")]
    if mode == "score":
        sums += [
            F.count_if(round_half_down(guess) == round_half_down(truth)).alias("same_rounded"),
            F.count_if(passes(guess) == passes(truth)).alias("same_passes"),
        ]
        return parsed.groupBy(*by).agg(*sums)
    label_, true_label = F.col("_guess_label"), F.col("_true_label")
    prob, true_prob = F.col("_guess_prob"), F.col("_true_prob")
    valid = label_.isNotNull() & true_label.isNotNull() & prob.isNotNull() & true_prob.isNotNull()
    gap = F.when(valid, prob - true_prob)
    exact = F.sum((gap * gap).cast("decimal(28,18)"))
    sums += [
        F.count_if(valid).alias("valid"),
        F.count_if(valid & (label_ == true_label)).alias("same_labels"),
        F.count_if(F.abs(gap) <= PROB_TOLERANCE).alias("near_probs"),
        F.coalesce(exact, F.lit(0).cast("decimal(38,18)")).alias("squared_gaps"),
    ]
    return parsed.groupBy(*by).agg(*sums)


def merged_sums(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of several parts or runs, or of a finer grouping, added up per group."""
    names = [name for name, kind in sums.dtypes if name not in by and (kind == "bigint" or kind.startswith("decimal"))]
    added = {name: F.coalesce(F.sum(name), F.lit(0)) for name in names}
    kept = {name: kind for name, kind in sums.dtypes}
    return sums.groupBy(*by).agg(*(value.cast(kept[name]).alias(name) for name, value in added.items()))


def metrics_of_sums(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metrics that ``metrics`` gives, from stored sums."""
    count = F.col("num_samples")

    def share(name: str, of: Column) -> Column:
        return F.try_divide(F.col(name), of)

    if "valid" not in sums.columns:
        found = [
            share("near_scores", count).alias("accuracy"),
            share("same_rounded", count).alias("absolute_accuracy"),
            share("same_passes", count).alias("binary_accuracy"),
        ]
    else:
        valid = F.nullif(F.col("valid"), F.lit(0))
        same, near = share("same_labels", valid), share("near_probs", valid)
        found = [
            share("near_scores", count).alias("accuracy"),
            F.coalesce(same, F.lit(0.0)).alias("binary_accuracy"),
            (F.col("squared_gaps").cast("double") / valid).alias("probability_mse"),
            near.alias("probability_accuracy"),
            (LABEL_WEIGHT * same + PROB_WEIGHT * near).alias("combined_score"),
        ]
    return sums.select(*by, *found, "num_samples")


def adjusted_accuracy(
    rows: DataFrame,
    by: Sequence[str] = (),
    prediction: str = "prediction",
    label: str = "label",
) -> DataFrame:
    """Share of equal rounded scores. A text that is not a whole score fails the job."""
    guess = round_half_down(require_score(F.col(prediction)))
    truth = round_half_down(require_score(F.col(label)))
    same = rows.withColumn("_same", guess == truth)
    return same.groupBy(*by).agg(
        _share(F.col("_same")).alias("adjusted_accuracy"),
        F.count_if("_same").alias("correct"),
        F.count("*").alias("num_samples"),
    )


def parse_failures(
    rows: DataFrame,
    by: Sequence[str] = (),
    prediction: str = "prediction",
    label: str = "label",
) -> DataFrame:
    """How many texts cannot be read: as score, as pair, or for want of a comma."""
    parsed = _judged(rows, prediction, label)
    return parsed.groupBy(*by).agg(*_failures(prediction), F.count("*").alias("num_samples"))


def metrics_long(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per metric. Only numeric metrics are kept, and only those that were computed."""
    numeric = [
        name
        for name, kind in wide.dtypes
        if name not in by and kind in ("double", "float", "bigint", "int")
    ]
    values = wide.select(*by, *[F.col(name).cast("double").alias(name) for name in numeric])
    return values.unpivot(list(by), numeric, "metric", "value").where(F.col("value").isNotNull())


def metric_report(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """The long form with a line of text per metric, at four decimals."""
    line = F.concat(F.upper("metric"), F.lit(": "), decimal_text(F.col("value"), 4))
    return metrics_long(wide, by).withColumn("line", line)


def compare_runs(
    before: DataFrame, after: DataFrame, by: Sequence[str], metric_names: Sequence[str] = METRIC_NAMES
) -> DataFrame:
    """Metrics of two runs side by side, with the change."""
    runs = [
        metrics_long(wide, by).withColumn("_run", F.lit(name))
        for name, wide in (("before", before), ("after", after))
    ]
    both = runs[0].unionByName(runs[1]).where(F.col("metric").isin(list(metric_names)))
    side_by_side = both.groupBy(*by, "metric").pivot("_run", ["before", "after"]).agg(F.first("value"))
    return side_by_side.withColumn("change", F.col("after") - F.col("before"))
