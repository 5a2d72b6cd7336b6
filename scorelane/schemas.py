"""Column layouts and the fixed values every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# They must be exactly these for results to match.
ANSWER_SUFFIX = "<|end|><|endoftext|>"
STOP_MARKERS = ("<|end|>", "<|endoftext|>")
AUDIO_MARKER = "<|audio_1|>"
NO_HINT = "No binary prediction"
IGNORE_ID = -100
PAD_ID = 0
DEFAULT_FORM = "1764"
OTHER_FORM = "1964"

AUDIO = T.StructType(
    [
        T.StructField("array", T.ArrayType(T.FloatType())),
        T.StructField("sampling_rate", T.IntegerType()),
        T.StructField("path", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("speaker_id", T.LongType()),
        T.StructField("form_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("grade", T.DoubleType()),
        T.StructField("audio", AUDIO),
        T.StructField("asr_transcription", T.StringType()),
        T.StructField("delivery", T.StringType()),
        T.StructField("relevance", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("subset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("revision", T.LongType()),
    ]
)

TEXT_PAIR = T.StructType(
    [
        T.StructField("prediction", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

METRIC_NAMES = (
    "accuracy",
    "absolute_accuracy",
    "binary_accuracy",
    "probability_mse",
    "probability_accuracy",
    "combined_score",
)

# A result document holds one run, or one slice of it that starts at first_id.
RESULT_DOCUMENT = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("predictions_and_labels", T.ArrayType(TEXT_PAIR)),
        T.StructField("samples", T.ArrayType(TEXT_PAIR)),
        T.StructField("all_generated_texts", T.ArrayType(T.StringType())),
        T.StructField("all_labels", T.ArrayType(T.StringType())),
        *[T.StructField(name, T.DoubleType()) for name in METRIC_NAMES],
        T.StructField("num_samples", T.LongType()),
    ]
)

HINT_MAP = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("binary_predictions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("form_id", T.StringType()),
        T.StructField("audio_column", T.StringType()),
    ]
)

CATALOGUE_ENTRY = T.StructType(
    [
        T.StructField("binary_preds_path", T.StringType()),
        T.StructField("form_id", T.StringType()),
        T.StructField("audio_column", T.StringType()),
        T.StructField("accuracy_metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

CATALOGUE = T.MapType(T.StringType(), CATALOGUE_ENTRY)
