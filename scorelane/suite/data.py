"""Response sets, predictions and token rows derived from the test tables.

``events`` stands for graded responses, ``documents`` for texts to batch,
``embeddings`` for audio. The derivations use integers until the last step, so
that both engines get the same text. ``sql.py`` states them a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.functions.pairs import grade_to_pair, pair_text
from scorelane.operators.position import whole_part

STOP_IDS = (9, 13)
#: Stop sequences, padded on the right to one length.
STOPS = ((4, 2, 0), (2, 6, 2), (5, 0, 0), (3, 2, 6))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Graded responses with the score a model would be near, in tenths."""
    grade10 = 10 + 5 * (F.floor("value") % 9)
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        table(spark, folder, "events")
        .select(
            F.col("event_id").alias("sample_id"),
            F.col("user_id").alias("speaker_id"),
            F.col("event_type").alias("dataset"),
            F.when(F.col("user_id") % 3 == 0, "dev").otherwise("train").alias("split"),
            (F.col("user_id") % 4).alias("revision"),
            F.col("props").alias("prompt"),
            grade10.alias("grade10"),
            cents.alias("cents"),
        )
        .withColumn("grade", F.col("grade10") / 10)
        .withColumn(
            "tenths",
            F.greatest(
                F.lit(0), F.least(F.lit(50), F.col("grade10") + F.col("cents") % 21 - 10)
            ).cast("bigint"),
        )
    )


def tenths_text(tenths: Column) -> Column:
    whole = whole_part(tenths, 10).cast("string")
    return F.concat(whole, F.lit("."), (tenths % 10).cast("string"))


def _answer(templates: dict[int, str], usual: str, **texts: Column) -> Column:
    """The template of the first step that divides the id, else the usual one, filled in."""
    shown = F.lit(usual)
    for step, template in reversed(list(templates.items())):
        shown = F.when(F.col("sample_id") % step == 0, template).otherwise(shown)
    for name, text in texts.items():
        shown = F.replace(shown, F.lit(f"{{{name}}}"), text)
    return shown


def score_results(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with scores: some quoted, chatty, shifted by a space, or no score at all."""
    templates = {
        11: "no score",
        7: '"{score}",',
        13: "{score} out of 5",
        17: " {score}",
        19: "{score}\n",
        23: "{score}f",
        29: "{score}/5",
    }
    answer = _answer(templates, "{score}", score=tenths_text(F.col("tenths")))
    return responses(spark, folder).withColumns(
        {"prediction": answer, "label": F.col("grade").cast("string")}
    )


def near_pair(tenths: Column) -> Column:
    """A pair near the grade: surer the lower a fail and the higher a pass."""
    pairs = [f"1,0.{tenth + 25}" if tenth >= 40 else f"0,0.{99 - tenth}" for tenth in range(51)]
    return F.element_at(F.array(*[F.lit(pair) for pair in pairs]), (tenths + 1).cast("int"))


def pair_results(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with pairs: some with words behind, older plain scores, or nothing usable."""
    templates = {
        13: "{pair}\n(sure)",
        17: "{score}",
        19: "sorry",
        23: "sorry, no",
        29: "7,0.50",
        31: " 0, 0.8{digit}5 ",
        37: "{score},",
        41: "{score} or so",
        43: "1,1",
    }
    tenths, digit = F.col("tenths"), (F.col("sample_id") % 10).cast("string")
    answer = _answer(
        templates, "{pair}", pair=near_pair(tenths), score=tenths_text(tenths), digit=digit
    )
    label = pair_text(grade_to_pair(F.col("grade")))
    return responses(spark, folder).withColumns({"prediction": answer, "label": label})


def word_lengths(text: Column) -> Column:
    """Stand-in token ids: the length of each word, 0 between two spaces."""
    return F.transform(F.split(text, " "), lambda word: F.length(word).cast("bigint"))


def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A document's first line as the prompt and the rest as the answer, which may be empty."""
    texts = table(spark, folder, "documents")
    return token_ids(texts.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("dataset"), "text"))


def token_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with prompt and answer ids in place of their ``text``."""
    lines = F.split("text", "\n", 2)
    has_rest = F.size("lines") > 1
    others = [name for name in rows.columns if name != "text"]
    return (
        rows.select(*others, lines.alias("lines"))
        .select(
            *others,
            word_lengths(F.col("lines")[0]).alias("prompt_ids"),
            F.when(has_rest, word_lengths(F.get("lines", F.lit(1))))
            .otherwise(F.array().cast("array<bigint>"))
            .alias("answer_ids"),
        )
    )


def audio_frames(spark: SparkSession, folder: str) -> DataFrame:
    """All values of a vector in frames whose length, 3 to 8, follows from the id; the last is short."""
    width = (F.lit(3) + F.col("vec_id") % 6).cast("int")
    count = F.ceil(F.size("embedding") / width).cast("int")
    frames = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.slice("embedding", i * width + 1, width)
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label", frames.alias("frames")
    )


def audio_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Samples whose audio lies in one of two columns, is a mere path, or is missing.

    ``clip`` is another column, of paths as texts. Some speakers are not known.
    """
    path = F.concat(F.lit("clips/a_"), F.col("vec_id"), F.lit(".wav"))

    def audio(samples: Column, path: Column) -> Column:
        rate = F.when(samples.isNotNull(), 16000)
        return F.struct(
            samples.alias("array"), rate.cast("int").alias("sampling_rate"), path.alias("path")
        )

    nothing = F.lit(None)
    group = F.col("vec_id") % 7
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.when(group != 6, F.col("label").cast("bigint")).alias("speaker_id"),
        (F.lit(1.0) + (F.col("vec_id") % 9) / 2).alias("grade"),
        F.when(group.isin(0, 1, 6), audio(F.col("embedding"), path))
        .when(group.isin(2, 5), audio(nothing.cast("array<float>"), path))
        .alias("wav_path"),
        F.when(group.isin(1, 3, 5), audio(F.col("embedding"), nothing.cast("string"))).alias("audio"),
        F.when(group.isin(0, 2, 5), path).alias("clip"),
        F.concat(F.lit("topic "), F.col("label")).alias("prompt"),
        F.when(F.col("label") > 1, "en").alias("language"),
    )


def ids_text(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")
