"""Column functions: scores, pairs, names, prompts and chat templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.functions.pairs import (
    grade_to_pair,
    is_pair,
    normalise_pair_text,
    pair_text,
    parse_label_pair,
    parse_pair,
)
from scorelane.functions.scores import parse_label_score, parse_score, passes, round_half_down
from scorelane.functions.text import (
    add_suffix,
    dataset_of,
    form_of,
    model_id,
    predictions_path,
    read_result_name,
    remove_markers,
    remove_suffix,
    result_name,
)
from scorelane.operators.hints import attach_hints, hints_from_results
from scorelane.operators.prompts import (
    HINT_RUBRIC,
    ONE_LINE,
    PAIR_RUBRIC,
    SCORE_RUBRIC,
    chat_templates,
    hint_examples,
    rubric_text,
    supervised_examples,
    user_content,
    with_hint,
)
from scorelane.suite import data, sql
from scorelane.suite.registry import query


@query(f"WITH {sql.PARSED_SCORES} SELECT sample_id, prediction, g AS guess, t AS truth FROM parsed")
def parse_scores(spark: SparkSession, folder: str) -> DataFrame:
    return data.score_results(spark, folder).select(
        "sample_id",
        "prediction",
        parse_score(F.col("prediction")).alias("guess"),
        parse_label_score(F.col("label")).alias("truth"),
    )


@query(
    f"""WITH {sql.RESPONSES}, shifted AS (SELECT sample_id, (cents % 1201 - 600) / 100 AS score FROM responses)
SELECT sample_id, score, CAST({sql.half_down('score')} AS DOUBLE) AS rounded,
  CAST({sql.half_down('score')} AS BIGINT) AS rounded_whole,
  {sql.half_down('score')} > 3 AS passed, score >= 4 AS pair_passed
FROM shifted"""
)
def round_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding and both pass marks, on hundredths from -6 to 6."""
    shifted = data.responses(spark, folder).select(
        "sample_id", ((F.col("cents") % 1201 - 600) / 100).alias("score")
    )
    rounded = round_half_down(F.col("score"))
    return shifted.select(
        "sample_id",
        "score",
        (rounded + 0.0).alias("rounded"),
        rounded.cast("bigint").alias("rounded_whole"),
        passes(F.col("score")).alias("passed"),
        (grade_to_pair(F.col("score"))["label"] == 1).alias("pair_passed"),
    )


@query(
    f"""WITH {sql.RESPONSES}, fine AS (SELECT sample_id, (cents % 521) / 100 AS score FROM responses)
SELECT sample_id, score, CAST({sql.pair_label('score')} AS BIGINT) AS label,
  {sql.pair_prob('score')} AS prob, {sql.pair_text('score')} AS answer
FROM fine"""
)
def grades_to_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Label, probability and text of grades in hundredths from 0 to 5.2."""
    fine = data.responses(spark, folder).select(
        "sample_id", ((F.col("cents") % 521) / 100).alias("score")
    )
    pair = grade_to_pair(F.col("score"))
    return fine.select(
        "sample_id",
        "score",
        pair["label"].alias("label"),
        pair["prob"].alias("prob"),
        pair_text(pair).alias("answer"),
    )


@query(
    f"""WITH {sql.PARSED_PAIRS}
SELECT sample_id, prediction, gl AS label, gp AS prob, gl IS NOT NULL AND gp IS NOT NULL AS usable,
  CAST(tl AS BIGINT) AS true_label, tp AS true_prob
FROM parsed"""
)
def parse_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.pair_results(spark, folder).select(
        "sample_id",
        "prediction",
        parse_pair(F.col("prediction")).alias("guess"),
        parse_label_pair(F.col("label")).alias("truth"),
    )
    usable = is_pair(F.col("guess"))
    return rows.select(
        "sample_id",
        "prediction",
        F.when(usable, F.col("guess.label")).alias("label"),
        F.when(usable, F.col("guess.prob")).alias("prob"),
        usable.alias("usable"),
        F.col("truth.label").alias("true_label"),
        F.col("truth.prob").alias("true_prob"),
    )


@query(
    f"""WITH {sql.PARSED_PAIRS}, lone AS (
  SELECT sample_id, prediction, contains(prediction, ',') AS paired, gl, gp,
    trim(prediction, {sql.SPACE}) AS bare, {sql.number('prediction')} AS plain_score FROM parsed
)
SELECT sample_id, CASE
    WHEN paired AND gl IS NOT NULL AND gp IS NOT NULL THEN printf('%d,%.2f', gl, gp)
    WHEN NOT paired AND plain_score >= 4 THEN '1,0.75'
    WHEN NOT paired AND plain_score < 4 THEN '0,0.25'
    ELSE bare END AS answer
FROM lone"""
)
def normalise_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Single answers as clean pair text; three-digit probabilities are rounded exactly."""
    answer = normalise_pair_text(F.col("prediction"))
    return data.pair_results(spark, folder).select("sample_id", answer.alias("answer"))


@query(
    f"""WITH {sql.SCORES}, marked AS (
  SELECT sample_id, label, label || '<|end|><|endoftext|>' AS answer, prediction,
    ' ' || prediction || '<|end|>' || prediction || '<|endoftext|>' || chr(10) AS raw FROM scores
)
SELECT sample_id, answer, label AS restored, prediction AS unmarked,
  trim(replace(replace(raw, '<|end|>', ''), '<|endoftext|>', ''), {sql.SPACE}) AS cleaned
FROM marked"""
)
def answer_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Suffixes put on and taken off again, and markers removed from anywhere in a text."""
    rows = data.score_results(spark, folder)
    prediction = F.col("prediction")
    raw = F.concat(
        F.lit(" "), prediction, F.lit("<|end|>"), prediction, F.lit("<|endoftext|>\n")
    )
    answer = add_suffix(F.col("label"))
    return rows.select(
        "sample_id",
        answer.alias("answer"),
        remove_suffix(answer).alias("restored"),
        remove_suffix(prediction).alias("unmarked"),
        remove_markers(raw).alias("cleaned"),
    )


_PATH = """'eval_results/binary_results_' || dataset || CASE WHEN speaker_id % 2 = 0
  THEN '_1964' ELSE '' END || '_' || split || '.json'"""


@query(
    f"""WITH {sql.RESPONSES}, paths AS (SELECT DISTINCT {_PATH} AS path FROM responses)
SELECT path, CASE WHEN contains(path, '1964') THEN '1964' ELSE '1764' END AS form_id,
  CASE WHEN contains(path, 'sign') THEN 'org/Signup' WHEN contains(path, '1964') THEN 'org/Other'
       ELSE 'org/Default' END AS dataset,
  'eval_results/binary_preds' || substr(path, length('eval_results/binary_results') + 1) AS preds,
  CASE WHEN contains(path, '1964') THEN 'org/base_1964' ELSE 'org/mine' END AS model
FROM paths"""
)
def names_from_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Form, dataset, predictions path and model id that follow from a result path."""
    year = F.when(F.col("speaker_id") % 2 == 0, "_1964").otherwise("")
    path = F.concat(
        F.lit("eval_results/binary_results_"), "dataset", year, F.lit("_"), "split", F.lit(".json")
    )
    paths = data.responses(spark, folder).select(path.alias("path")).distinct()
    path, form = F.col("path"), form_of(F.col("path"))
    asked = F.when(form == "1964", "org/base").otherwise("org/mine")
    return paths.select(
        "path",
        form.alias("form_id"),
        dataset_of(path, {"sign": "org/Signup", "1964": "org/Other"}, "org/Default").alias("dataset"),
        predictions_path(path).alias("preds"),
        model_id(asked, "org/base", form).alias("model"),
    )


@query(
    f"""WITH {sql.RESPONSES}
SELECT DISTINCT 'near_model_' || dataset || '_' || split || '_binary.json' AS name,
  'near_model' AS model, dataset, split, 'near_model_' || dataset || '_' || split || '.json' AS plain
FROM responses"""
)
def result_names(spark: SparkSession, folder: str) -> DataFrame:
    """Result names of runs, and the runs read back from them."""
    runs = data.responses(spark, folder).select("dataset", "split").distinct()
    dataset = F.concat(F.lit("org/"), F.col("dataset"))
    named = runs.select(
        result_name(F.lit("org/near_model"), dataset, F.col("split"), "_binary").alias("name"),
        result_name(F.lit("org/near_model"), dataset, F.col("split")).alias("plain"),
    )
    known = ["click", "error", "purchase", "signup", "view"]
    run = read_result_name(F.col("name"), known, ["dev", "train"], ["_binary"])
    return named.select("name", "plain", run.alias("run")).select("name", "run.*", "plain")


def _chat(content: str) -> str:
    return f"'<|user|>' || {content} || '<|end|><|assistant|>'"


_SCORE_SQL = sql.quoted(rubric_text(SCORE_RUBRIC))
_PAIR_SQL = sql.quoted(rubric_text(PAIR_RUBRIC))
_HINT_SQL = sql.quoted(rubric_text(HINT_RUBRIC))
_WORKED = ["one: 1.5", "two: 5.0"]
_WORKED_SQL = sql.quoted(SCORE_RUBRIC.replace("{examples}", "one: 1.5\ntwo: 5.0\n"))


@query(
    f"""WITH {sql.RESPONSES}
SELECT sample_id, {_chat(f"{_SCORE_SQL} || prompt || '<|audio_1|>'")} AS prompt_text,
  CAST(grade AS VARCHAR) AS label, grade || '<|end|><|endoftext|>' AS answer
FROM responses"""
)
def score_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts and answers that ask for a score."""
    rows = supervised_examples(data.responses(spark, folder))
    return rows.select("sample_id", "prompt_text", "label", "answer")


@query(
    f"""WITH {sql.RESPONSES}
SELECT sample_id, {_chat(f"{_PAIR_SQL} || prompt || '<|audio_1|>'")} AS prompt_text,
  {sql.pair_text('grade')} AS label, {sql.pair_text('grade')} || '<|end|><|endoftext|>' AS answer
FROM responses"""
)
def pair_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts and answers that ask for a pair."""
    rows = supervised_examples(data.responses(spark, folder), target="pair")
    return rows.select("sample_id", "prompt_text", "label", "answer")


@query(
    f"""WITH {sql.HINTS}, hinted AS (
  SELECT r.sample_id, r.prompt, r.grade, coalesce(h.hint, 'No binary prediction') AS hint
  FROM pairs r LEFT JOIN hints h USING (dataset, split, sample_id)
)
SELECT sample_id, hint,
  {_chat(f"replace({_HINT_SQL}, '{{hint}}', hint) || prompt || '<|audio_1|>'")} AS prompt_text,
  grade || '<|end|><|endoftext|>' AS answer
FROM hinted"""
)
def examples_with_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Second-stage examples: each prompt holds the first stage's prediction or the default."""
    results = data.pair_results(spark, folder)
    responses = results.drop("prediction", "label")
    rows = hint_examples(responses, hints_from_results(results))
    return rows.select("sample_id", "hint", "prompt_text", "answer")


@query(
    f"""WITH {sql.RESPONSES}, shown AS (
  SELECT sample_id,
    {_SCORE_SQL} || '<|audio_1|>' || prompt AS audio_first,
    {_SCORE_SQL} || prompt || '<|audio_1|>' AS question_first,
    {_SCORE_SQL} || '<|audio_1|>' AS no_question,
    {_SCORE_SQL} || '<|audio_1|> ' || prompt AS single,
    '<|audio_1|>' || {sql.quoted(ONE_LINE)} AS one_line,
    {_SCORE_SQL} || '<|audio_1|> ' AS not_asked,
    {_WORKED_SQL} || prompt || '<|audio_1|>' AS with_examples
  FROM responses
)
SELECT sample_id, variant, length(content) AS characters, md5(content) AS digest
FROM (UNPIVOT shown ON audio_first, question_first, no_question, single, one_line, not_asked,
  with_examples INTO NAME variant VALUE content)"""
)
def prompt_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every order of rubric, question and audio, without a question, and with worked examples."""
    rows = data.responses(spark, folder)
    rubric, question = F.lit(rubric_text()), F.col("prompt")
    named = ("audio_first", "question_first", "no_question", "single", "one_line")
    contents = {name: user_content(rubric, question, name) for name in named}
    contents["not_asked"] = user_content(rubric, question, "audio_first", ask=False)
    worked = F.lit(rubric_text(SCORE_RUBRIC, _WORKED))
    contents["with_examples"] = user_content(worked, question, "question_first")
    variants = [
        F.struct(F.lit(name).alias("variant"), content.alias("content"))
        for name, content in contents.items()
    ]
    return rows.select("sample_id", F.inline(F.array(*variants))).select(
        "sample_id",
        "variant",
        F.length("content").cast("bigint").alias("characters"),
        F.md5("content").alias("digest"),
    )


@query(
    """SELECT d.doc_id AS sample_id, 'Hint: ' || coalesce('rated ' || l.quality, 'No binary prediction') AS shown
FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def hints_from_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their label as a hint; most have none."""
    documents = data.table(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"))
    rated = F.concat(F.lit("rated "), F.col("quality"))
    labels = data.table(spark, folder, "labels").select(
        F.col("doc_id").alias("sample_id"), rated.alias("hint")
    )
    rows = attach_hints(documents, labels, ["sample_id"])
    return rows.select("sample_id", with_hint("Hint: {hint}", F.col("hint")).alias("shown"))


@query(
    """WITH parts AS (
  SELECT conv_id, turn // 3 AS part, string_agg('<|' || role || '|>' || text || '<|end|>', ''
    ORDER BY turn) AS shown FROM conversations GROUP BY ALL
), last AS (SELECT conv_id, max(turn) // 3 AS last_part FROM conversations GROUP BY conv_id)
SELECT conv_id, part,
  shown || CASE WHEN part = last_part THEN '<|assistant|>' ELSE '' END AS prompt
FROM parts JOIN last USING (conv_id)"""
)
def chat_prompt_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as prompts in parts of three turns."""
    return chat_templates(data.table(spark, folder, "conversations"), 3)


@query(
    """WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations
), parts AS (
  SELECT conv_id, n // 1000 AS part, max(n) AS last,
    string_agg('<|' || role || '|>' || text || '<|end|>', '' ORDER BY n) AS shown
  FROM placed GROUP BY conv_id, n // 1000
)
SELECT conv_id, part, shown || CASE WHEN last = max(last) OVER (PARTITION BY conv_id)
  THEN '<|assistant|>' ELSE '' END AS prompt FROM parts"""
)
def chat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as prompts in parts of a thousand messages."""
    return chat_templates(data.table(spark, folder, "conversations"), 1000)
