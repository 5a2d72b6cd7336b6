"""The same derivations in SQL, written apart from the Spark code they check."""

from __future__ import annotations

SPACE = "' ' || chr(9) || chr(10) || chr(13)"

RESPONSES = """
base AS (
  SELECT event_id AS sample_id, user_id AS speaker_id, event_type AS dataset,
         CASE WHEN user_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split,
         user_id % 4 AS revision, props AS prompt,
         10 + 5 * (CAST(floor(value) AS BIGINT) % 9) AS grade10,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events
), responses AS (
  SELECT *, grade10 / 10 AS grade,
         CAST(greatest(0, least(50, grade10 + cents % 21 - 10)) AS BIGINT) AS tenths
  FROM base
)"""

TENTHS = "CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR)"

SCORES = f"""{RESPONSES}, scores AS (
  SELECT *, CAST(grade AS VARCHAR) AS label,
    CASE WHEN sample_id % 11 = 0 THEN 'no score'
         WHEN sample_id % 7 = 0 THEN '"' || {TENTHS} || '",'
         WHEN sample_id % 13 = 0 THEN {TENTHS} || ' out of 5'
         WHEN sample_id % 17 = 0 THEN ' ' || {TENTHS}
         WHEN sample_id % 19 = 0 THEN {TENTHS} || chr(10)
         WHEN sample_id % 23 = 0 THEN {TENTHS} || 'f'
         WHEN sample_id % 29 = 0 THEN {TENTHS} || '/5'
         ELSE {TENTHS} END AS prediction
  FROM responses
)"""


def pair_label(grade: str) -> str:
    return f"CASE WHEN {grade} >= 4 THEN 1 ELSE 0 END"


def pair_prob(grade: str) -> str:
    return f"""CASE WHEN {grade} <= 1 THEN 0.99::DOUBLE WHEN {grade} <= 2 THEN 0.80::DOUBLE
      WHEN {grade} <= 3 THEN 0.70::DOUBLE
      WHEN {grade} < 4 THEN 0.70::DOUBLE - ({grade} - 3::DOUBLE) * (0.70::DOUBLE - 0.30::DOUBLE)
      WHEN {grade} < 5 THEN 0.65::DOUBLE + ({grade} - 4::DOUBLE) * 0.20::DOUBLE
      ELSE 0.95::DOUBLE END"""


def pair_text(grade: str) -> str:
    return f"printf('%d,%.2f', {pair_label(grade)}, {pair_prob(grade)})"


PAIRS = f"""{RESPONSES}, near AS (
  SELECT *, {TENTHS} AS plain, CASE WHEN tenths >= 40 THEN '1,0.' || (tenths + 25)
           ELSE '0,0.' || (99 - tenths) END AS near,
         {pair_text('grade')} AS label
  FROM responses
), pairs AS (
  SELECT *,
    CASE WHEN sample_id % 13 = 0 THEN near || chr(10) || '(sure)'
         WHEN sample_id % 17 = 0 THEN plain
         WHEN sample_id % 19 = 0 THEN 'sorry'
         WHEN sample_id % 23 = 0 THEN 'sorry, no'
         WHEN sample_id % 29 = 0 THEN '7,0.50'
         WHEN sample_id % 31 = 0 THEN ' 0, 0.8' || (sample_id % 10) || '5 '
         WHEN sample_id % 37 = 0 THEN plain || ','
         WHEN sample_id % 41 = 0 THEN plain || ' or so'
         WHEN sample_id % 43 = 0 THEN '1,1'
         ELSE near END AS prediction
  FROM near
)"""


def number(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
      THEN TRY_CAST(trim({text}, {SPACE}) AS DOUBLE) END"""


def score(text: str) -> str:
    return number(f"""trim(split_part({text}, ' ', 1), '"'',\\/')""")


def label_score(text: str) -> str:
    return number(f"split_part({text}, ' ', 1)")


def half_down(value: str) -> str:
    return f"(trunc({value}) + CASE WHEN {value} - trunc({value}) <= 0.5 THEN 0 ELSE 1 END)"


def parsed_pair(text: str, cut: bool) -> tuple[str, str]:
    """SQL for the label and the probability of a text."""
    bare = f"trim({text}, {SPACE})"
    found = f"regexp_extract({bare}, '^(\\d+,\\d+\\.\\d+)', 1)"
    clean = f"CASE WHEN {found} <> '' THEN {found} ELSE {bare} END" if cut else bare
    left = f"trim(split_part({clean}, ',', 1), {SPACE})"
    right = f"substr({clean}, strpos({clean}, ',') + 1)"
    whole = f"CASE WHEN regexp_matches({left}, '^[+-]?\\d+$') THEN TRY_CAST({left} AS BIGINT) END"
    old = score(bare)
    label = f"""CASE WHEN contains({text}, ',') THEN {whole}
      WHEN ({old}) >= 4 THEN 1 WHEN ({old}) < 4 THEN 0 END"""
    prob = f"""CASE WHEN contains({text}, ',') THEN {number(right)}
      WHEN ({old}) >= 4 THEN 0.75::DOUBLE WHEN ({old}) < 4 THEN 0.25::DOUBLE END"""
    return label, prob


_LABEL, _PROB = parsed_pair("prediction", cut=True)
_REF_LABEL, _REF_PROB = parsed_pair("label", cut=False)

PARSED_SCORES = f"""{SCORES}, parsed AS (
  SELECT *, {score('prediction')} AS g, {label_score('label')} AS t FROM scores
)"""

PARSED_PAIRS = f"""{PAIRS}, halves AS (
  SELECT *, {_LABEL} AS gl0, {_PROB} AS gp0, {_REF_LABEL} AS tl, {_REF_PROB} AS tp,
         {score('prediction')} AS g, {label_score('label')} AS t
  FROM pairs
), parsed AS (
  SELECT *, CASE WHEN gp0 IS NOT NULL THEN gl0 END AS gl,
            CASE WHEN gl0 IS NOT NULL THEN gp0 END AS gp
  FROM halves
)"""

SCORE_METRICS = f"""
  count(*) FILTER (abs(g - t) <= 0.5) / count(*) AS accuracy,
  count(*) FILTER ({half_down('g')} = {half_down('t')}) / count(*) AS absolute_accuracy,
  count(*) FILTER (({half_down('g')} > 3) = ({half_down('t')} > 3)) / count(*) AS binary_accuracy"""

PAIR_METRICS = """
  coalesce(avg(CASE WHEN gl IS NOT NULL THEN CAST(gl = tl AS INTEGER) END), 0) AS binary_accuracy,
  round(avg((gp - tp) * (gp - tp)), 9) AS probability_mse,
  avg(CAST(abs(gp - tp) <= 0.1::DOUBLE AS INTEGER)) AS probability_accuracy,
  round(0.7::DOUBLE * avg(CASE WHEN gl IS NOT NULL THEN CAST(gl = tl AS INTEGER) END)
    + 0.3::DOUBLE * avg(CAST(abs(gp - tp) <= 0.1::DOUBLE AS INTEGER)), 9) AS combined_score"""

HINTS = f"""{PAIRS}, hints AS (
  SELECT dataset, split, sample_id, trim(prediction, {SPACE}) AS hint
  FROM pairs WHERE contains(prediction, ',')
)"""

TOKENS = """tokens AS (
  SELECT doc_id AS sample_id, lang AS dataset,
    [CAST(length(w) AS BIGINT) FOR w IN string_split(split_part(text, chr(10), 1), ' ')]
      AS prompt_ids,
    CASE WHEN contains(text, chr(10)) THEN
      [CAST(length(w) AS BIGINT) FOR w IN
        string_split(substr(text, strpos(text, chr(10)) + 1), ' ')]
    ELSE CAST([] AS BIGINT[]) END AS answer_ids
  FROM documents
)"""

FRAMES = """frames AS (
  SELECT vec_id AS sample_id, label,
    [list_slice(embedding, i * (3 + vec_id % 6) + 1, (i + 1) * (3 + vec_id % 6))
      FOR i IN range(CAST(ceil(len(embedding) / (3 + vec_id % 6)) AS BIGINT))] AS frames
  FROM embeddings
)"""

AUDIO = """audio_rows AS (
  SELECT vec_id AS sample_id, CASE WHEN vec_id % 7 <> 6 THEN CAST(label AS BIGINT) END AS speaker_id,
    1 + (vec_id % 9) / 2 AS grade, vec_id % 7 AS kind, 'topic ' || label AS prompt,
    CASE WHEN label > 1 THEN 'en' END AS language,
    CASE WHEN vec_id % 7 IN (0, 1, 2, 6) THEN 'clips/a_' || vec_id || '.wav' END AS path,
    CASE WHEN vec_id % 7 IN (0, 2) THEN 'clips/a_' || vec_id || '.wav' END AS clip_path
  FROM embeddings
)"""


def quoted(text: str) -> str:
    """Text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"
