import pytest
from helpers import exchanges
from pyspark.sql import functions as F

from scorelane.operators.prompts import (
    SCORE_RUBRIC,
    chat_templates,
    hint_examples,
    rubric_text,
    supervised_examples,
    user_content,
)

RESPONSES = "dataset string, split string, sample_id long, prompt string, grade double"


def responses(spark):
    rows = [("a", "dev", 0, "Why?", 4.5), ("a", "dev", 1, None, 3.0)]
    return spark.createDataFrame(rows, RESPONSES)


def test_variants_place_question_and_audio(spark):
    one = spark.range(1)

    def content(variant, ask=True):
        made = user_content(F.lit("R."), F.lit("Q?"), variant, ask)
        return one.select(made.alias("c")).first().c

    assert content("audio_first") == "R.<|audio_1|>Q?"
    assert content("question_first") == "R.Q?<|audio_1|>"
    assert content("no_question") == "R.<|audio_1|>"
    assert content("single") == "R.<|audio_1|> Q?"
    assert content("audio_first", ask=False) == "R.<|audio_1|> "
    assert content("one_line").startswith("<|audio_1|>")
    with pytest.raises(ValueError):
        content("sideways")


def test_worked_examples_go_into_the_rubric():
    assert "{" not in rubric_text()
    assert "first\nsecond\nAnswer" in rubric_text(SCORE_RUBRIC, ["first", "second"])


def test_score_and_pair_answers(spark):
    rows = supervised_examples(responses(spark), rubric="R.").orderBy("sample_id").collect()
    assert rows[0].prompt_text == "<|user|>R.Why?<|audio_1|><|end|><|assistant|>"
    assert rows[0].answer == "4.5<|end|><|endoftext|>"
    assert rows[1].prompt_text == "<|user|>R.<|audio_1|><|end|><|assistant|>"
    pairs = supervised_examples(responses(spark), "pair").orderBy("sample_id").collect()
    assert [r.label for r in pairs] == ["1,0.75", "0,0.70"]
    with pytest.raises(ValueError):
        supervised_examples(responses(spark), "other")


def test_only_pair_examples_do_without_questions(spark):
    bare = responses(spark).drop("prompt")
    assert supervised_examples(bare, "pair", rubric="R.").first().prompt_text.startswith("<|user|>R.<|audio")
    with pytest.raises(ValueError, match="prompt"):
        supervised_examples(bare)
    with pytest.raises(ValueError, match="grade"):
        supervised_examples(responses(spark).drop("grade"), "pair")


def test_hints_stand_in_the_prompt(spark):
    hints = spark.createDataFrame([("a", "dev", 0, "1,{hint}")], "dataset string, split string, sample_id long, hint string")
    rows = hint_examples(responses(spark), hints, rubric="H={hint}.").orderBy("sample_id").collect()
    assert rows[0].prompt_text == "<|user|>H=1,{hint}.Why?<|audio_1|><|end|><|assistant|>"
    assert "H=No binary prediction." in rows[1].prompt_text


def test_long_conversations_are_cut_into_parts(spark):
    """One conversation has nearly all messages; none is lost and no part is long."""
    rows = [("hot", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(1000)]
    rows += [("cold", i, "user", None) for i in range(3)]
    messages = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    parts = chat_templates(messages.repartition(5), 64).collect()
    hot = [p.prompt for p in sorted((p for p in parts if p.conv_id == "hot"), key=lambda p: p.part)]
    assert len(hot) == 16
    shown = "".join(f"<|{role}|>{text}<|end|>" for _, _, role, text in rows[:1000])
    assert "".join(hot) == shown + "<|assistant|>"
    cold = [p.prompt for p in parts if p.conv_id == "cold"]
    assert cold == ["<|user|><|end|>" * 3 + "<|assistant|>"]


@pytest.mark.parametrize("turns", ["own", "same"])
def test_parts_follow_places_not_turn_numbers(spark, turns):
    """300 messages, also if all of them have one turn number."""
    rows = [("c", i if turns == "own" else 7, "user", f"m{i:03}") for i in range(300)]
    messages = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    for size in (100, 256, 299, 300, 301):
        parts = sorted(chat_templates(messages.repartition(4), size).collect(), key=lambda p: p.part)
        assert [p.prompt.count("<|user|>") for p in parts] == [
            min(size, 300 - start) for start in range(0, 300, size)
        ]
        shown = "".join(f"<|user|>m{i:03}<|end|>" for i in range(300))
        assert "".join(p.prompt for p in parts) == shown + "<|assistant|>"
    with pytest.raises(ValueError):
        chat_templates(messages, 0)


def test_examples_need_no_shuffle(spark):
    assert exchanges(supervised_examples(responses(spark))) == 0
