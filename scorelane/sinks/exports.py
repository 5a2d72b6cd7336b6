"""Sample exports: file names and metadata texts of chosen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.functions.text import base_name
from scorelane.sources.responses import audio_origin, audio_value

# Optional columns and how the text names them.
OPTIONAL_LINES = {
    "prompt": "Prompt",
    "asr_transcription": "Asr_transcription",
    "delivery": "Delivery",
    "relevance": "Relevance",
    "language": "Language",
}


def export_name(
    sample_id: Column, file_name: Column, score: Column, speaker: Column | None = None
) -> Column:
    """The name of an exported sample; what is null is left out of it."""

    def part(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name), value.cast("string")), F.lit(""))

    base = F.replace(base_name(file_name), F.lit(".wav"), F.lit(""))
    who = F.lit("") if speaker is None else part("_speaker_", speaker)
    return F.concat(
        sample_id.cast("string"), who, F.lit("_"), base, part("_score_", score), F.lit(".wav")
    )


def _line(name: str, value: Column, unit: str = "") -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(f"{unit}\n"))


def export_manifest(
    rows: DataFrame, audio_column: str = "audio", score_column: str = "grade"
) -> tuple[DataFrame, DataFrame]:
    """File name and metadata text per row, and the rows skipped for want of audio.

    Only the audio's rate and path are looked at, so samples stay unread.
    """
    for name in (audio_column, score_column):
        if name not in rows.columns:
            raise ValueError(f"no column {name!r}; there are {rows.columns}")
    audio = audio_value(rows, audio_column)
    sid, score = F.col("sample_id"), F.col(score_column)
    file_name = F.coalesce(audio["path"], F.concat(F.lit("sample_"), sid, F.lit(".wav")))
    speaker = F.col("speaker_id") if "speaker_id" in rows.columns else None
    lines = [_line("Sample index", sid)]
    if speaker is not None:
        lines.append(_line("Speaker ID", speaker))
    lines += [
        _line("Original filename", file_name),
        _line("Truth score", score),
        _line("Sampling rate", audio["sampling_rate"], " Hz"),
    ]
    lines += [
        _line(title, F.col(name)) for name, title in OPTIONAL_LINES.items() if name in rows.columns
    ]
    usable = audio_origin(audio) == "array"
    manifest = rows.where(usable).select(
        "sample_id",
        export_name(sid, file_name, score, speaker).alias("file_name"),
        F.concat(sid.cast("string"), F.lit("_metadata.txt")).alias("metadata_name"),
        F.concat_ws("", *lines).alias("metadata"),
    )
    return manifest, rows.where(~usable).select("sample_id")
