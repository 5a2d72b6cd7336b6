"""Exporting chosen samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from scorelane.operators.select import choose_samples, missing_from
from scorelane.sinks.exports import export_manifest
from scorelane.sources.responses import require_columns


@dataclass(frozen=True)
class Export:
    """What an export made and what it could not make."""

    manifest: DataFrame
    skipped: DataFrame
    missing: DataFrame


def export_samples(
    rows: DataFrame,
    indices: DataFrame | None = None,
    speakers: DataFrame | None = None,
    audio_column: str = "audio",
    score_column: str = "grade",
) -> Export:
    """Files and texts for samples chosen by index or by speaker.

    ``skipped`` has chosen samples without audio, ``missing`` the asked keys
    that no sample has.
    """
    require_columns(rows, ["sample_id", audio_column, score_column])
    chosen = choose_samples(rows, indices, speakers)
    manifest, skipped = export_manifest(chosen, audio_column, score_column)
    if speakers is not None:
        return Export(manifest, skipped, missing_from(rows, speakers, "speaker_id"))
    return Export(manifest, skipped, missing_from(rows, indices, "sample_id"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").parquet(path)
