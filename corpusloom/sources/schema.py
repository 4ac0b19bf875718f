"""Schemas of records."""

from __future__ import annotations

CLIP = """clip_id string, source_dataset string, source_version string, source_split string, source_row_id string, audio_path string,
 transcript string, normalized_transcript string, language string, speaker_id string, session_id string, collection_format string,
 rights_state string, license_id string, duration_seconds double, sample_rate_hz int, sha256 string, transcription_model string,
 transcription_language string, metadata map<string,string>"""
PROMPT = "id string, category string, text string"
# What may not be empty in a clip.
REQUIRED = ("clip_id", "source_dataset", "source_version", "audio_path", "license_id")
