"""Schemas of the tables that the engine exchanges, as DDL: parsed where they are used, so no session is needed to import them."""

from __future__ import annotations

FILES = "name string, path string, type string, size bigint"
PAIRS = "primary_path string, secondary_path string"
RESULTS = "primary_path string, secondary_path string, start_delay_ms double, end_delay_ms double, error string, elapsed_ms bigint, degenerate boolean, completed_at timestamp"
PROBE = "streams array<struct<codec_type:string>>, format struct<duration:string>"
REQUEST = "mode string, video_folder string, audio_folder string, audio_file string, video_files array<string>, segment_duration double, match_pattern string"
_RESULT = "struct<videoFile:string,audioFile:string,startDelay:double,endDelay:double,error:string,elapsed_ms:bigint>"
RESULT_LIST = f"array<{_RESULT}>"
EVENTS = (
    "type string, file string, percent int, processed bigint, total bigint, current string, elapsed_ms bigint, message string, "
    f"videoFile string, audioFile string, startDelay double, endDelay double, error string, part bigint, parts bigint, results {RESULT_LIST}"
)
HISTORY = f"id string, date timestamp, mode string, results {RESULT_LIST}, fileCount bigint"
