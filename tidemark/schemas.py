"""Column layouts of the tables that the jobs exchange, as DDL text."""

SIDECAR = (
    "source_id string, schema_version string, fixture_notice string, observations array<struct<"
    "observation_id string, adapter string, start_ms bigint, end_ms bigint, claim_type string, "
    "text string, confidence double, modality string, speaker_id string, speech_text string>>"
)
LEDGER = (
    "schema_version string, source_id string, event_no bigint, event_id string, part bigint, revision int, "
    "start_ms bigint, end_ms bigint, level string, scene_id string, "
    "claims array<struct<claim_id string, type string, text string, confidence double, "
    "evidence_refs array<string>>>, "
    "speech array<struct<speaker_id string, text string, source string, evidence_ref string, "
    "confidence double>>, entities array<string>, uncertainty array<string>, status string, "
    "provenance struct<source_id string, chunk_id string, chunk_ids array<string>, run_id string>"
)
MEDIA_PROBE = (
    "format struct<duration string, format_name string>, "
    "streams array<struct<index int, codec_type string, codec_name string, avg_frame_rate string, "
    "duration string, time_base string, width int, height int, tags map<string,string>, "
    "disposition map<string,int>>>, "
    "chapters array<struct<id bigint, start_time string, end_time string, "
    "tags map<string,string>>>"
)

# Fixed values shared by readers and checks.
MODALITIES = ("VID", "AUD", "ASR", "SUB", "OCR", "ENTITY")
SPEECH_MODALITIES = ("ASR", "SUB")
SPEECH_SOURCES = ("asr", "subtitle", "caption", "sidecar_asr", "provided_transcript")
OUTCOMES_WITH_ROWS = ("success", "success_zero", "partial_success")
