"""Row types of the engine. Lists are rows with an explicit ordinal; times are seconds as DOUBLE."""

WORD = "struct<text: string, start: double, end: double, confidence: double>"
SEGMENT = f"struct<id: string, start: double, end: double, text: string, confidence: double, uncertainty: array<string>, words: array<{WORD}>>"
TRANSCRIPT = f"struct<schema_version: int, language: string, provider: string, model: string, source: string, manually_reviewed: boolean, reviewed_by: string, glossary_terms: array<string>, numbers: array<string>, segments: array<{SEGMENT}>>"
SEGMENTS = f"job_id string, seq int, id string, start double, end double, text string, confidence double, uncertainty array<string>, words array<{WORD}>"
TRANSLATIONS = "job_id string, seq int, id string, start double, end double, source_text string, text string, uncertainty array<string>, notes string"
CUES = "job_id string, index int, start double, end double, text string"
HEARD = "struct<word: string, punctuated_word: string, start: double, end: double, confidence: double>"
UTTERANCES = f"struct<results: struct<utterances: array<struct<start: double, end: double, confidence: double, transcript: string, words: array<{HEARD}>>>, channels: array<struct<alternatives: array<struct<transcript: string, confidence: double, words: array<{HEARD}>>>>>>>"
SCORED_SEGMENTS = "struct<language: string, duration: double, text: string, segments: array<struct<id: int, start: double, end: double, text: string, avg_logprob: double, compression_ratio: double, no_speech_prob: double>>>"
TRANSLATED = "struct<translations: array<struct<id: string, text: string, uncertain: boolean, notes: string>>>"
OUTPUT = "struct<path: string, bytes: bigint, sha256: string>"
STAGE_STATE = f"job_id string, stage string, status string, started_at string, completed_at string, failed_at string, code string, context_sha256 string, outputs array<{OUTPUT}>"
PROBE = "struct<format: struct<duration: string>, streams: array<struct<index: int, codec_type: string, codec_name: string, width: int, height: int, duration: string, tags: struct<language: string>>>>"
