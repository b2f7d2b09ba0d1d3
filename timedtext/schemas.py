"""Tables of the engine. Order is never implied: every table carries (file_id, idx)."""

from __future__ import annotations

WORD = "struct<start:double,end:double,word:string,p:double>"
SEGMENTS = f"file_id string, idx int, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, words array<{WORD}>, gap_fill boolean"
SEG = "struct<text:string,t_ms:bigint>"
CUE = f"struct<t_ms:bigint,dur_ms:bigint,ja:string,segs:array<{SEG}>>"
CUES = f"file_id string, idx int, t_ms bigint, dur_ms bigint, ja string, segs array<{SEG}>"
TRANSCRIPT = f"title string, author string, video_id string, duration_s bigint, source string, captured_at string, cue_count bigint, last_cue_s bigint, coverage_pct bigint, cues array<{CUE}>, dropped array<struct<t_ms:bigint,ja:string,reason:string>>"
PIECES = "file_id string, idx int, cue_index int, text string, start_ms bigint, end_ms bigint, ends_sentence boolean"
UNITS = "file_id string, idx int, ja string, start_ms bigint, end_ms bigint, cue_index array<int>"
INTERVALS = "file_id string, a double, b double"
GLOSSARY = "name string, category string, term string, rendering string, pos int"
