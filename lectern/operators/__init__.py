"""Operators over DataFrames of timed text.

Order is data: every table carries its ordinals (cue_idx, piece_idx, passage_idx), and a
track is named by (source_id, track_idx).
"""

TRACK = ["source_id", "track_idx"]
WORDS = "array<struct<text:string,start:double>>"
CUES = f"source_id string, track_idx int, cue_idx int, text string, start double, duration double, words {WORDS}, speaker string, turn boolean"
