"""Additions beyond batch work: the same rules over streams of cues and events."""
