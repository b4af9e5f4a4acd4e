"""A cue's words as they are shuffled: where they are the tokens of its text, by their times alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import tokens


def packed(words: Column, text: Column) -> Column:
    """struct<starts, loose>: the times of words that are the text's tokens, or else the words."""
    same = F.coalesce(F.transform(words, lambda x: x["text"]) == tokens(text), F.lit(False))
    return F.struct(F.when(same, F.transform(words, lambda x: x["start"])).alias("starts"), F.when(~same, words).alias("loose"))


def unpacked(starts: Column, loose: Column, text: Column) -> Column:
    """The words again, from the same tokens."""
    return F.coalesce(loose, F.zip_with(tokens(text), starts, lambda t, s: F.struct(t.alias("text"), s.alias("start"))))
