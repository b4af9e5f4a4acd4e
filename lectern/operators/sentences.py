"""Sentence boundaries and cutting cues at words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, col, let, tokens
from lectern.operators import TRACK

#: Abbreviations that end no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "al.", "no.", "fig.", "dr.", "mr.", "mrs.", "ms.", "prof.", "st.", "jr.", "sr.")
_TRAILING = r"[\"')\]}»”’]*"
_OPENING = r"[\"'(\[{«“‘]*"
ENOUGH_WORDS, DENSITY = 200, 0.01


def ends_sentence(text: Column | str) -> Column:
    return col(text).rlike(rf"[.?!]{_TRAILING}{SPACE}*\z")


def is_abbreviation(word: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(col(word)), rf"^{_OPENING}", ""), rf"{_TRAILING}\z", "")
    return bare.isin(*ABBREVIATIONS) | bare.rlike(r"^(?:\p{L}|\p{L}{1,2}(?:\.\p{L}{1,2})+).\z")


def opens_sentence(word: Column | str) -> Column:
    return col(word).rlike(rf"^{_OPENING}[\p{{Lu}}\p{{Nd}}]")


def breaks_after(words: Column, i: Column) -> Column:
    w = F.get(words, i)
    return ends_sentence(w) & ~is_abbreviation(w) & opens_sentence(F.get(words, i + 1))


def sentence_cuts(text: Column | str) -> Column:
    """The word numbers that begin a new sentence inside a text."""
    return let(tokens(text), lambda w: F.transform(F.filter(F.transform(w, lambda x, i: i), lambda i: (i < F.size(w) - 1) & breaks_after(w, i)), lambda i: i + 1))


def punctuated(cues: DataFrame) -> DataFrame:
    """source_id, track_idx, n_words, n_endings, punctuated: null where there are too few words to tell."""
    own = tokens("text")
    counts = cues.select(*TRACK, F.size(own).alias("w"), F.size(F.filter(own, ends_sentence)).alias("e"))
    out = counts.groupBy(*TRACK).agg(F.sum("w").alias("n_words"), F.sum("e").alias("n_endings"))
    return out.withColumn("punctuated", F.when(F.col("n_words") >= ENOUGH_WORDS, F.col("n_endings") >= F.col("n_words") * DENSITY))


def cut_at(cues: DataFrame, cuts: Column) -> DataFrame:
    """Cues cut before the given words; adds piece_idx. A cue whose words are not all timed stays whole.

    A piece starts where its first word does, not before the piece before it and not
    after the cue's end; the turn belongs to the first piece.
    """
    end = F.col("start") + F.col("duration")

    def pieces(own: Column) -> Column:
        def at(cut: Column) -> Column:
            edges = F.concat(F.array(F.lit(0)), cut, F.array(F.size(own)))
            first = F.array(F.col("start"))
            starts = F.aggregate(cut, first, lambda acc, i: F.concat(acc, F.array(F.least(F.greatest(F.get(F.col("words"), i)["start"], F.element_at(acc, -1)), end))))

            def piece(s: Column, k: Column) -> Column:
                a, b = F.get(edges, k), F.get(edges, k + 1)
                stop = F.coalesce(F.get(starts_of, k + 1), end)
                return F.struct(F.array_join(F.slice(own, a + 1, b - a), " ").alias("text"), s.alias("start"), (stop - s).alias("duration"), F.slice(F.col("words"), a + 1, b - a).alias("words"), (F.col("turn") & (k == 0)).alias("turn"))

            starts_of = None

            def with_starts(st: Column) -> Column:
                nonlocal starts_of
                starts_of = st
                return F.transform(st, piece)

            return let(starts, with_starts)

        valid = F.array_sort(F.array_distinct(F.filter(cuts, lambda i: (i > 0) & (i < F.size(own)))))
        whole = F.array(F.struct(F.col("text").alias("text"), F.col("start").alias("start"), F.col("duration").alias("duration"), F.col("words").alias("words"), F.col("turn").alias("turn")))
        return F.when((F.size("words") == F.size(own)) & (F.size(valid) > 0), let(valid, at)).otherwise(whole)

    rest = [c for c in cues.columns if c not in ("text", "start", "duration", "words", "turn", "piece_idx")]
    return cues.select(*rest, F.posexplode(let(tokens("text"), pieces)).alias("piece_idx", "p")).select(*rest, "piece_idx", "p.*")


def split_at_sentences(cues: DataFrame) -> DataFrame:
    return cut_at(cues, sentence_cuts("text"))
