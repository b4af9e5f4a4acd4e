"""Caption payloads -> cues.

payloads(source_id, track_idx, caption_format, payload) become cues, with rows for what
could not be read in :func:`malformed`. A payload is one bounded value (its ceiling is
checked), so its lines are handled as an array in its row: no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, col, let, normalise, strip_tags, tokens, unescape
from lectern.functions.times import parse_clock
from lectern.operators import TRACK, WORDS

MAX_PAYLOAD = 32 * 1024 * 1024
MAX_EVENTS = MAX_CUES = 250_000
JSON_FORMATS, VTT_FORMATS, SRT_FORMATS = ("json3",), ("vtt", "webvtt"), ("srt", "subrip")
_SIDE = r"[ \t\n\x0b\f\r]*(?:[0-9]+:)?[0-9]{1,2}:[0-9]{2}[.,][0-9]{1,3}"
TIMING = rf"^{_SIDE}[ \t\n\x0b\f\r]*-->{_SIDE}(?:[ \t\n\x0b\f\r].*)?$"
EVENTS = "struct<events:array<struct<tStartMs:string,dDurationMs:string,aAppend:string,segs:array<struct<utf8:string,tOffsetMs:string>>>>>"


def parse_timing(line: Column | str) -> Column:
    """struct<start, end> of a timing line; null for any other."""
    left = F.substring_index(col(line), "-->", 1)
    right = F.substring(col(line), F.length(left) + 4, F.length(col(line)))
    end = parse_clock(F.get(tokens(right), F.lit(0)))
    start = parse_clock(left)
    return F.when(F.contains(col(line), F.lit("-->")) & start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def lines_of(payload: Column | str) -> Column:
    return F.split(F.regexp_replace(col(payload), "\r\n?", "\n"), "\n", -1)


def cue_blocks(payloads: DataFrame) -> DataFrame:
    """A row per timing line: cue_idx, start, end, raw (the lines up to the first empty one, joined by newlines)."""

    def blocks(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("-->")) & parse_timing(x).isNotNull(), i)), lambda i: i.isNotNull())

        def cut(at: Column) -> Column:
            def block(i: Column, k: Column) -> Column:
                own = F.slice(lines, i + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - i - 1)
                stop = F.array_position(own, "")
                text = F.when(stop > 0, F.slice(own, F.lit(1), (stop - 1).cast("int"))).otherwise(own)
                return F.struct(parse_timing(F.get(lines, i)).alias("span"), F.array_join(text, "\n").alias("raw"))

            return F.transform(at, block)

        return let(starts, cut)

    rows = payloads.select(*TRACK, F.posexplode(let(lines_of("payload"), blocks)).alias("cue_idx", "b"))
    return rows.select(*TRACK, "cue_idx", F.col("b.span.start").alias("start"), F.col("b.span.end").alias("end"), F.col("b.raw").alias("raw"))


def plain_text(raw: Column | str) -> Column:
    return normalise(unescape(strip_tags(raw)))


def inline_words(raw: Column | str, start: Column | str) -> Column:
    """Words timed inside a cue; of the text before the first of them only the last word, at the cue's start."""
    word = r"<([0-9]{1,2}:[0-9]{2}:[0-9]{2}[.,][0-9]{1,3})><c[^>]*>([^<]*)</c>"
    found = F.arrays_zip(F.regexp_extract_all(col(raw), F.lit(word), F.lit(1)).alias("t"), F.regexp_extract_all(col(raw), F.lit(word), F.lit(2)).alias("w"))
    timed = F.transform(found, lambda x: F.struct(normalise(unescape(x["w"])).alias("text"), parse_clock(x["t"]).alias("start")))
    timed = F.filter(timed, lambda x: (x["text"] != "") & x["start"].isNotNull())
    head = tokens(plain_text(F.get(F.split(col(raw), word, 2), F.lit(0))))
    first = F.transform(F.slice(head, -1, 1), lambda t: F.struct(t.alias("text"), col(start).alias("start")))
    none = F.array().cast(WORDS)
    return F.when(col(raw).rlike(word), F.concat(F.when(F.size(head) > 0, first).otherwise(none), timed)).otherwise(none)


def _cues(rows: DataFrame) -> DataFrame:
    return rows.where("text <> ''").select(*TRACK, "cue_idx", "text", "start", "duration", "words", F.lit(None).cast("string").alias("speaker"), F.lit(False).alias("turn"))


def parse_vtt(payloads: DataFrame) -> DataFrame:
    b = cue_blocks(payloads).select("*", plain_text("raw").alias("text"), F.greatest(F.col("end") - F.col("start"), F.lit(0.0)).alias("duration"))
    return _cues(b.withColumn("words", inline_words("raw", "start")))


def parse_srt(payloads: DataFrame) -> DataFrame:
    b = cue_blocks(payloads).select("*", plain_text("raw").alias("text"), F.greatest(F.col("end") - F.col("start"), F.lit(0.0)).alias("duration"))
    return _cues(b.withColumn("words", F.array().cast(WORDS)))


def _number(text: Column) -> Column:
    """A finite number; null for what is none."""
    n = text.try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def parse_json3(payloads: DataFrame) -> DataFrame:
    """Events with segments and without aAppend; words only where some segment has an offset."""
    events = payloads.select(*TRACK, F.posexplode(F.from_json("payload", EVENTS)["events"]).alias("cue_idx", "e"))
    e = F.col("e")
    kept = events.where((F.size(e["segs"]) > 0) & F.coalesce(e["aAppend"], F.lit("0")).isin("0", "false", "", "null"))
    start = F.greatest(_number(e["tStartMs"]) / 1000, F.lit(0.0))
    spoken = F.filter(e["segs"], lambda s: F.trim(F.regexp_replace(F.coalesce(s["utf8"], F.lit("")), SPACE, " ")) != "")
    words = F.transform(spoken, lambda s: F.struct(normalise(s["utf8"]).alias("text"), F.greatest(F.col("start") + F.coalesce(_number(s["tOffsetMs"]), F.lit(0.0)) / 1000, F.lit(0.0)).alias("start")))
    rows = kept.select(*TRACK, "cue_idx", "e", start.alias("start"), normalise(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), "")).alias("text"), F.greatest(F.coalesce(_number(e["dDurationMs"]), F.lit(0.0)) / 1000, F.lit(0.0)).alias("duration"))
    timed = F.exists(spoken, lambda s: s["tOffsetMs"].isNotNull())
    return _cues(rows.where("start is not null").withColumn("words", F.when(timed, words).otherwise(F.array().cast(WORDS))))


def parse_captions(payloads: DataFrame) -> DataFrame:
    """All payloads of a known format that :func:`malformed` does not refuse; formats by name or alias."""
    fine = payloads.where(refusal().isNull())
    of = lambda names: fine.where(F.lower("caption_format").isin(*names))
    return parse_json3(of(JSON_FORMATS)).union(parse_vtt(of(VTT_FORMATS))).union(parse_srt(of(SRT_FORMATS)))


def refusal() -> Column:
    """struct<code, detail> for a payload that cannot be read; null for one that can. Nothing is cut to fit."""
    fmt = F.lower("caption_format")
    is_json = fmt.isin(*JSON_FORMATS)
    parsed = F.from_json("payload", EVENTS)
    n_events = F.size(parsed["events"])
    bad_start = F.exists(parsed["events"], lambda e: (F.size(e["segs"]) > 0) & F.coalesce(e["aAppend"], F.lit("0")).isin("0", "false", "", "null") & (normalise(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), "")) != "") & _number(e["tStartMs"]).isNull())
    n_timings = F.size(F.filter(lines_of("payload"), lambda x: F.contains(x, F.lit("-->"))))
    say = lambda code, detail: F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail"))
    return (
        F.when(~fmt.isin(*JSON_FORMATS, *VTT_FORMATS, *SRT_FORMATS) | fmt.isNull(), say("UNKNOWN_CAPTION_FORMAT", "no parser has this name"))
        .when(F.length("payload") > MAX_PAYLOAD, say("PAYLOAD_TOO_LARGE", "the payload is over its ceiling"))
        .when(is_json & F.expr("try_parse_json(payload)").isNull(), say("MALFORMED_CAPTIONS", "not JSON"))
        .when(is_json & parsed["events"].isNull(), say("MALFORMED_CAPTIONS", "no list of events at the top level"))
        .when(is_json & (n_events > MAX_EVENTS), say("PAYLOAD_TOO_LARGE", "more events than the ceiling"))
        .when(is_json & bad_start, say("MALFORMED_CAPTIONS", "an event has no finite start"))
        .when(~is_json & (n_timings > MAX_CUES), say("PAYLOAD_TOO_LARGE", "more cues than the ceiling"))
    )


def malformed(payloads: DataFrame) -> DataFrame:
    """source_id, track_idx, code, detail: a row per payload that cannot be read."""
    return payloads.select(*TRACK, refusal().alias("r")).where("r is not null").select(*TRACK, "r.*")
