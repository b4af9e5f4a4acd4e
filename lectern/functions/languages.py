"""Languages and trust tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import col

UNKNOWN = "und"
FORMATS = ("json3", "vtt", "webvtt", "srt", "subrip")
#: Tier, rank, prose, whether its text is taken to have punctuation.
TIERS = [
    ("manual", 0, "human-written captions", True),
    ("asr_platform", 1, "platform auto-generated captions", False),
    ("asr_local", 2, "locally transcribed audio", True),
    ("translated", 3, "machine-translated captions", True),
]
#: Language codes.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga "
    "gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu iw ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu "
    "lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq "
    "sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu "
    "ara ceb ces deu ell eng fil fra haw heb hin hun ita jpn kor nld pol por ron rus spa swe tha tur ukr vie yue zho und"
).split()


def primary_subtag(code: Column | str) -> Column:
    return F.lower(F.substring_index(col(code), "-", 1))


def looks_like_language(text: Column | str) -> Column:
    t = col(text)
    return t.rlike("^[A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*$") & primary_subtag(t).isin(*CODES)


def matches(language: Column | str, raw_language: Column | str, wanted: Column | str) -> Column:
    """Whether a track serves a wanted language; one of unknown language serves all."""
    lang, raw, want = col(language), F.lower(col(raw_language)), F.lower(col(wanted))
    return (lang == UNKNOWN) | (want == raw) | (want == F.lower(lang)) | raw.startswith(F.concat(want, F.lit("-")))


def format_rank(fmt: Column | str) -> Column:
    out = F.lit(len(FORMATS))
    for k, name in reversed(list(enumerate(FORMATS))):
        out = F.when(col(fmt) == name, k).otherwise(out)
    return out


def tiers(spark: SparkSession) -> DataFrame:
    """The four-row tier dimension: tier, rank, prose, assume_punctuated."""
    return spark.createDataFrame(TIERS, "tier string, rank int, prose string, assume_punctuated boolean")


def tier_rank(tier: Column | str) -> Column:
    out = F.lit(None).cast("int")
    for name, rank, _, _ in TIERS:
        out = F.when(col(tier) == name, rank).otherwise(out)
    return out


def tier_for(raw: Column | str, spoken: Column | str) -> Column:
    """The tier of an automatic track: what it would be against the language spoken (null if unknown)."""
    r, s = col(raw), col(spoken)
    return F.when(s.isNull(), "manual").when(F.lower(r).endswith("-orig"), "asr_platform").when(primary_subtag(r) == primary_subtag(s), "asr_platform").otherwise("translated")
