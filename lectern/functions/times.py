"""Times, dates and numbers: clocks, stamps, deep links, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col

CLOCK = r"(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})[.,]([0-9]{1,3})"


def parse_clock(text: Column | str) -> Column:
    """[HH:]MM:SS[.,]mmm -> seconds; null for anything else."""
    t = F.trim(F.regexp_replace(col(text), r"(?U)\s", " "))
    part = lambda k: F.regexp_extract(t, f"^{CLOCK}$", k)
    seconds = F.coalesce(F.expr("try_cast(null as int)"), F.when(part(1) == "", 0).otherwise(part(1).try_cast("bigint"))) * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int")
    return F.when(t.rlike(f"^{CLOCK}$"), seconds + F.rpad(part(4), 3, "0").try_cast("int") / 1000)


def format_timestamp(seconds: Column | str) -> Column:
    """M:SS, or H:MM:SS from an hour on; fractions are cut off."""
    s = col(seconds).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def format_date(day: Column | str) -> Column:
    return F.coalesce(F.date_format(col(day), "d MMMM yyyy"), F.lit("n.d."))


def format_apa_date(day: Column | str) -> Column:
    return F.coalesce(F.date_format(col(day), "yyyy, MMMM d"), F.lit("n.d."))


def parse_compact_date(text: Column | str) -> Column:
    return F.when(col(text).rlike("^[0-9]{8}$"), F.try_to_date(col(text), "yyyyMMdd"))


def finite_or_null(value: Column | str) -> Column:
    v = col(value).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def whole_minutes(seconds: Column | str) -> Column:
    return F.floor(col(seconds) / 60).cast("int")


def not_negative(value: Column | str) -> Column:
    return F.greatest(col(value), F.lit(0.0))


def half_even(value: Column | str) -> Column:
    """A whole number as text, halves to even."""
    return F.bround(col(value), 0).cast("bigint").cast("string")


def link_at(url: Column | str, start: Column | str) -> Column:
    """A deep link into a recording; null without a URL."""
    u = col(url)
    return F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("t="), col(start).cast("bigint").cast("string"))


def reference_at(section: Column | str, start: Column | str) -> Column:
    """[section, stamp], or [stamp] without a section."""
    stamp = format_timestamp(start)
    return F.when(col(section).isNull(), F.concat(F.lit("["), stamp, F.lit("]"))).otherwise(F.concat(F.lit("["), col(section), F.lit(", "), stamp, F.lit("]")))
