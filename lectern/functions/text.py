"""Text: white space, tokens, markup removal, escaping, names, sizes."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that only some engines count.
SPACE = r"(?U)[\s\x1c-\x1f]"
EDGES = ".,;:!?\"'()[]{}—–-"
_EDGE_CLASS = r"[.,;:!?\"'()\[\]{}—–\-]"
#: Characters with a meaning in Markdown, forbidden in file names, and reserved device names.
_ACTIVE = r"([\\\[\]<>`])"
_ACTIVE_IN_LABEL = r"([\\\[\]<>`|])"
_FORBIDDEN = r"[<>:\"/\\|?*\x00-\x1f]"
_DEVICES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
MAX_STEM = 120
FALLBACK_STEM = "lecture"
WORDS_PER_TOKEN = 0.75


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where a lambda inside body reads it."""
    return F.transform(F.array(value), body)[0]


def normalise(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACE + "+", " "))


def strip_left(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "^" + SPACE + "+", "")


def tokens(text: Column | str) -> Column:
    """The words between white space."""
    return F.filter(F.split(col(text), SPACE + "+"), lambda x: x != "")


def n_tokens(text: Column | str) -> Column:
    return F.size(tokens(text))


def replace_each(text: Column, pattern: str, replacement) -> Column:
    """Every match of pattern, found in one pass over the original text, replaced by replacement(match)."""

    def joined(m: Column, s: Column) -> Column:
        return F.concat(F.array_join(F.transform(m, lambda x, i: F.concat(F.get(s, i), replacement(x))), ""), F.element_at(s, -1))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, text).otherwise(let(F.split(text, pattern, -1), lambda s: joined(m, s))))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "<[^>]*>", "")


#: Characters that stand for numbers which name none: the C1 range as in Windows-1252.
_RENAMED = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_NAMES = html.entities.html5  # "amp;" and, where the semicolon may be left out, "amp"
_BARE = {k: v for k, v in _NAMES.items() if not k.endswith(";")}
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"


def _table(of: dict[str, str]) -> Column:
    """A map literal; one constant, however many entries."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in of.items())), F.lit("\x02"), F.lit("\x01"))


def _character(n: Column) -> Column:
    """The character of a code point as HTML reads it; none for those that are no characters."""
    none = n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000).isin(0xFFFE, 0xFFFF)
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    renamed = F.try_element_at(_table({str(k): v for k, v in _RENAMED.items()}), n.cast("string"))
    return F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when((n == 0) | (n == 13) | n.between(0x80, 0x9F), renamed).when(none, "").otherwise(own)


def _referred(match: Column) -> Column:
    """What one reference stands for; an unknown name stands for itself, but for a known one that it begins with."""
    name = F.substring(match, 2, 64)
    number = F.ltrim(F.regexp_extract(match, "^&#[xX]?([0-9a-fA-F]+)", 1), F.lit("0"))
    base = F.when(match.rlike("^&#[xX]"), 16).otherwise(10)
    # more digits than any character has
    n = F.when(F.length(number) > 8, 0x110000).when(number == "", 0).otherwise(F.conv(number, 16, 10).cast("long"))
    decimal = F.when(F.length(number) > 8, 0x110000).when(number == "", 0).otherwise(number.try_cast("long"))
    by_number = _character(F.when(base == 16, n).otherwise(decimal))
    bare = _table(_BARE)
    prefixes = [F.when(F.length(name) > k, F.concat(F.try_element_at(bare, F.left(name, F.lit(k))), F.substring(match, k + 2, F.length(match)))) for k in range(max(map(len, _BARE)), 1, -1)]
    return F.when(match.startswith("&#"), by_number).otherwise(F.coalesce(F.try_element_at(_table(_NAMES), name), *prefixes, match))


def unescape(text: Column | str) -> Column:
    """All named and numeric character references, each read once."""
    return F.when(F.contains(col(text), F.lit("&")), replace_each(col(text), _REFERENCE, _referred)).otherwise(col(text))


def label(text: Column | str) -> Column:
    """One line, with what Markdown would act on escaped, table bars included."""
    return F.regexp_replace(normalise(text), _ACTIVE_IN_LABEL, r"\\$1")


def body(text: Column | str) -> Column:
    """Escaped text; runs of # ~ = - that open a line are escaped too."""
    return F.regexp_replace(F.regexp_replace(col(text), _ACTIVE, r"\\$1"), r"(?m)^((?U)\s*)([#~=-]+)", r"$1\\$2")


def body_resumed(text: Column | str) -> Column:
    """As body, for text that goes on in the middle of a line: its own beginning opens none."""
    return F.regexp_replace(F.regexp_replace(col(text), _ACTIVE, r"\\$1"), r"(?<=\n)((?U)\s*)([#~=-]+)", r"$1\\$2")


def _trim_stem(text: Column) -> Column:
    return F.regexp_replace(text, r"[. ]+$", "")


def truncate_stem(text: Column | str, most: int = MAX_STEM) -> Column:
    """At most ``most`` characters, cut at the last space if that keeps over half of them."""

    def cut(c: Column) -> Column:
        at = F.length(c) - F.instr(F.reverse(c), " ")
        space = F.when(F.instr(c, " ") > 0, F.left(c, at)).otherwise(c)
        return _trim_stem(F.when(F.length(space) > most // 2, space).otherwise(c))

    return F.when(F.length(col(text)) > most, let(F.left(col(text), F.lit(most)), cut)).otherwise(col(text))


def sanitise(title: Column | str) -> Column:
    """A file name's stem: no forbidden characters, no dots or spaces at its end, no device name."""
    cleaned = truncate_stem(_trim_stem(normalise(F.regexp_replace(col(title), _FORBIDDEN, " "))))
    return let(cleaned, lambda c: F.when(c.rlike(_DEVICES), F.concat(c, F.lit("_"))).otherwise(c))


def describe_size(size: Column | str) -> Column:
    n = col(size)
    return F.when(n < 1024, F.format_string("%d bytes", n)).when(n < 1024 * 1024, F.format_string("%.1f KiB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MiB", F.bround(n / (1024 * 1024), 1)))


def estimate_tokens(text: Column | str) -> Column:
    return F.floor(n_tokens(text) / WORDS_PER_TOKEN).cast("int")


def has_digit(text: Column | str) -> Column:
    return col(text).rlike(r"\p{Nd}|[²³¹⁰-₉]")


def casefold(text: Column | str) -> Column:
    """Unicode's full case folding, but for Cherokee letters."""
    # dotless i must not meet i; the translation between also keeps the optimizer from dropping the upper case
    upper = F.upper(F.translate(col(text), "ıẞ", "\ue000ß"))
    return F.translate(F.lower(F.translate(upper, "\ue000", "ı")), "ς", "σ")


def fold(text: Column | str) -> Column:
    """Case folded, white space collapsed, punctuation off the edges of every word."""
    edges = f"^{_EDGE_CLASS}+|{_EDGE_CLASS}+$"
    return F.trim(casefold(F.array_join(F.transform(tokens(text), lambda w: F.regexp_replace(w, edges, "")), " ")))


def strip_edges(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{_EDGE_CLASS}+|{_EDGE_CLASS}+$", "")
