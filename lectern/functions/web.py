"""URLs: allow-listing, classification, redaction, identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col, replace_each

#: The video site's hosts and paths.
HOSTS = ("youtube.com", "youtube-nocookie.com", "youtu.be")
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
_VIDEO_PATHS = r"^/(?:embed|shorts|live|v)/+([A-Za-z0-9_-]{11})(?:/|$)"
_CHANNEL = r"^/(?:channel/|c/|user/|results|@)"
_PLAYLIST = r"^/playlist"
PLAYLIST_EMBED = "videoseries"
WATCH = "https://www.youtube.com/watch?v="


def _whole(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column | str) -> Column:
    """The host in lower case, also where the scheme is missing; null if there is none."""
    return F.lower(F.try_parse_url(_whole(col(url)), F.lit("HOST")))


def is_on(url: Column | str, hosts: tuple[str, ...] = HOSTS) -> Column:
    """Whether the host is one of hosts or below one."""
    h = host(url)
    found = F.lit(False)
    for name in hosts:
        found = found | (h == name) | h.endswith("." + name)
    return F.coalesce(found, F.lit(False))


def safe_url(url: Column | str) -> Column:
    """The URL if it is http(s), has a host and nothing that could break out of a link; else null."""
    u = col(url)
    return F.when(~u.rlike(r"[ \t\n\r()<>\"`\\]") & u.rlike(r"(?i)^https?://[^/?#]"), u)


def query_value(url: Column | str, key: str) -> Column:
    return F.try_parse_url(_whole(col(url)), F.lit("QUERY"), F.lit(key))


def _path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(_whole(url), F.lit("PATH")), F.lit(""))


def video_id_in_path(url: Column | str) -> Column:
    u = col(url)
    short = F.regexp_extract(_path(u), r"^/+([A-Za-z0-9_-]{11})(?:/|$)", 1)
    found = F.when((host(u) == "youtu.be") | host(u).endswith(".youtu.be"), short).otherwise(F.regexp_extract(_path(u), _VIDEO_PATHS, 1))
    return F.when((found != "") & (found != PLAYLIST_EMBED), found)


def video_id(url: Column | str) -> Column:
    """The id of one video that a URL, or a bare id, names; null otherwise."""
    u = col(url)
    asked = query_value(u, "v")
    return F.when(u.rlike(VIDEO_ID), u).when(is_on(u), F.coalesce(F.when(asked.rlike(VIDEO_ID) & (asked != PLAYLIST_EMBED), asked), video_id_in_path(u)))


def is_channel(url: Column | str) -> Column:
    return is_on(url) & _path(col(url)).rlike(_CHANNEL)


def is_collection(url: Column | str) -> Column:
    """A playlist, channel or search: more than one video, and not one of a playlist's."""
    u = col(url)
    listed = query_value(u, "list").isNotNull() & query_value(u, "v").isNull() & video_id_in_path(u).isNull()
    return is_on(u) & (_path(u).rlike(_PLAYLIST) | _path(u).rlike(_CHANNEL) | listed)


def is_playlist(url: Column | str) -> Column:
    return is_collection(url) & ~_path(col(url)).rlike(_CHANNEL)


def playlist_id(url: Column | str) -> Column:
    return query_value(url, "list")


def watch_url(source: Column | str) -> Column:
    """A URL on the site as it is; anything else is taken as a bare id."""
    return F.when(is_on(source), col(source)).otherwise(F.concat(F.lit(WATCH), col(source)))


def redact_url(url: Column | str) -> Column:
    """Scheme, host, readable port and path only; what has no scheme and host stays as it is."""
    u = col(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::([^/?#]*))?([^?#]*)"
    part = lambda k: F.regexp_extract(u, pattern, k)
    port = F.when(part(3).rlike(r"^0*[1-9][0-9]{0,4}$") & (part(3).try_cast("int") <= 65535), F.concat(F.lit(":"), part(3).try_cast("int").cast("string"))).otherwise("")
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), port, part(4))).otherwise(u)


def redact(text: Column | str) -> Column:
    """Free text with every http(s) URL redacted."""
    return replace_each(col(text), r"(?i:https?)://(?U)[^\s]+", redact_url)


def content_hash(payload: Column | str) -> Column:
    return F.sha2(col(payload), 256)


def cache_key(*parts: Column | str) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256), F.lit(32))


def hash_prefix(digest: Column | str, n: int = 12) -> Column:
    return F.left(col(digest), F.lit(n))
