"""Main text of pages by a site style tree.

Each page is read into text blocks, each with the path of the elements around it (tag
and presentation: class and id without digits). The trees of all pages of a host are
merged by path. A node's value is one minus the entropy, in units of its greatest
possible value, with which its texts spread over the pages that have it: texts of their
own on each page make a node important, texts that recur from page to page do not. A
text within a node has a value alike, so a notice between paragraphs is told from them.
Values lean on the tree merged over all hosts and, where few pages tell, on one half.

What the markup declares (boilerplate: menus, headers, footers, asides, forms, classes
or ids that say so; content: articles) is a prior, joined with the value as odds. Its
weight is learned by host: the share of what is declared boilerplate that the tree does
not put above what is declared content. Every block has an importance so and is removed below
the threshold. Copies of a page count once on their host.

Statistics are counts by (host, node, text) with partial aggregation, and what is known
of a node, or of a host's node, meets the rows of a very frequent one by broadcast, so a
host with a third of all pages is no single task's work. Pages are read twice, and only
where the tree overrules the markup does a hash of 8 bytes travel to the tasks: one a
node, and one a text that recurs over most pages of a node that stays. Up to MOST_SENT of
them are broadcast and texts never move; beyond, hashes of nodes and texts meet them by a
shuffle, and pages what was found for them.

Edge cases: null and empty pages have an empty text. A null URL belongs to the empty
host. Repeated rows are each extracted. An empty table gives no rows. Broken markup is
read as browsers roughly do: unknown ends are ignored, open elements end with what
holds them. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import _mix, cut, join_hot, workers_see_package
from lectern.llm.urls import split_url

IMPORTANT = 0.5
#: The tree over all hosts counts like this many pages at most.
ENOUGH_PAGES = 8
#: Keys that are sent to every task, 8 bytes each; more of them meet their pages by a join.
MOST_SENT = 4_000_000
#: Importance by markup alone: declared boilerplate, weakly declared inside content, undeclared, content. One of .5 or more is kept where the tree knows nothing.
PRIORS = (0.01, 0.3, 0.5, 0.95)
#: Values of nodes and texts lie within this of 0 and 1: what is plainly declared boilerplate is overruled only where its host's markup has lost trust.
SURE = 0.02

#: Elements by role, and words in a class or id that tell boilerplate.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title", "head", "textarea", "select", "audio", "video"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "header", "fieldset", "label"}
CONTENT = {"article", "main"}
FRAMES = {"form", "fieldset", "label"}
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html", "label", "button", "legend"}
ITEM = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words that tell boilerplate wherever they stand in a class or id.
STRONG = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe signup login sidebar navbar masthead breadcrumb breadcrumbs comment comments commentlist reply replies disqus respond pagination pager".split())
#: Words that do so only beside each other and general ones: an entry's header or related work is content.
WEAK = set("banner notice notices notification alert overlay side rail menu nav navigation footer foot header topbar toolbar discussion share sharing social related recommended widget skip".split())
GENERAL = set("site page main global top bottom left right primary secondary box block container wrapper wrap inner outer bar area section list item items link links slot unit".split())
#: Words before which a class says what something has, not what it is.
HAVING = set("has have with without no not is js hide show".split())
ROLES = set("navigation banner contentinfo complementary search alert dialog form".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(?:\s|^)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")


def _telling(name: str) -> int:
    """2 for one class or id that tells boilerplate by a strong word, 1 by weak ones, else 0."""
    words = _PARTS.findall(name)
    if not words or words[0] in HAVING and len(words) > 1:
        return 0
    if not STRONG.isdisjoint(words):
        return 2
    return int(not WEAK.isdisjoint(words) and all(w in WEAK or w in GENERAL for w in words))


def _look(attributes: str) -> tuple[str, int]:
    """(presentation, how surely it tells boilerplate: 0 to 2)."""
    if not attributes or attributes.isspace():
        return "", 0
    seen, bad = [], 0
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            value = re.sub(r"\d+", "", value)
            seen.append(f"{name[0]}={value}")
            bad = max(bad, *map(_telling, value.split()), 0)
        elif name == "role":
            bad = max(bad, 2 * (value in ROLES))
        elif name == "hidden" or value == "true":
            bad = 2
    return ",".join(seen), bad


def tokens_of(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text, tag, attributes, end of the token) in page order; a tag's text is "/" where it ends an element.

    Quotes within a tag hide its ``>``. Once they would hide the rest of the page they
    are taken for plain characters, so a page is read in time linear in its length.
    The reader may send a place to go on from.
    """
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in "<>\"'"}
    while at < n:
        start = page.find("<", at) if at <= last["<"] else -1
        if start < 0:
            yield page[at:], "", "", n
            return
        if start > at:
            yield page[at:start], "", "", start
        at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            at = n if end < 0 else end + 3
            yield html.escape(page[start + 9 : n if end < 0 else end]), "", "", at
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at)
        if m is None or at > last[">"]:
            at += 1
            yield "<", "", "", at
            continue
        pos, end = m.end(), 0
        while not end:
            stop = _STOP.search(page, pos)
            if stop is None:  # quotes hide all that follows
                last["'"] = last['"'] = -1
                end = page.index(">", m.end()) + 1 if m.end() <= last[">"] else -1
            elif stop[0] == ">":
                end = stop.end()
            else:
                pos = page.index(stop[0], stop.end()) + 1 if stop.start() < last[stop[0]] else stop.end()
        if end < 0:
            at += 1
            yield "<", "", "", at
            continue
        at = end
        sent = yield m[1], m[2].lower(), page[m.end() : end - 1], end
        if sent is not None:
            at = sent


class _Stack:
    """Open elements: tag, hash of the path, whether firmly boilerplate, innermost doubtful frame (0: none), whether in content. The last place of each tag is known, so nothing is searched."""

    def __init__(self):
        self.items: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.solid = [0]  # places of blocks other than paragraphs

    def last(self, tag: str) -> int:
        """The innermost place of an open tag, 0 if there is none."""
        found = self.places[tag]
        return found[-1] if found else 0

    def push(self, tag: str, *rest) -> None:
        self.places[tag].append(len(self.items))
        if tag in BLOCKS and tag != "p":
            self.solid.append(len(self.items))
        self.items.append((tag, *rest))

    def cut(self, place: int) -> None:
        for tag, *_ in self.items[place:]:
            self.places[tag].pop()
        del self.items[place:]
        while self.solid[-1] >= place:
            self.solid.pop()


_PARTNERS = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}


def blocks_of(page: str) -> list[tuple[int, int, str]]:
    """(hash of the path, index in PRIORS, text) of each block with text, in page order, in time linear in the page.

    A form, or what a class or id calls boilerplate, is not held to be any if it holds
    an article and over half of the page's text: it is the page's frame.
    """
    out: list[tuple[int, bool, int, bool, str]] = []
    stack = _Stack()
    parts: list[str] = []
    outer, weak, holding = [0], [False], set()  # of doubtful frames, numbered from 1: the one around it, whether declared weakly; those around an article

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((*stack.items[-1][1:], text))

    def close(place: int) -> None:
        flush()
        stack.cut(place)

    tokens, sent = tokens_of(page), None
    while True:
        try:
            text, tag, attributes, at = tokens.send(sent)
        except StopIteration:
            break
        sent = None
        if not tag:
            parts.append(text)
            continue
        if text:
            if place := stack.last(tag):
                close(place)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            if tag != "head" and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                sent = stop.end() if stop else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            if tag == "hr":
                flush()
            continue
        presentation, bad = _look(attributes)
        if tag not in BLOCKS and not bad:
            continue
        if tag in ENDS_P or tag in ITEM:
            ended = max(stack.last("p") if tag in ENDS_P else 0, stack.last(tag) if tag in ITEM else 0, stack.last(_PARTNERS[tag]) if tag in _PARTNERS else 0)
            held = max(map(stack.last, ITEM[tag])) if tag in ITEM else stack.solid[-1]
            if ended > held:
                close(ended)
        flush()
        _, path, firm, frame, content = stack.items[-1]
        if tag in ("body", "html"):
            bad = 0
        elif tag in CONTENT and bad < 2:
            k = frame
            while k and k not in holding:  # a frame that is marked has those around it marked
                holding.add(k)
                k = outer[k]
            content, bad = True, 0
        if tag in BOILERPLATE - FRAMES and not (tag == "header" and content):
            firm = True
        elif bad or tag in FRAMES:
            outer.append(frame)
            weak.append(bad == 1 and tag not in FRAMES)
            frame = len(outer) - 1
        stack.push(tag, _hash(f"{path}/{tag}[{presentation}]"), firm, frame, content)
    flush()
    sizes = [0] * len(outer)
    for _, _, frame, _, text in out:
        sizes[frame] += len(text)
    total = sum(sizes)
    for k in range(len(outer) - 1, 0, -1):
        sizes[outer[k]] += sizes[k]
    held, strong = [False] * len(outer), [False] * len(outer)  # whether a block in this frame is in one that is boilerplate; in one strongly declared
    for k in range(1, len(outer)):
        own = not (k in holding and 2 * sizes[k] > total)
        held[k], strong[k] = held[outer[k]] or own, strong[outer[k]] or own and not weak[k]

    def look(firm: bool, frame: int, content: bool) -> int:
        if firm or held[frame]:
            return int(not firm and content and not strong[frame])
        return 3 if content else 2

    return [(path, look(firm, frame, content), text) for path, firm, frame, content, text in out]


class _Nodes(dict):
    """(hash of the path, index in PRIORS) -> 64-bit hash, remembered."""

    def __missing__(self, key: tuple[int, int]) -> int:
        if len(self) > 100_000:
            self.clear()
        path, look = key
        found = self[key] = _hash(f"{look}{path}")
        return found


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def seen(pages: DataFrame) -> DataFrame:
    """(url, html) -> host (hash), page (hash), nodes (node, look, text hash; null once for the page itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Nodes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hosts, prints, nodes = [], [], []
                for url, page in zip(part.column("url").to_pylist(), part.column("html")):
                    page = page.as_py() or ""
                    found = {(known[p, look], look, _hash(t)) for p, look, t in blocks_of(page)}
                    found |= {(node, look, None) for node, look, _ in found}
                    hosts.append(_hash(split_url(url)[0] or ""))
                    prints.append(_hash(page))
                    nodes.append([{"node": a, "look": b, "text": c} for a, b, c in found])
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(prints, pa.int64()), pa.array(nodes, kind_of)], ["host", "page", "nodes"])

    kind_of = pa.list_(pa.struct([("node", pa.int64()), ("look", pa.int8()), ("text", pa.int64())]))
    return pages.select("url", "html").mapInArrow(run, "host long, page long, nodes array<struct<node:long,look:byte,text:long>>")


def spread(pages: DataFrame) -> DataFrame:
    """(host, page, nodes) -> host, node, look, text, n: the distinct pages of a host with a text in a node; with the node where text is null."""
    once = pages.groupBy("host", "page").agg(F.first("nodes").alias("nodes"))
    return once.select("host", F.inline("nodes")).groupBy("host", "node", "look", "text").agg(F.count("*").alias("n"))


def values(counts: DataFrame) -> DataFrame:
    """(host, node, look, text, n) -> host, node, look, m (pages), value: the merged style trees."""
    text, n = F.col("text"), F.col("n")
    # of a node's texts, each spread evenly over n of its m pages: the mean entropy log n / log m
    sums = [F.sum(F.when(text.isNull(), n)).alias("m"), F.sum(F.when(text.isNotNull(), n)).alias("k"), F.sum(F.when(text.isNotNull(), n * F.log("n"))).alias("e")]
    own = counts.groupBy("host", "node", "look").agg(*sums)
    every = counts.groupBy("node", "text").agg(F.sum("n").alias("n")).groupBy("node").agg(*sums).select("node", *[F.col(c).alias(f"{c}_all") for c in "mke"])
    of = lambda m, k, e: F.when(m > 1, 1 - e / k / F.log(m)).otherwise(0.0)
    m, m_all = F.col("m"), F.col("m_all")
    few = F.least(m_all - 1, F.lit(ENOUGH_PAGES))
    value = ((m - 1) * of(m, F.col("k"), F.col("e")) + few * of(m_all, F.col("k_all"), F.col("e_all")) + 0.5) / (m + few)
    # a node such as /html/body/div is on most hosts
    return join_hot(cut(own, "own"), every, ["node"]).select("host", "node", "look", "m", value.alias("value"))


def trusts(nodes: DataFrame) -> DataFrame:
    """values -> host, trust: the share of what the markup declares boilerplate whose value is not above that of what it declares content, by more than SURE."""
    w, value, look = F.col("m") - 1, F.col("value"), F.col("look")
    content = nodes.where(look == len(PRIORS) - 1).groupBy("host").agg(F.try_divide(F.sum(w * value), F.sum(w)).alias("content"))
    declared = nodes.where(look < 2).join(content, "host")
    below = F.sum(F.when(value <= F.col("content") + SURE, w).otherwise(0))
    return declared.where("content is not null").groupBy("host").agg(((below + ENOUGH_PAGES) / (F.sum(w) + ENOUGH_PAGES)).alias("trust"))


def importance(value: Column, look: Column, trust: Column) -> Column:
    """value and the markup's prior as odds, the prior's raised to trust."""
    prior = F.element_at(F.array(*[F.lit(p) for p in PRIORS]), look.cast("int") + 1)
    v = F.least(F.greatest(value, F.lit(SURE)), F.lit(1 - SURE))
    odds = v / (1 - v) * F.pow(prior / (1 - prior), trust)
    return F.round(odds / (1 + odds), 12)


def overruled(counts: DataFrame, important: float) -> DataFrame:
    """host, node, text: nodes (text null) where the tree decides otherwise than the markup, and texts that go from nodes that stay."""
    nodes = cut(values(counts), "values")
    nodes = join_hot(nodes, trusts(nodes), ["host"], "left").withColumn("trust", F.coalesce("trust", F.lit(1.0)))
    declared = F.element_at(F.array(*[F.lit(p >= important) for p in PRIORS]), F.col("look").cast("int") + 1)
    nodes = nodes.withColumn("stays", importance(F.col("value"), F.col("look"), F.col("trust")) >= important)
    turned = nodes.where(F.col("stays") != declared).select("host", "node", F.lit(None).cast("long").alias("text"))
    # one host may hold a third of all pages, and its articles most of their texts
    shared = join_hot(counts.where("text is not null and n > 1"), nodes.where("stays").drop("look"), ["host", "node"])
    value = ((F.col("m") - 1) * (1 - F.log("n") / F.log("m")) + 0.5) / F.col("m")
    gone = shared.where(importance(value, F.col("look"), F.col("trust")) < important).select("host", "node", "text")
    return turned.union(gone)


def _key(host: np.ndarray, node: np.ndarray, text: np.ndarray) -> np.ndarray:
    host, node, text = (np.asarray(x, np.int64).view(np.uint64) for x in (host, node, text))
    return _mix(_mix(_mix(host) + node) + text)


def keyed(rows: DataFrame) -> DataFrame:
    """(host, node, text) -> key: their hash; a null text counts as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key(*[batch.column(c).to_numpy() for c in ("host", "node", "text")])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return rows.select("host", "node", F.coalesce("text", F.lit(0)).alias("text")).mapInArrow(run, "key long").distinct()


def keys_of_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """host, page, keys: of each distinct page (host, page, nodes) those keys that its own nodes and texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key(*[batch.column(c).to_numpy() for c in ("host", "node", "text")])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(key.view(np.int64))], ["host", "page", "key"])

    once = pages.groupBy("host", "page").agg(F.first("nodes").alias("nodes")).select("host", "page", F.inline("nodes"))
    own = once.select("host", "page", "node", F.coalesce("text", F.lit(0)).alias("text")).mapInArrow(run, "host long, page long, key long")
    # a node may be on most pages
    return join_hot(cut(own, "own"), keys, ["key"]).groupBy("host", "page").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found if len(keys) else np.zeros(len(found), bool)


def extract(pages: DataFrame, important: float = IMPORTANT, page_id: str = "page_id", url: str = "url", page: str = "html", most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of pages."""
    spark = pages.sparkSession
    workers_see_package(spark)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    keys = cut(keyed(overruled(cut(spread(seen(rows)), "spread"), important)), "keys")
    if keys.count() <= most_sent:
        shared = spark.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy().view(np.uint64)))
        rows = rows.withColumn("keys", F.lit(None).cast("array<long>"))
    else:  # each page meets its own keys; of copies of a page, which may be very many, by broadcast
        shared = None
        rows = join_hot(hashed(rows), keys_of_pages(seen(rows), keys), ["host", "page"], "left").select("page_id", "url", "html", F.coalesce("keys", F.array().cast("array<long>")).alias("keys"))
    declared = np.array(PRIORS) >= important

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Nodes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for url, page, own in zip(part.column("url").to_pylist(), part.column("html"), part.column("keys")):
                    found = blocks_of(page.as_py() or "")
                    keys = shared.value if shared else np.sort(own.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                    node = np.array([known[p, look] for p, look, _ in found], np.int64)
                    host = np.full(len(found), _hash(split_url(url)[0] or ""), np.int64)
                    stays = declared[[look for _, look, _ in found]] if found else np.zeros(0, bool)
                    stays = (stays ^ _among(keys, _key(host, node, np.zeros_like(node)))) & ~_among(keys, _key(host, node, np.array([_hash(t) for *_, t in found], np.int64)))
                    texts.append(" ".join(found[i][2] for i in np.flatnonzero(stays)))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def hashed(rows: DataFrame) -> DataFrame:
    """(page_id, url, html) and host, page as :func:`seen` hashes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hosts = [_hash(split_url(u)[0] or "") for u in part.column("url").to_pylist()]
                prints = [_hash(p.as_py() or "") for p in part.column("html")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hosts, pa.int64()), pa.array(prints, pa.int64())], ["page_id", "url", "html", "host", "page"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, html string, host long, page long")
