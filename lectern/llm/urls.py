"""URL filters: allow and block rules, then gradient-boosted trees on lexical features.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lowered; the path follows up to ``?``, ``#`` or the end. A rule such as ``net/es/``
holds for its host and all subdomains where the path starts with the rule's; of those
that hold the longest wins. URLs that no rule settles are judged by boosted trees over
length, depth, digit ratio, entropy, parameter counts, hyphens, runs of characters and
the statistics of suffixes (of the host, and of the path's last part), all fitted on
labelled URLs (a bounded list, by default :func:`labelled_urls`). No word of a host has
a feature. A labelled URL's suffix statistics come from URLs of other hosts: those of
its own fold are left out, so that the trees do not learn to trust what the labels
themselves put there.

Edge cases: a null URL, or one without ``://``, has an empty host and path, matches no
rule and is judged by its characters alone (null as empty). Repeated rows are judged
alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import trees
from lectern.llm.common import workers_see_package

#: The production rules.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
BLOCK_AT = 0.5
_LOWER = {c: c + 32 for c in range(65, 91)}
_DIGITS, _CONSONANTS, _ADDRESS = re.compile("[0-9]+"), re.compile("[b-df-hj-np-tv-xz]+"), re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?::|$)")
FOLDS = 5


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S)
    return m[1].translate(_LOWER), m[2]


class Rules:
    """Longest rule that holds, found by host suffix and then path prefix."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append(("/" + path, rule, verdict))
        #: No more labels of a host are looked at than a rule's host has.
        self.labels = max((h.count(".") + 1 for h in self.by_host), default=0)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = len(host)
        for _ in range(self.labels):
            at = host.rfind(".", 0, at)
            suffix = host[at + 1 :]
            for prefix, rule, verdict in self.by_host.get(suffix, ()) if suffix else ():
                if path.startswith(prefix):
                    if best[0] is None or len(rule) >= len(best[0]):
                        best = (rule, verdict)
                    break
            if at < 0:
                break
        return best


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def _longest(pattern: re.Pattern, text: str) -> int:
    return max(map(len, pattern.findall(text)), default=0)


def suffixes(host: str, path: str) -> list[str]:
    """The last label of a host, its last two, and the ending of the path's last part; empty where there is none."""
    labels = host.split(".") if host else []
    ending = re.search(r"\.([A-Za-z0-9]{1,8})$", path)
    return [labels[-1] if labels else "", ".".join(labels[-2:]) if len(labels) > 1 else "", "/." + ending[1].lower() if ending else ""]


class Suffixes:
    """Log-odds of label 1 by suffix, from labelled URLs; a suffix seen fewer than ``least`` times tells nothing."""

    def __init__(self, rows: list[tuple[list[str], int]], least: int = 5):
        n, bad = Counter(), Counter()
        for found, y in rows:
            n.update(x for x in found if x)
            bad.update(x for x in found if x and y)
        prior = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
        logit = lambda k, m: math.log((k + prior * 2) / (m - k + (1 - prior) * 2))
        self.odds = {k: logit(bad[k], m) - logit(0, 0) for k, m in n.items() if m >= least}

    def of(self, found: list[str]) -> list[float]:
        return [self.odds.get(x, 0.0) for x in found]


class UrlModel:
    """Boosted trees over lexical features and the suffix statistics that they read."""

    def __init__(self, labelled: list[tuple[str, int]], n_trees: int = 80, depth: int = 3, folds: int = FOLDS):
        parts = [split_url(u) for u, _ in labelled]
        found = [suffixes(*x) for x in parts]
        fold = [zlib.crc32((x[1] or h).encode()) % folds for x, (h, _) in zip(found, parts)]
        rows = [(x, y) for x, (_, y) in zip(found, labelled)]
        of_others = [Suffixes([r for r, f in zip(rows, fold) if f != k]) for k in range(folds)]
        x = np.array([[*self.lexical(u), *of_others[f].of(s)] for (u, _), s, f in zip(labelled, found, fold)])
        self.suffixes = Suffixes(rows)
        self.start, self.trees = trees.boost(x, [y for _, y in labelled], n_trees, depth)

    @staticmethod
    def lexical(url: str | None) -> list[float]:
        url = url or ""
        host, path = split_url(url)
        query = url.partition("?")[2].partition("#")[0]
        n, letters = max(1, len(url)), max(1, sum(c.isalpha() for c in host))
        return [
            len(url), len(host), len(path), len(query), host.count("."), path.count("/"), max(map(len, host.split("."))),
            sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), _entropy(url), _entropy(host), _entropy(path),
            query.count("="), query.count("&"), host.count("-"), path.count("-") + path.count("_"), url.count("%"),
            _longest(_DIGITS, url), _longest(_CONSONANTS, host), sum(c in "aeiouy" for c in host) / letters, sum("A" <= c <= "Z" for c in path + query) / n,
            float("@" in host), float(bool(_ADDRESS.match(host))), float(":" in host),
        ]

    def features(self, url: str | None) -> list[float]:
        return [*self.lexical(url), *self.suffixes.of(suffixes(*split_url(url)))]

    def p_block(self, urls: list[str | None]) -> np.ndarray:
        x = np.array([self.features(u) for u in urls], float).reshape(len(urls), -1)
        f = np.full(len(urls), self.start)
        for tree in self.trees:
            f = f + trees.predict(tree, x) if len(urls) else f
        return 1 / (1 + np.exp(-f))


def labelled_urls(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """(url, 1 for unwanted): drawn from rules about shape, the same for the same seed.

    Unwanted: hosts stuffed with hyphens or made of random characters, addresses instead
    of names, many nested labels, long tracking queries, paths of random tokens.
    Ordinary: short names, dated and numbered pages, articles with a telling path, shops
    and forums with a few parameters.
    """
    r = random.Random(seed)
    syll = "al an ar be ber co da de den di el en er es fa for ge ha hel in is ka kin la le lo ma me mi mo na ne no on or pa per ra re ri ro sa se son st ta te ter th ti to ton tre un va ver wa wil".split()
    lower, alnum = string.ascii_lowercase, string.ascii_lowercase + string.digits
    word = lambda lo=1, hi=3: "".join(r.choice(syll) for _ in range(r.randint(lo, hi)))
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    mixed = string.ascii_letters + string.digits
    slug = lambda: "-".join(word() for _ in range(r.randint(2, 9)))
    name = lambda: r.choice([word(2, 3), word(2, 4), f"{word(1, 2)}-{word(1, 2)}", word(1, 2) + word(1, 2)])
    names = [name() for _ in range(400)]  # ordinary hosts have many pages
    fine_end = lambda: r.choice(["com"] * 5 + ["org"] * 3 + ["net"] * 3 + ["edu", "gov", "de", "fr", "es", "it", "io", "co.uk", "example.com", "example.org"])
    odd_end = lambda: r.choice(["com"] * 4 + ["net"] * 2 + ["org", "info", "info", "biz", "top", "xyz", "click", "site", "online", "win"])
    hosts = [(r.choice(["", "", "www.", "blog.", "m.", "docs.", "en.", "shop."]) + x + "." + fine_end()) for x in names]
    few = lambda: r.choice(["", "", "", "#" + word(), f"?page={r.randint(1, 40)}", f"?id={r.randint(1, 99999)}", f"?utm_source={word()}", f"?q={word()}&page={r.randint(1, 9)}", f"?page={r.randint(1, 9)}&ref={pick(lower, 1, 3)}"])
    many = lambda lo=4, hi=12: "?" + "&".join(f"{pick(lower, 1, 7)}={r.choice([pick(mixed, 6, 40), pick('0123456789abcdef', 16, 40), str(r.randint(0, 10**9)), '%3A%2F%2F' + word()])}" for _ in range(r.randint(lo, hi)))
    fine = [
        lambda: f"{r.choice(hosts)}/{r.randint(1999, 2024)}/{r.randint(1, 12):02d}/{r.choice([f'{r.randint(1, 28):02d}/', ''])}{slug()}{r.choice(['', '/', '.html'])}",
        lambda: f"{r.choice(hosts)}/{'/'.join(word() for _ in range(r.randint(1, 4)))}{r.choice(['', '/', '.html', '.htm', '.pdf', '.php'])}{few()}",
        lambda: f"{r.choice(hosts)}/{pick(lower, 2, 2)}/{r.randint(1, 99999)}{r.choice(['', '/', '.html'])}{few()}",
        lambda: f"{r.choice(hosts)}{r.choice(['', '/', '/index.html', '/' + word()])}{few()}",
        lambda: f"{r.choice(hosts)}/{word()}/{slug()}{r.choice(['', '/'])}",
        lambda: f"{r.choice(hosts)}/wiki/{word().title()}_{word().title()}",
        lambda: f"{r.choice(hosts)}/{r.choice(['product', 'item', 'thread', 'topic', 'questions'])}/{r.randint(100, 9999999)}{r.choice(['', '/' + slug()])}{few()}",
    ]
    unwanted = [
        lambda: f"{'-'.join(word() for _ in range(r.randint(3, 7)))}{r.choice(['', str(r.randint(1, 9999))])}.{odd_end()}/{r.choice(['', slug(), word() + '.html'])}{r.choice(['', many(1, 4)])}",
        lambda: f"{pick(alnum, 11, 26)}.{odd_end()}/{r.choice(['', pick(mixed, 6, 30), pick(mixed, 4, 9) + '.php'])}{r.choice(['', many(1, 5)])}",
        lambda: f"{'.'.join(str(r.randint(1, 254)) for _ in range(4))}{r.choice(['', ':' + str(r.randint(1025, 65000))])}/{r.choice([pick(mixed, 3, 20), word() + '.exe', word() + '.php', word() + '/' + pick(alnum, 5, 9)])}{r.choice(['', many(1, 4)])}",
        lambda: f"{'.'.join(r.choice([word(), pick(alnum, 3, 12)]) for _ in range(r.randint(4, 7)))}.{odd_end()}/{r.choice(['', word(), pick(mixed, 8, 30)])}{r.choice(['', many(1, 3)])}",
        lambda: f"{r.choice([name(), word() + str(r.randint(10, 9999))])}.{odd_end()}/{r.choice(['go', 'r', 'click', 'out.php', 'track', word()])}{many()}",
        lambda: f"{word()}{r.randint(10, 99999)}.{odd_end()}/{'/'.join(pick(mixed, 5, 16) for _ in range(r.randint(2, 7)))}{r.choice(['', '.php', '.exe', '.apk', many(1, 4)])}",
    ]
    return [(f"http{r.choice(['', 's'])}://{r.choice(unwanted if y else fine)()}", y) for y in (int(i % 3 == 0) for i in range(n))]


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: list[tuple[str, int]] | None = None, block_at: float = BLOCK_AT, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block: one row per row of pages."""
    spark = pages.sparkSession
    workers_see_package(spark)
    shared = spark.sparkContext.broadcast((Rules(RULES if rules is None else rules), UrlModel(labelled or labelled_urls())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, model = shared.value
        for batch in batches:
            urls = batch.column(1).to_pylist()
            p = model.p_block(urls)
            rows = []
            for u, x in zip(urls, p.tolist()):
                host, path = split_url(u)
                rule, verdict = held.find(host, path)
                rows.append((host, path, rule, verdict or ("block" if x >= block_at else "allow")))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in cols], pa.array(p)], ["page_id", "host", "path", "rule", "verdict", "p_block"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, p_block double")
