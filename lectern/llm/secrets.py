"""Secret scans with a random forest against false positives, in DataFrame functions only.

Candidates are what the pattern below matches anywhere in the whole text: private-key
blocks (PGP's too, to their END line), provider tokens, passwords of logins in URLs,
values assigned to telling names (up to the closing quote where there is one), and runs
of 24 characters or more that mix letters and digits. Each is described by its length, its character transitions, how
much of it dictionary words cover, signs of a path, and the words next to it. A random
forest, fitted on labelled findings (a bounded list, by default :func:`labelled_findings`)
and compiled to a DataFrame expression, tells secrets from look-alikes. Rows never leave
their task: no shuffle, no Python.

Edge cases: null and empty texts have no findings and stay as they are. Repeated rows
are scanned alike. An empty table gives no rows. Other columns pass through
:func:`redact` untouched.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import trees
from lectern.llm.common import let

#: Names whose values are candidates, provider prefixes, dictionary words, telling neighbours.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
PROVIDERS = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[\w-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{35}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*"
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?>(?s:.*?)-----(?=(?:BEGIN|END) ))END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?"
URL_LOGIN = r"(?<![0-9A-Za-z+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/?#:@\"'<>]*+:"
ASSIGNED = rf"(?<![\w.-])(?=[\w.-]*?(?i:{NAMES}))[\w.-]++[\"']?\s*+[:=]{{1,2}}\s*+"
#: A value up to its closing quote in the line, else up to white space or a separator.
ASSIGNED_VALUE = r"(?:\"[^\"\n]{6,}+(?=\")|'[^'\n]{6,}+(?=')|[\"']?[^\s\"',;]{6,}+)"
#: 24 characters or more of keys and hashes with a letter and a digit among them, wherever these are.
RUN = r"(?<![\w+/-])(?=[A-Za-z/+_-]*+[0-9])(?=[0-9/+_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+={0,2}"
WORDS = "example|sample|dummy|test|demo|fake|foo|bar|baz|lorem|ipsum|change|replace|insert|enter|your|my|the|this|here|value|string|none|null|true|false|undefined|todo|redacted|hidden|masked|placeholder|password|passwd|secret|token|apikey|key|user|admin|root|login|name|default|config|env|process|get|set|self|request|response|header|param|file|path|home|usr|var|etc|bin|lib|src|main|index|module|package|version|build|release|class|function|return|import|http|https|www|com|org|net|html|json|xml|yaml|text|data|table|column|field|type|number|date|time|hash|commit|branch|license|public|private|local|host|server|client|service|system|please|note|required|optional|abc|qwerty|welcome|letmein"
BENIGN = "example|sample|dummy|placeholder|commit|sha1|sha256|md5|checksum|digest|revision|uuid|guid|etag|isbn|doi|version|blob|tree|hash"
TELLING = f"{NAMES}|bearer|authorization|key|login|export"

PATTERN = rf"{KEY_BLOCK}|{URL_LOGIN}[^\s/?#@\"'<>]++(?=@)|(?<![0-9A-Za-z])(?:{PROVIDERS})|{ASSIGNED}{ASSIGNED_VALUE}|{RUN}"
NEIGHBOUR_CHARS = 40
SECRET_AT = 0.5
_STEP = 128


def features(before: Column, value: Column, kind: Column) -> list[Column]:
    """The numbers that the forest reads, in order."""
    n = F.greatest(F.length(value), F.lit(1))
    count = lambda p: F.length(value) - F.length(F.regexp_replace(value, p, ""))
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9]+", "_"), "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"))
    low = F.lower(value)
    flag = lambda c: c.cast("double")
    return [
        n.cast("double"),
        runs / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        (F.length(low) - F.length(F.regexp_replace(low, f"(?:{WORDS})", ""))) / n,
        count("[aeiouyAEIOUY]") / F.greatest(count("[A-Za-z]"), F.lit(1)),
        count(r"[/\\]").cast("double"),
        flag(value.rlike(r"^(?:\.{0,2}/|~/|[A-Za-z]:\\|https?:)|\.(?:py|js|java|html?|json|ya?ml|txt|png|jpg|so|dll|conf)$")),
        count(r"[${}<>()\[\]*]") / n,
        flag(F.lower(before).rlike(f"(?:{BENIGN})")),
        flag(F.lower(before).rlike(f"(?:{TELLING})") | (kind == "url")),
        flag(kind.isin("assigned", "url")),
        flag(kind == "provider"),
        flag(value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
        count(r"\s") / n,
    ]


def candidates(text: Column, forest: list | None) -> Column:
    """array<struct<gap, before, match, value, kind, start, end, p>> of a text: gap is what lies between a candidate and the one before it; start and end of the value in code points, the end not included."""

    def found(m: Column, s: Column) -> Column:
        sizes = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(s, i)))
        add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

        def at(lens: Column) -> Column:
            # sums by steps, then sums of those: a prefix sum that stays cheap for very many candidates
            steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / _STEP).cast("int")), lambda b: add(F.slice(lens, b * _STEP + 1, F.lit(_STEP))))

            def with_steps(st: Column) -> Column:
                whole = F.transform(st, lambda x, b: add(F.slice(st, F.lit(1), b)))

                def one(w: Column) -> Column:
                    def entry(x: Column, i: Column) -> Column:
                        b = F.floor(i / _STEP).cast("int")
                        start = F.get(w, b) + add(F.slice(lens, b * _STEP + 1, i - b * _STEP)) + F.length(F.get(s, i))
                        assigned = F.regexp_extract(x, f"^{ASSIGNED}[\"']?(.*)$", 1)
                        login = F.regexp_extract(x, f"^{URL_LOGIN}(.*)$", 1)
                        kind = F.when(x.startswith("-----BEGIN"), "key_block").when(login != "", "url").when(assigned != "", "assigned").when(x.rlike(f"^(?:{PROVIDERS})"), "provider").otherwise("run")
                        value = F.when(kind == "assigned", assigned).when(kind == "url", login).otherwise(x)
                        near = F.concat(F.right(F.get(s, i), F.lit(NEIGHBOUR_CHARS)), F.left(x, F.length(x) - F.length(value)))
                        return F.struct(F.get(s, i).alias("gap"), near.alias("before"), x.alias("match"), value.alias("value"), kind.alias("kind"), (start + F.length(x) - F.length(value)).cast("long").alias("start"), (start + F.length(x)).cast("long").alias("end"))

                    return F.transform(m, entry)

                return let(whole, one)

            return let(steps, with_steps)

        return let(sizes, at)

    def described(c: Column) -> Column:
        if forest is None:
            return c
        f = F.array(*features(c["before"], c["value"], c["kind"]))

        def scored(v: Column) -> Column:
            p = sum((trees.as_column(t, [F.get(v, F.lit(i)) for i in range(N_FEATURES)]) for t in forest[1:]), trees.as_column(forest[0], [F.get(v, F.lit(i)) for i in range(N_FEATURES)])) / len(forest)
            return F.when(c["kind"] == "key_block", F.lit(1.0)).otherwise(p)

        return let(f, scored)

    none = F.array().cast("array<struct<gap:string,before:string,match:string,value:string,kind:string,start:bigint,end:bigint>>")
    of = lambda t: let(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(t, PATTERN, -1), lambda s: found(m, s))))
    base = let(F.coalesce(text.cast("string"), F.lit("")), of)
    if forest is None:
        return base
    return F.transform(base, lambda c: F.struct(c["gap"].alias("gap"), c["before"].alias("before"), c["match"].alias("match"), c["value"].alias("value"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), described(c).alias("p")))


N_FEATURES = 16


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, int]]:
    """(a line with one candidate, 1 for a secret): drawn from rules, the same for the same seed."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_key", "client_secret", "db_password"]
    words = WORDS.split("|")
    syll = ["er", "on", "th", "en", "re", "an", "ti", "ha", "le", "ou", "sch", "ung", "ción", "eau"]
    prose = lambda k: " ".join("".join(r.choice(syll) for _ in range(r.randint(1, 4))) for _ in range(k))
    assign = lambda v: f"{r.choice(names)}{r.choice(['=', ' = ', ': ', ':', '=='])}{r.choice(['', chr(34)])}{v}"
    quoted = lambda v: f"{r.choice(names)}{r.choice(['=', ' = ', ': '])}{chr(34)}{v.strip().ljust(6, '.')}{chr(34)}"
    good = [
        lambda: assign(pick(hexa, r.randint(14, 64))),
        lambda: assign(pick(b62, r.randint(10, 48))),
        lambda: assign(pick(b64, r.randint(20, 60))),
        lambda: assign(pick(b62 + "!@#%^&*", r.randint(8, 20))),
        lambda: quoted(pick(b62 + "!@#%^&*;,. ", r.randint(10, 24))),
        lambda: f"AKIA{pick(string.ascii_uppercase + string.digits, 16)}",
        lambda: f"ghp_{pick(b62, 36)}",
        lambda: f"sk-{pick(b62, 40)}",
        lambda: f"export {r.choice(names).upper()} {pick(b62, 32)}",
        lambda: f"Authorization: Bearer {pick(b62, 40)}",
    ]
    bad = [
        lambda: assign(r.choice(["your", "my", "the"]) + "_" + r.choice(words) + "_" + r.choice(["here", "key", "token", "value"])),
        lambda: assign(r.choice(["changeme", "password", "example", "placeholder", "undefined", "redacted", "REPLACE_ME"]) + r.choice(["", "1", "123", "here"])),
        lambda: assign(r.choice("x*0.-") * r.randint(6, 24)),
        lambda: assign("${" + r.choice(names).upper() + "}"),
        lambda: assign("<" + r.choice(names) + "-here>"),
        lambda: assign(r.choice(["os.environ[", "process.env.", "config.get(", "self."]) + r.choice(names).upper()),
        lambda: assign("".join(r.choice(words) for _ in range(r.randint(2, 4)))),
        lambda: assign("".join(r.choice(syll) for _ in range(r.randint(3, 6)))),
        lambda: quoted(prose(r.randint(3, 12)).capitalize() + r.choice(["", ".", "!"])),
        lambda: quoted(f"Enter {r.choice(['your', 'the'])} {r.choice(words)} {r.choice(['here', 'again', 'now'])}"),
        lambda: f"{r.choice(['commit', 'sha1', 'revision', 'etag', 'checksum', 'md5'])} {pick(hexa, r.choice([32, 40, 64]))}",
        lambda: f"uuid {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
        lambda: "/".join(["", *[r.choice(words) + r.choice(["", "2", "64"]) for _ in range(r.randint(4, 7))], "file2"]),
        lambda: "_".join(r.choice(words) for _ in range(6)) + "_v2",
        lambda: f"example {assign(pick(b62, 20))}",
        lambda: "-".join("".join(r.choice(syll) for _ in range(3)) for _ in range(4)) + "-2024",
    ]
    return [(f"{prose(r.randint(0, 5))} {r.choice(good if y else bad)()} {prose(3)}", y) for y in (i % 2 for i in range(n))]


def fit(spark, labelled: DataFrame | None = None, n_trees: int = 16, depth: int = 6) -> list:
    """A forest from labelled(text with one finding, label 0 or 1), at most trees.MOST_ROWS rows."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_findings(), "text string, label int")
    found = F.get(candidates(F.col("text"), None), F.lit(0))
    c = F.col("c")
    rows = labelled.select("label", F.inline(F.array(F.struct(found.alias("c"))))).where("c is not null").select("label", F.array(*features(c["before"], c["value"], c["kind"])).alias("f")).take(trees.MOST_ROWS + 1)
    return trees.forest(np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows]), n_trees, depth)


def scan(docs: DataFrame, forest: list | None = None, secret_at: float = SECRET_AT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, end, kind, fingerprint, p_secret, is_secret: a row per candidate, look-alikes with is_secret false."""
    forest = forest or fit(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(candidates(F.col(text), forest)).alias("c"))
    return rows.select("doc_id", "c.start", "c.end", "c.kind", F.left(F.sha2(F.col("c.value"), 256), F.lit(16)).alias("fingerprint"), F.col("c.p").alias("p_secret"), (F.col("c.p") >= secret_at).alias("is_secret"))


def redact(docs: DataFrame, forest: list | None = None, secret_at: float = SECRET_AT, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with each secret in their text replaced by mark."""
    forest = forest or fit(docs.sparkSession)

    def clean(t: Column) -> Column:
        def rebuilt(found: Column) -> Column:
            name = lambda c: F.left(c["match"], F.length(c["match"]) - F.length(c["value"]))
            parts = F.transform(found, lambda c: F.concat(c["gap"], F.when(c["p"] >= secret_at, F.concat(name(c), F.lit(mark))).otherwise(c["match"])))
            rest = F.substring(t, (F.element_at(found, -1)["end"] + 1).cast("int"), F.length(t))
            return F.when(F.size(found) == 0, t).otherwise(F.concat(F.array_join(parts, ""), rest))

        return let(candidates(t, forest), rebuilt)

    return docs.withColumn(text, clean(F.col(text)))
