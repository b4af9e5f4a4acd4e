"""Watched names in running text: what a window of words is to the names of its source.

One pass over the passages finds all hits; only hits leave the task. Names for all
sources go to every task in blocks of bounded size (more names mean more passes, whose
findings are then put together), names of single sources travel with their passages.

A worker remembers what it knows of a phrase. A new one is looked up among known wrong
forms and spellings; else a table by the parts that few edits must leave whole proposes
terms of its length (Pass-Join, Li et al. 2011), a comparison of their letters drops
most, and the phrase runs through the Levenshtein automaton of each that is left, a
machine of one bit a letter and edit that stops as soon as all of its states are dead.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import EDGES
from lectern.sources.shared import cut, dealt, workers_see_package

#: From so many letters on a name may be two edits away, below one.
LONG = 10
#: Names of a block, and letters in them, at most.
BLOCK_NAMES, BLOCK_LETTERS = 100_000, 1 << 24
#: Phrases that a worker remembers before it starts anew.
MEMO = 400_000
#: Sources whose names a worker holds at once.
SOURCES = 64
FORM, KNOWN, GUESS = range(3)
#: What is known of a term, and of a known wrong form.
_COLUMNS = (("term", "folded", "origin", "term_idx", "words", "watched"), ("folded", "term", "evidence"))
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"\d|[²³¹⁰-₉]")
_INFLECTED = ("s", "es", "'s", "’s")
#: Small letters of Cherokee stay what they are, as functions.text.casefold has them.
_CHEROKEE = {0x13A0 + k: 0xAB70 + k for k in range(80)} | {0x13F0 + k: 0x13F8 + k for k in range(6)}


def folded(word: str) -> str:
    """A word as functions.text.fold has it."""
    out = word.strip(EDGES).casefold()
    return out if out.isascii() else out.translate(_CHEROKEE)


def parts(length: int) -> list[tuple[int, int]]:
    """(start, size) of the parts of a term: one more than the edits it is allowed, nearly equal, the longer ones last."""
    k = 3 if length >= LONG else 2
    base, longer = divmod(length, k)
    sizes = [base + (i >= k - longer) for i in range(k)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


class Automaton:
    """The Levenshtein automaton of a term with so many edits, as one number of live states a number of edits."""

    def __init__(self, term: str, edits: int):
        self.edits, self.full = edits, (1 << (len(term) + 1)) - 1
        self.end = 1 << len(term)
        self.at: dict[str, int] = defaultdict(int)
        for i, c in enumerate(term):
            self.at[c] |= 1 << i

    def distance(self, phrase: str) -> int | None:
        """Edits from phrase to the term, null beyond those allowed. Bit i of a row: the term's first i letters are read."""
        rows = [(1 << (e + 1)) - 1 for e in range(self.edits + 1)]
        letters, full = self.at.get, self.full
        for c in phrase:
            own = letters(c, 0)
            before, rows[0] = rows[0], (rows[0] & own) << 1
            for e in range(1, self.edits + 1):
                old = rows[e]
                # the letter read as it is, one too many, in place of another; and one of the term's left out
                rows[e] = ((old & own) << 1 | before | before << 1 | rows[e - 1] << 1) & full
                before = old
            if not rows[-1]:
                return None
        return next((e for e, row in enumerate(rows) if row & self.end), None)


def _letters(text: str) -> int:
    out = 0
    for c in text:
        out |= 1 << (ord(c) & 63)
    return out


class Names:
    """Names of one source, or of all: terms (term, folded, origin, term_idx, words, watched) and forms (folded, term, evidence)."""

    def __init__(self, terms: list[tuple], forms: list[tuple]):
        self.forms: dict[str, tuple] = {}
        for phrase, term, evidence in forms:
            found = (term, evidence)
            self.forms[phrase] = min(self.forms.get(phrase, found), found)
        self.known = {t[1] for t in terms}
        self.terms, self.automata, self.masks = [], {}, []
        self.tables: dict[tuple[int, int], list[dict[str, list[int]]]] = {}
        for term, own, origin, idx, words, watched in terms:
            if watched and not _DIGIT.search(own):
                pieces = parts(len(own))
                tables = self.tables.setdefault((words, len(own)), [defaultdict(list) for _ in pieces])
                for table, (start, size) in zip(tables, pieces):
                    table[own[start : start + size]].append(len(self.terms))
                self.terms.append((idx, term, origin, own))
                self.masks.append(_letters(own))
        self.plans: dict[tuple[int, int], list[tuple]] = {}

    def plan(self, words: int, length: int) -> list[tuple]:
        """(slice, table): where a phrase of a length would have a part of a term in reach that stayed whole."""
        out = self.plans.get((words, length))
        if out is None:
            places: dict[tuple[int, int], dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
            for own in range(max(1, length - 2), length + 3):
                tables = self.tables.get((words, own))
                edits, longer = (2 if own >= LONG else 1), length - own
                if tables is None or abs(longer) > edits:
                    continue
                for i, (start, size) in enumerate(parts(own)):
                    for shift in range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1):
                        if 0 <= start + shift and start + shift + size <= length:
                            table = places[start + shift, start + shift + size]
                            for part, terms in tables[i].items():
                                table[part] += terms
            out = self.plans[words, length] = [(slice(*span), dict(table)) for span, table in sorted(places.items())]
        return out

    def guess(self, phrase: str, words: int) -> tuple | None:
        """(term_idx, term, origin, distance) of the first term that the phrase nearly is."""
        found: list[int] = []
        for span, table in self.plans.get((words, len(phrase))) or self.plan(words, len(phrase)):
            if (part := phrase[span]) in table:
                found += table[part]
        if not found or _DIGIT.search(phrase):
            return None
        mask, best = _letters(phrase), None
        for k in set(found):
            idx, term, origin, own = self.terms[k]
            edits = 2 if len(own) >= LONG else 1
            if (mask ^ self.masks[k]).bit_count() > 2 * edits or best is not None and (idx, term) >= best[:2]:
                continue
            if k not in self.automata:
                self.automata[k] = Automaton(own, edits)
            d = self.automata[k].distance(phrase)
            if d and not (origin != "glossary" and any(max(phrase, own, key=len) == min(phrase, own, key=len) + e for e in _INFLECTED)):
                best = (idx, term, origin, d)
        return best

    def look(self, phrase: str, words: int) -> tuple | None:
        """(form, known, guess) of a folded phrase; null if it is nothing to these names."""
        form, known = self.forms.get(phrase), phrase in self.known
        guess = None if form or known else self.guess(phrase, words)
        return (form, known, guess) if form or known or guess else None


class Memory(dict):
    """Folded phrase -> what the names of a source, together, know of it, for windows of some words."""

    def __init__(self, names: list[Names], words: int):
        self.names, self.words = names, words

    def __missing__(self, phrase: str) -> tuple | None:
        """(kind, order, term, evidence, distance)."""
        if len(self) >= MEMO:
            self.clear()
        out = None
        if found := [x for n in self.names if (x := n.look(phrase, self.words))] if phrase else ():
            forms, guesses = [f for f, _, _ in found if f], [g for _, _, g in found if g]
            if forms:
                out = (FORM, 0, *min(forms), 0)
            elif any(k for _, k, _ in found):
                out = (KNOWN, 0, None, None, 0)
            else:
                idx, term, origin, d = min(guesses)
                out = (GUESS, idx, term, origin, d)
        self[phrase] = out
        return out


class Folds(dict):
    def __missing__(self, word: str) -> str:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = folded(word)
        return found


def windows(words: list[str], n: int) -> list[str]:
    """The folded windows of n folded words; a word without anything but edges counts as an empty one."""
    if n == 1:
        return words
    out = list(map(" ".join, zip(*[words[k:] for k in range(n)])))
    return [w.strip(" ") for w in out] if "" in words else out


def found_in(text: str, folds: Folds, memories: dict[int, Memory]) -> list[tuple]:
    """(i, n, phrase as written without its edges, folded, kind, order, term, evidence, distance) of all windows that are something to the names."""
    words = text.split()
    own = list(map(folds.__getitem__, words))
    out, spans = [], None
    for n, memory in memories.items():
        every = windows(own, n)
        for i, found in enumerate(map(memory.__getitem__, every)):
            if found:
                spans = spans or [m.span() for m in _WORD.finditer(text)]
                out.append((i, n, text[spans[i][0] : spans[i + n - 1][1]].strip(EDGES), every[i], *found))
    return out


def taken(hits: list[tuple[int, int]]) -> dict[int, int]:
    """Place of a hit (i, n) -> its rank, for those that overlap none taken before them: longest first, then leftmost."""
    free, rank, out = set(), count(), {}
    for k in sorted(range(len(hits)), key=lambda k: (-hits[k][1], hits[k][0])):
        i, n = hits[k]
        span = range(i, i + n)
        if free.isdisjoint(span):  # the words that are taken
            free.update(span)
            out[k] = next(rank)
    return out


_FOUND = "i int, n int, phrase string, folded string, kind int, idx long, term string, evidence string, distance int, rank int"
_FOUND_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
_FOUND_NAMES = [c.split(" ")[0] for c in _FOUND.split(", ")]


def _pass(rows: DataFrame, shared, lengths: list[int], whole: bool) -> DataFrame:
    """rows(source_id, passage_idx, start, text, own) -> what is found. whole: shared are all names there are, so only hits are returned, ranked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, folds = Names(*shared.value), Folds()
        of_all = {n: Memory([names], n) for n in lengths}
        sources: dict[str | None, dict[int, Memory]] = {None: of_all}

        def memories(own: str | None) -> dict[int, Memory]:
            if own not in sources:
                if len(sources) > SOURCES:
                    sources.clear()
                    sources[None] = of_all
                tables = json.loads(own)
                mine = Names(*[[tuple(row[c] for c in columns) for row in tables[name] or ()] for name, columns in zip(("terms", "forms"), _COLUMNS)])
                sources[own] = {n: Memory([names, mine], n) for n in lengths}
            return sources[own]

        for batch in batches:
            kept, out = [], []
            for k, (text, own) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                found = found_in(text or "", folds, memories(own))
                if whole:
                    found = [f for f in found if f[4] != KNOWN]
                    ranks = taken([f[:2] for f in found])
                    found = [(*f, ranks.get(j)) for j, f in enumerate(found)]
                else:
                    found = [(*f, None) for f in found]
                kept += [k] * len(found)
                out += found
            part = batch.take(pa.array(kept, pa.int64()))
            columns = list(zip(*out)) or [()] * len(_FOUND_TYPES)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(c, t) for c, t in zip(columns, _FOUND_TYPES)]], ["source_id", "passage_idx", "start", *_FOUND_NAMES])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"source_id string, passage_idx {kinds['passage_idx']}, start {kinds['start']}, {_FOUND}")


def ranked(hits: DataFrame) -> DataFrame:
    """hits(source_id, passage_idx, ..., i, n) with the rank of those that overlap none taken before them, by passage."""
    every = hits.groupBy("source_id", "passage_idx").agg(F.sort_array(F.collect_list(F.struct("i", "n", "start", "phrase", "folded", "term", "evidence", "distance"))).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = []
            for spans in batch.column("spans"):
                own = [(x["i"], x["n"]) for x in spans.as_py()]
                found = taken(own)
                ranks.append([found.get(k) for k in range(len(own))])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("source_id", "passage_idx", "h")], pa.array(ranks, pa.list_(pa.int32()))], ["source_id", "passage_idx", "h", "r"])

    rows = every.withColumn("spans", F.transform("h", lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"))))
    kinds = {f.name: f.dataType.simpleString() for f in every.schema}
    out = rows.mapInArrow(run, f"source_id string, passage_idx {kinds['passage_idx']}, h {kinds['h']}, r array<int>")
    return out.select("source_id", "passage_idx", F.inline(F.arrays_zip("h", "r"))).select("source_id", "passage_idx", "h.*", F.col("r").alias("rank"))


def _blocks(terms: DataFrame, forms: DataFrame, names: int, letters: int) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Names for all sources, so many at a time; one empty block if there are none."""
    held: tuple[list, list] = ([], [])
    size, blocks = 0, 0
    for k, table in enumerate((terms, forms)):
        for row in table.toLocalIterator():
            held[k].append(tuple(row))
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(held[0]) + len(held[1]) >= names or size >= letters:
                yield held
                held, size, blocks = ([], []), 0, blocks + 1
    if held[0] or held[1] or not blocks:
        yield held


def match(passages: DataFrame, terms: DataFrame, forms: DataFrame, lengths: list[int], block: tuple[int, int] = (BLOCK_NAMES, BLOCK_LETTERS)) -> DataFrame:
    """source_id, passage_idx, start, i, n, phrase, folded, term, evidence, distance, rank of all hits.

    terms(source_id, term, folded, origin, term_idx, words, watched) and forms(source_id,
    folded, term, evidence) are a source's, or all sources' where source_id is null. Those
    of one source travel with its passages: they are few, like a talk's headings.
    """
    spark = passages.sparkSession
    workers_see_package(spark)
    listed = [t.where("source_id is not null").groupBy("source_id").agg(F.collect_list(F.struct(*c)).alias(name)) for t, c, name in zip((terms, forms), _COLUMNS, ("terms", "forms"))]
    own = listed[0].join(listed[1], "source_id", "full").select("source_id", F.to_json(F.struct("terms", "forms"), {"ignoreNullFields": "false"}).alias("own"))
    rows = dealt(passages.select(F.col("source_id").cast("string").alias("source_id"), "passage_idx", "start", "text")).join(own, "source_id", "left")
    everywhere = [t.where("source_id is null").select(*c) for t, c in zip((terms, forms), _COLUMNS)]
    sc, parts_found = spark.sparkContext, []
    blocks = _blocks(*everywhere, *block)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(rows, sc.broadcast(first), lengths, True).drop("kind", "idx")
    held = [first, second]
    while held:
        shared = sc.broadcast(held.pop(0))
        parts_found.append(cut(_pass(rows if not parts_found else rows.withColumn("own", F.lit(None).cast("string")), shared, lengths, False), "found"))
        shared.destroy()
        if not held:
            held = [x for x in (next(blocks, None),) if x is not None]
    every = parts_found[0]
    for part in parts_found[1:]:
        every = every.unionByName(part)
    best = F.min(F.struct("kind", "idx", "term", "evidence", "distance", "start", "phrase", "folded")).alias("b")
    merged = every.groupBy("source_id", "passage_idx", "i", "n").agg(best).where(F.col("b.kind") != KNOWN).select("source_id", "passage_idx", "i", "n", "b.start", "b.phrase", "b.folded", "b.term", "b.evidence", "b.distance")
    return ranked(cut(merged, "hits")).select("source_id", "passage_idx", "start", "i", "n", "phrase", "folded", "term", "evidence", "distance", "rank")
