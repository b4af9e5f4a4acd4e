"""Names worth watching and the misspellings of them: mining, matching, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, casefold, col, fold, let, strip_edges, tokens
from lectern.operators import matching

SHORTEST, SHORTEST_INHERITED = 6, 8
MAX_ENTRIES, MAX_CORRECTIONS = 2_000, 10_000


def worth_watching(term: Column | str, inherited: Column | bool = False) -> Column:
    t = col(term)
    least = F.when(F.lit(inherited) if isinstance(inherited, bool) else inherited, SHORTEST_INHERITED).otherwise(SHORTEST)
    return F.when(F.size(tokens(t)) > 1, F.length(t) >= SHORTEST).otherwise(t.rlike(r"\p{L}") & (F.length(t) >= least))


def proper_nouns(text: Column | str) -> Column:
    """array<string> of capitalised phrases, in order; a run that opens its segment gives itself if it has several words, and the rest of it."""

    def of_segment(segment: Column) -> Column:
        def runs(w: Column) -> Column:
            upper = F.transform(w, lambda x: x.rlike(r"^\p{Lu}"))

            def phrases(u: Column) -> Column:
                starts = F.filter(F.transform(u, lambda x, i: F.when(x & ~F.coalesce(F.get(u, i - 1), F.lit(False)), i)), lambda i: i.isNotNull())

                def of_run(i: Column) -> Column:
                    stop = F.coalesce(F.get(F.filter(F.transform(u, lambda x, j: F.when(~x & (j > i), j)), lambda j: j.isNotNull()), F.lit(0)), F.size(w))
                    run = F.slice(w, i + 1, stop - i)
                    n, joined = F.size(run), lambda a: strip_edges(F.array_join(a, " "))
                    whole = F.when((n > 1) | (i > 0), joined(run))
                    rest = F.when((n > 1) & (i == 0), joined(F.slice(run, F.lit(2), F.greatest(n - 1, F.lit(1)))))
                    return F.array(F.when(worth_watching(whole), whole), F.when(worth_watching(rest, True), rest))

                return F.filter(F.flatten(F.transform(starts, of_run)), lambda x: x.isNotNull())

            return let(upper, phrases)

        return let(tokens(segment), runs)

    return F.flatten(F.transform(F.split(col(text), rf"[|:;.–—]|{SPACE}-{SPACE}"), of_segment))


def terms_from(meta: DataFrame) -> DataFrame:
    """meta(source_id, title, channel, chapters: array<string>) -> source_id, term, origin, term_idx: first origin wins."""
    texts = F.concat(F.array(F.struct(F.col("title").alias("t"), F.lit("title").alias("o")), F.struct(F.coalesce("channel", F.lit("")).alias("t"), F.lit("channel").alias("o"))), F.transform(F.coalesce("chapters", F.array().cast("array<string>")), lambda c: F.struct(c.alias("t"), F.lit("chapter").alias("o"))))
    rows = meta.select("source_id", F.posexplode(texts).alias("i", "x")).select("source_id", "i", F.col("x.o").alias("origin"), F.posexplode(proper_nouns(F.col("x.t"))).alias("j", "term"))
    first = rows.groupBy("source_id", "term").agg(F.min(F.struct("i", "j", "origin")).alias("f"))
    idx = F.row_number().over(W.partitionBy("source_id").orderBy("f")) - 1
    return first.select("source_id", "term", F.col("f.origin").alias("origin"), idx.alias("term_idx"))


def read_glossary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line_idx, line) of ``Term: wrong, wrong  # note`` -> (terms(term, origin, term_idx), variants(folded, term, evidence))."""
    entry = F.trim(F.regexp_replace(F.substring_index("line", "#", 1), SPACE, " "))
    rows = lines.select("line_idx", entry.alias("e")).where("e <> ''").select("line_idx", F.trim(F.substring_index("e", ":", 1)).alias("term"), F.when(F.contains("e", F.lit(":")), F.expr("substring(e, instr(e, ':') + 1)")).otherwise("").alias("wrong")).where("term <> ''")
    terms = rows.groupBy("term").agg(F.min("line_idx").alias("term_idx")).select("term", F.lit("glossary").alias("origin"), "term_idx")
    forms = rows.select("line_idx", "term", F.posexplode(F.split("wrong", ",")).alias("j", "form")).withColumn("folded", fold("form")).where((F.col("folded") != "") & (F.col("folded") != fold("term")))
    variants = forms.groupBy("folded").agg(F.min_by("term", F.struct("line_idx", "j")).alias("term")).select("folded", "term", F.lit("glossary").alias("evidence"))
    return terms, variants


def too_many_entries(terms: DataFrame, variants: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """One failure row if the glossary is over its ceiling; it is refused whole, never cut."""
    n = terms.select(F.lit(1)).union(variants.select(F.lit(1))).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > most).select(F.lit("PAYLOAD_TOO_LARGE").alias("code"), F.col("n").alias("entries"))


def merge(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first with what only second has."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def ngrams(passages: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """source_id, passage_idx, i (first word), n, phrase (as written, white space and all), folded: windows of every length.

    Words are folded once a text; a window's folded form is theirs, as fold() makes it of the phrase.
    """

    def windows(words: Column, gaps: Column, folded: Column) -> Column:
        # gaps[k] stands before word k, so a window is its words with the gaps inside it
        def of(n: int) -> Column:
            def window(i: Column) -> Column:
                parts = [F.get(words, i)]
                for k in range(1, n):
                    parts += [F.get(gaps, i + k), F.get(words, i + k)]
                own = F.trim(F.concat_ws(" ", *[F.get(folded, i + k) for k in range(n)]))
                return F.struct(i.alias("i"), F.lit(n).alias("n"), F.concat(*parts).alias("phrase"), own.alias("folded"))

            last = F.size(words) - n
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).otherwise(F.array().cast("array<struct<i:int,n:int,phrase:string,folded:string>>"))

        return F.flatten(F.array(*map(of, lengths)))

    word = r"(?U)[^\s\x1c-\x1f]+"
    # an edge may be stripped of a word to nothing: the word then counts as an empty one
    of_words = lambda w: let(F.split(F.col("text"), word, -1), lambda g: let(F.transform(w, lambda x: casefold(strip_edges(x))), lambda f: windows(w, g, f)))
    every = let(F.regexp_extract_all(F.col("text"), F.lit(word), F.lit(0)), of_words)
    return passages.select("source_id", "passage_idx", *keep, F.explode(every).alias("g")).select("source_id", "passage_idx", *keep, "g.*")


def matches(passages: DataFrame, terms: DataFrame, variants: DataFrame, lengths: list[int]) -> DataFrame:
    """As hits, with ``rank``: the place among a passage's hits that overlap none taken before them, longest first, then leftmost; null for the others."""
    named = terms.select("source_id", "term", fold("term").alias("folded"), "origin", F.col("term_idx").cast("long").alias("term_idx"), F.size(tokens("term")).alias("words"), worth_watching("term").alias("watched"))
    return matching.match(passages, named, variants.select("source_id", "folded", "term", "evidence"), lengths)


def hits(passages: DataFrame, terms: DataFrame, variants: DataFrame, lengths: list[int]) -> DataFrame:
    """source_id, passage_idx, start, i, n, phrase, folded, term, evidence, distance: windows that are, or nearly are, a watched name.

    terms(source_id, term, origin, term_idx) and variants(source_id, folded, term,
    evidence) are per source, or for all sources where source_id is null. Known variants
    win over known spellings, these over guesses, and among guesses the first term, not
    the nearest.
    """
    return matches(passages, terms, variants, lengths).drop("rank")


def propose_corrections(passages: DataFrame, terms: DataFrame, variants: DataFrame, lengths: list[int]) -> DataFrame:
    """source_id, correction_idx, wrong, right, at, confidence, evidence, occurrences; the most frequent first."""
    own = matches(passages, terms, variants, lengths).where("rank is not null")
    first = F.struct("passage_idx", "rank")
    out = own.groupBy("source_id", "folded", "term").agg(F.count("*").cast("int").alias("occurrences"), F.min_by(F.struct("phrase", "start", "evidence", "distance"), first).alias("f"), F.min(first).alias("seen"))
    conf = F.when(F.col("f.distance") == 0, 1.0).otherwise(F.round(1 - F.col("f.distance") / 10, 2))
    idx = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("occurrences"), F.coalesce("f.start", F.lit(0.0)), "seen")) - 1
    return out.select("source_id", idx.alias("correction_idx"), F.col("f.phrase").alias("wrong"), F.col("term").alias("right"), F.col("f.start").alias("at"), conf.alias("confidence"), F.col("f.evidence").alias("evidence"), "occurrences")
