"""Quality rules as weak supervision, in DataFrame functions only.

Each rule reads a few measures of a text and votes bad, good or not at all. The votes
of the whole table are counted by pattern (at most 3^rules patterns, whatever the
table's size); expectation-maximisation over those counts estimates the share of good
texts and, for every rule, how often it votes each way on good and on bad ones. What a
vote weighs is learned from how it agrees with the other rules: a rule that fires on
texts which all others call good weighs little and is outvoted. A text is kept if its
posterior probability of being good reaches a threshold and the two hard limits of the
base (50 words; repeated three-word windows over half of the words) hold.

Words are runs of characters other than 0x20 and 0x09-0x0D. All measures are over the
whole text. Repeated windows are found by sorting the windows' 64-bit hashes, whose
low bits give way to the position, so that the rows of a text never leave their task;
windows that meet are compared word by word, and where two unlike ones do, the text's
windows are sorted by their words instead.

Edge cases: a null or empty text has no words, fails the base and is not kept. Equal
rows are judged alike and all returned. An empty table gives no rows. Other columns
pass through :func:`keep_good` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, let

LEAST_WORDS = 50
KEEP_AT = 0.5
SPACE = r"[ \t-\r]+"
#: A word of letters or digits, within quotes or brackets and before one mark of punctuation at most.
PLAIN = r"^[(\"'«“‘]?[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*[)\"'»”’]?[.,;:?!]?[)\"'»”’]?$"
GOOD, BAD = "g", "b"
#: How a line of prose ends.
LINE_END = r"[.?!…。][)\"'»”’]*[ \t-\r]*$"


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(words: Column, lost_bits: int = 0) -> Column:
    """How many words lie in three-word windows that occur twice or more; lost_bits of the hashes are dropped besides (for tests)."""

    def covered(at: Column) -> Column:
        three = F.lit(3).cast("long")
        return let(F.sort_array(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(three, F.coalesce(F.get(p, k + 1) - x, three))), F.lit(0).cast("long"), lambda a, x: a + x))

    def by_words(w: Column) -> Column:
        same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"])
        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(x.alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.cast("long").alias("i")))
        return let(F.sort_array(windows), lambda s: covered(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"])))

    def from_sorted(s: Column, bits: Column, w: Column) -> Column:
        key = lambda x: F.call_function("shiftright", x, bits)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        place = lambda x: x.bitwiseAND(mask).cast("int")
        meets = lambda x, y: key(x) == key(y)
        unlike = lambda i, j: (F.get(w, i) != F.get(w, j)) | (F.get(w, i + 1) != F.get(w, j + 1)) | (F.get(w, i + 2) != F.get(w, j + 2))
        clash = F.exists(F.transform(s, lambda x, k: meets(x, F.get(s, k - 1)) & unlike(place(x), place(F.get(s, k - 1)))), lambda x: x)
        twice = F.filter(s, lambda x, k: meets(x, F.get(s, k - 1)) | meets(x, F.get(s, k + 1)))
        return F.when(F.coalesce(clash, F.lit(False)), by_words(w)).otherwise(covered(F.transform(twice, lambda x: x.bitwiseAND(mask))))

    def from_hashes(h: Column, w: Column) -> Column:
        bits = F.length(F.bin(F.size(h))).cast("int") + lost_bits
        windows = F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), bits).bitwiseOR(i.cast("long")))
        return F.when(F.size(h) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda s: from_sorted(s, bits, w)))

    return let(words, lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: from_hashes(h, w)))


def measures(text: Column) -> Column:
    """A struct of the measures of one text; null counts as empty."""

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
        line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), F.size(F.filter(x, lambda y: y.rlike(LINE_END))).cast("long").alias("n_line_ends"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))

        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain"),
            )

        words = let(F.array_remove(F.split(t, SPACE), ""), of_words)
        return F.struct(words.alias("w"), line.alias("l"), _count(t, r"[#*$%&|<>]").alias("n_symbols"), _count(t, r"[\p{Lu}]").alias("n_upper"), _count(t, "!").alias("n_shouts"), _count(t, r"[.?!]").alias("n_ends"))

    return let(F.coalesce(text.cast("string"), F.lit("")), of_text)


def with_measures(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns keep and the measures, each computed once a row."""
    name = "__measures"
    # inline() stands between the costly expression and whatever reads its fields more than once
    df = docs.select(*keep, F.inline(F.array(F.struct(measures(F.col(text)).alias(name)))))
    m = F.col(name)
    return df.select(*keep, m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"), m["w"]["n_distinct"].alias("n_distinct"), m["l"]["n_lines"].alias("n_lines"), m["n_upper"].alias("n_upper"), m["n_shouts"].alias("n_shouts"), m["w"]["n_plain"].alias("n_plain"), m["n_ends"].alias("n_ends"), m["l"]["n_line_ends"].alias("n_line_ends"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> list[tuple[str, Column]]:
    """(name, vote): b, g or null where the rule cannot tell. Each kind of bad text is the business of two rules or more."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c, by=n: F.col(c) / by

    def over(value: Column, bad: float, good: float) -> Column:
        return F.when(value >= bad, BAD).when(value <= good, GOOD)

    length, ends = F.col("word_chars") / n, share("n_ends")
    return [
        ("symbols", over(share("n_symbols"), 0.2, 0.03)),
        ("plain", over(1 - share("n_plain"), 0.3, 0.15)),
        ("shouts", over(share("n_shouts"), 0.2, 0.05)),
        ("capitals", over(share("n_upper", F.greatest(F.col("word_chars"), F.lit(1))), 0.3, 0.15)),
        ("repeats", over(share("n_repeat_words"), 0.3, 0.1)),
        ("lines", F.when(F.col("n_lines") >= 4, over(share("n_dup_lines", F.col("n_lines")), 0.5, 0.1))),
        ("line_ends", F.when(F.col("n_lines") >= 3, F.when(share("n_line_ends", F.col("n_lines")) <= 0.3, BAD).when(share("n_line_ends", F.col("n_lines")) >= 0.7, GOOD))),
        ("variety", F.when(F.col("n_words") >= 20, F.when(F.col("n_distinct") <= 0.12 * F.least(n, F.lit(1000)), BAD).when(F.col("n_distinct") >= 0.2 * F.least(n, F.lit(1000)), GOOD))),
        ("word_length", F.when((length < 2) | (length > 14), BAD).when((length >= 3) & (length <= 10), GOOD)),
        ("sentences", F.when(F.col("n_words") >= 20, F.when((ends < 0.005) | (ends > 0.4), BAD).when((ends >= 0.02) & (ends <= 0.3), GOOD))),
    ]


def votes() -> Column:
    """One letter a rule: g, b or - for no vote."""
    return F.concat(*[F.coalesce(v, F.lit("-")) for _, v in rules()])


class Model:
    """Two kinds of text, good and bad, and what each rule votes on each.

    p[y][j][v]: the chance that rule j, where it votes, votes v on a text that is good
    (y = 1) or bad (y = 0). No vote tells nothing. Rules are taken to err independently
    on texts of one kind.
    """

    def __init__(self, n_rules: int, good: float = 0.9, noise: float = 0.02, hits: float = 0.3):
        self.p = [[{GOOD: 1 - b, BAD: b} for _ in range(n_rules)] for b in (hits, noise)]
        self.share = [1 - good, good]

    def good(self, pattern: str) -> float:
        """P(good | votes)."""
        x = sum((self.weight(j, v) for j, v in enumerate(pattern) if v in (GOOD, BAD)), math.log(self.share[1] / self.share[0]))
        return 1 / (1 + math.exp(min(700.0, max(-700.0, -x))))

    def weight(self, rule: int, vote: str) -> float:
        """What a vote adds to the log-odds of good."""
        return math.log(self.p[1][rule][vote] / self.p[0][rule][vote])

    def fit(self, counts: dict[str, int], rounds: int = 200) -> Model:
        """Expectation-maximisation from the first chances, each of which counts as one text a rule and kind."""
        prior, first = [[dict(p) for p in kind] for kind in self.p], list(self.share)
        for _ in range(rounds):
            sums, mass = [[dict(p) for p in kind] for kind in prior], list(first)
            for pattern, n in counts.items():
                w = self.good(pattern)
                for y, k in ((1, w * n), (0, (1 - w) * n)):
                    mass[y] += k
                    for j, v in enumerate(pattern):
                        if v in sums[y][j]:
                            sums[y][j][v] += k
            self.share = [m / sum(mass) for m in mass]
            self.p = [[{v: x / sum(p.values()) for v, x in p.items()} for p in kind] for kind in sums]
        return self

    def accuracies(self) -> list[tuple[float, float]]:
        """For each rule the chances that it votes bad on bad texts and good on good ones, where it votes."""
        return [(bad[BAD], good[GOOD]) for bad, good in zip(*self.p)]

    def p_good(self) -> Column:
        """P(good) as an expression over the column votes."""
        x = F.lit(math.log(self.share[1] / self.share[0]))
        for j in range(len(self.p[0])):
            v = F.substring("votes", j + 1, 1)
            x = x + F.when(v == GOOD, self.weight(j, GOOD)).when(v == BAD, self.weight(j, BAD)).otherwise(0.0)
        return 1 / (1 + F.exp(-x))


def model(voted: DataFrame) -> Model:
    """Fits on the texts of a frame with columns votes and n_words that have the base's least number of words."""
    counts = {r["votes"]: r["n"] for r in voted.where(F.col("n_words") >= LEAST_WORDS).groupBy("votes").agg(F.count("*").alias("n")).collect()}
    return Model(len(rules())).fit(counts)


def judge(docs: DataFrame, keep_at: float = KEEP_AT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the measures, base_failed, votes, p_good, kept: one row per row of docs."""
    m = cut(with_measures(docs.select(doc_id, text), doc_id, text=text).withColumn("votes", votes()), "quality")
    return m.withColumn("p_good", model(m).p_good()).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))


def keep_good(docs: DataFrame, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns. Texts are measured once: rows wait beside their votes in the shared folder."""
    measured = with_measures(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text")), "__row", text="__text")
    voted = cut(measured.select("__row", "n_words", votes().alias("votes"), base_failed().alias("base_failed")), "voted")
    return voted.where(~F.col("base_failed") & (model(voted).p_good() >= keep_at)).select("__row.*")
