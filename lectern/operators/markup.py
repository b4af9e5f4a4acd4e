"""Caption markup -> columns: speakers, turns, sounds, doubtful words. Windows only, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, col, let, replace_each, tokens
from lectern.operators import TRACK, WORDS
from lectern.operators.sentences import cut_at

TURN, MARK, DOUBT = ">>", "(inaudible)", "(?)"
#: Sounds that are no speech, and words for what could not be heard.
NON_SPEECH = ("applause", "blank_audio", "cheering", "cough", "coughing", "crosstalk", "laugh", "laughing", "laughter", "music", "noise", "silence", "sound")
UNHEARD = ("inaudible", "unintelligible", "indistinct")
LABEL = r"^(?U)\s*([A-Z][A-Z0-9 .'\-]{2,38}):\s*"
_LEADING = rf"^{SPACE}*(?:{TURN}{SPACE}*)+"


def bracket(match: Column) -> Column:
    """What a bracketed note becomes: nothing, the mark for unheard, a doubtful guess, or itself."""
    body = F.trim(F.regexp_replace(F.substring(match, F.lit(2), F.length(match) - 2), rf"^{SPACE}+|{SPACE}+$", ""))
    guess = F.regexp_replace(F.substring(body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0))), rf"^{SPACE}+|{SPACE}+$", "")
    low = F.lower(body)
    return F.when(low.startswith("?") & low.endswith("?"), F.concat(guess, F.lit(DOUBT))).when(low.isin(*NON_SPEECH), "").when(low.isin(*UNHEARD), MARK).otherwise(match)


def read_markup(text: Column | str) -> Column:
    """struct<text, turn, named> of one piece."""
    t = col(text)
    turn = t.rlike(_LEADING)
    bare = F.replace(F.regexp_replace(F.regexp_replace(t, _LEADING, ""), rf"^{SPACE}+", ""), F.lit(TURN), F.lit(" "))

    def labelled(b: Column) -> Column:
        has = b.rlike(LABEL)
        name = F.trim(F.regexp_extract(b, LABEL, 1))
        rest = replace_each(F.regexp_replace(b, LABEL, ""), r"\[[^\[\]]*\]", bracket)
        return F.struct(rest.alias("text"), (turn | has).alias("turn"), F.when(has, name).alias("named"))

    return let(bare, labelled)


def collapse_marks(text: Column | str) -> Column:
    """Words joined by single spaces; repeated marks for unheard words become one."""
    return let(tokens(text), lambda w: F.array_join(F.filter(w, lambda x, i: (x != MARK) | (F.coalesce(F.get(w, i - 1), F.lit("")) != MARK)), " "))


def inner_turns(text: Column | str) -> Column:
    own = tokens(text)
    return F.filter(F.transform(own, lambda x, i: F.when((x == TURN) & (i > 0), i).otherwise(0)), lambda i: i > 0)


def split_turns(cues: DataFrame) -> DataFrame:
    """Cues cut at turn marks inside them, later pieces being turns; adds turn_idx. Cues without word times stay whole."""
    rows = cues.withColumnRenamed("piece_idx", "__piece") if "piece_idx" in cues.columns else cues.withColumn("__piece", F.lit(0))
    cut = cut_at(rows, inner_turns("text")).withColumnRenamed("piece_idx", "turn_idx").withColumnRenamed("__piece", "piece_idx")
    return cut.withColumn("turn", F.col("turn") | (F.col("turn_idx") > 0))


def fill_speaker(order: list[str], named: Column, turn: Column) -> Column:
    """The last name before or at each row; a turn without a name forgets it."""
    event = F.when(named.isNotNull(), F.struct(named.alias("name"))).when(turn, F.struct(F.lit(None).cast("string").alias("name")))
    w = W.partitionBy(*TRACK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.last(event, ignorenulls=True).over(w)["name"]


def realign(words: Column, before: Column, after: Column) -> Column:
    """The words that a text keeps: all, the last ones if they are its tokens, or none; never a guess."""

    def kept(was: Column) -> Column:
        def fits(now: Column) -> Column:
            tail = F.slice(words, -F.least(F.greatest(F.size(now), F.lit(1)), F.greatest(F.size(words), F.lit(1))), F.greatest(F.size(now), F.lit(1)))
            none = F.array().cast(WORDS)
            return F.when(F.size(words) != F.size(was), none).when(F.size(now) == F.size(words), words).when((F.size(now) < F.size(words)) & (F.transform(tail, lambda x: x["text"]) == now), tail).otherwise(none)

        return let(tokens(after), fits)

    return let(tokens(before), kept)


def consume_markup(cues: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Cues with text freed of markup, and speaker and turn filled, and with the columns to keep; cues without text go.

    Speakers are filled before empty cues are dropped: a cue that is only a name names
    those after it, while its turn goes with it. A mark for unheard words alone goes if
    the kept cue before it ends with one.
    """
    order = ["cue_idx", "piece_idx", "turn_idx"]
    pieces = split_turns(cues).withColumn("r", read_markup("text"))
    pieces = pieces.withColumn("speaker", fill_speaker(order, F.col("r.named"), F.col("r.turn"))).withColumn("new", collapse_marks(F.col("r.text"))).where("new <> ''")
    before = F.lag("new").over(W.partitionBy(*TRACK).orderBy(*order))
    pieces = pieces.withColumn("before", before).where(~((F.col("new") == MARK) & F.coalesce(F.col("before").endswith(MARK), F.lit(False))))
    end = F.col("start") + F.col("duration")
    pieces = pieces.withColumn("kept", realign(F.col("words"), F.col("text"), F.col("new")))
    moved = (F.size("kept") > 0) & (F.size("kept") < F.size("words"))
    at = F.when(moved, F.least(F.greatest(F.get(F.col("kept"), F.lit(0))["start"], F.col("start")), end)).otherwise(F.col("start"))
    return pieces.select(*TRACK, *order, F.col("new").alias("text"), at.alias("start"), F.greatest(end - at, F.lit(0.0)).alias("duration"), F.col("kept").alias("words"), "speaker", (F.col("r.turn") | F.col("turn")).alias("turn"), *(keep or []))
