"""Failures, file names, outputs and the run's envelope, as data."""

from __future__ import annotations

import hashlib
import os
import tempfile
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import FALLBACK_STEM, sanitise
from lectern.functions.web import redact
from lectern.sources import files
from lectern.sources.documents import write_documents
from lectern.sources.shared import cut
from lectern.sources.store import there

EXIT_OK, EXIT_FAILED, EXIT_PARTIAL = 0, 1, 2
#: Code, what it says, what to try. {name} is filled from the context.
CODES = [
    ("SOURCE_ERROR", "{source} could not be read.", ["Try again later."]),
    ("LECTURE_UNAVAILABLE", "{source} names nothing that can be read.", ["Check the spelling.", "List the folder."]),
    ("AGE_RESTRICTED", "{source} asks for an age check.", ["Use captions saved to a file."]),
    ("REGION_BLOCKED", "{source} is not shown in this region.", ["Use captions saved to a file."]),
    ("PLAYLIST_NOT_SUPPORTED", "{source} names many recordings.", ["Name one of them."]),
    ("PLAYLIST_TOO_LARGE", "{source} has more entries than one run takes.", ["Split it."]),
    ("PLAYLIST_EMPTY", "{source} has no entries.", ["Check the address."]),
    ("SEVERAL_LECTURES", "{source} holds several lectures.", ["Name one of them."]),
    ("TRANSPORT_CONTRACT_CHANGED", "The listing of {source} has another shape than expected.", ["Update the transport."]),
    ("TRANSPORT_NOT_INSTALLED", "There is nothing here to fetch {source} with.", ["Install a transport.", "Use captions saved to a file."]),
    ("ACQUISITION_FAILED", "{source} could not be fetched: {detail}", ["Try again later."]),
    ("CAPTION_ERROR", "The captions of {source} could not be used.", ["Choose another track."]),
    ("NO_CAPTIONS_AVAILABLE", "{source} has no captions.", ["Transcribe it."]),
    ("PAYLOAD_TOO_LARGE", "{source} is over its ceiling.", ["Split the file."]),
    ("TRACK_NOT_FOUND", "{source} has no track that fits.", ["Ask for one of those listed."]),
    ("MALFORMED_CAPTIONS", "The captions of {source} are damaged: {detail}", ["Fetch them again.", "Choose another format."]),
    ("EMPTY_TRANSCRIPT", "The captions of {source} hold no words.", ["Choose another track."]),
    ("MALFORMED_LECTURE", "The stored lecture {source} is of another version.", ["Make it again."]),
    ("CONFIG_ERROR", "The request does not make sense: {detail}", ["Read the usage."]),
    ("UNKNOWN_RENDERER", "No renderer is called {source}.", ["Choose one of those listed."]),
    ("UNKNOWN_PROVIDER", "Nothing knows how to read {source}.", ["Give a path or an address."]),
    ("UNKNOWN_CAPTION_FORMAT", "The caption format of {source} is not known.", ["Convert it."]),
    ("INPUT_UNREADABLE", "{source} is no UTF-8 text.", ["Convert it."]),
    ("MALFORMED_CORRECTIONS", "The corrections in {source} are damaged: {detail}", ["Give a list of wrong and right."]),
    ("OUTPUT_ERROR", "{source} could not be written.", ["Check the folder."]),
    ("OUTPUT_UNWRITABLE", "{source} cannot be written to.", ["Check the folder's rights."]),
    ("OUTPUT_EXISTS", "{source} exists and says something else.", ["Allow overwriting.", "Write elsewhere."]),
]
FAILURE = "struct<code:string,cause:string,try:array<string>,context:map<string,string>>"


def failures(rows: DataFrame, source: str = "source_id", detail: str | None = None) -> DataFrame:
    """rows(source, code[, detail]) -> source_id, failure: code, cause, what to try, context. Addresses are redacted."""
    dim = rows.sparkSession.createDataFrame(CODES, "code string, template string, remedies array<string>")
    said = redact(F.coalesce(F.col(detail).cast("string"), F.lit(""))) if detail else F.lit("")
    where = redact(F.coalesce(F.col(source).cast("string"), F.lit("")))
    cause = F.replace(F.replace("template", F.lit("{source}"), where), F.lit("{detail}"), said)
    j = rows.join(F.broadcast(dim), "code", "left")
    return j.select(F.col(source).alias("source_id"), F.struct("code", F.coalesce(cause, F.concat(F.lit("Unknown failure of "), where)).alias("cause"), F.coalesce("remedies", F.array().cast("array<string>")).alias("try"), F.create_map(F.lit("source"), where, F.lit("detail"), said).alias("context")).alias("failure"))


def file_names(documents: DataFrame, extension: str) -> DataFrame:
    """documents(doc_idx, title, source_id) -> doc_idx, name: no two alike, case aside. extension: one for all, or a column of documents.

    The first of a name keeps it; later ones take a number. A numbered name may meet
    another document's own, so numbers go on over all documents of the same base.
    """
    stem = F.coalesce(F.nullif(sanitise("title"), F.lit("")), F.nullif(sanitise("source_id"), F.lit("")), F.lit(FALLBACK_STEM))
    ident = sanitise("source_id")
    tell = F.when((ident != "") & (F.lower(ident) != F.lower(stem)), ident).otherwise("")
    ending = F.col(extension) if extension in documents.columns else F.lit(extension)
    rows = documents.select("doc_idx", stem.alias("stem"), tell.alias("tell"), ending.alias("ending"))
    k = F.row_number().over(W.partitionBy(F.lower("stem"), F.lower("tell")).orderBy("doc_idx"))
    inner = F.concat_ws(" ", F.nullif("tell", F.lit("")), F.when(F.col("k") > 1, F.col("k").cast("string")))
    name = F.concat("stem", F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(""))
    first = rows.withColumn("k", k).select("doc_idx", "ending", name.alias("n"))
    again = F.row_number().over(W.partitionBy(F.lower("n")).orderBy("doc_idx"))
    return first.select("doc_idx", F.concat("n", F.when(again > 1, F.concat(F.lit(" ("), again.cast("string"), F.lit(")"))).otherwise(""), F.lit("."), "ending").alias("name"))


def plan_outputs(documents: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """documents(name, text) against existing(name, text hash) -> name, text, action: write, unchanged or refused."""
    j = documents.join(existing.select("name", "hash"), "name", "left")
    same = F.col("hash") == F.sha2("text", 256)
    return j.select("name", "text", F.when(F.col("hash").isNull(), "write").when(same, "unchanged").when(F.lit(overwrite), "write").otherwise("refused").alias("action"))


def existing_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, hash, length of the files of a folder of any file system; joins with it are merges, however small the plan takes it for."""
    if not there(spark, folder):
        return spark.createDataFrame([], "name string, hash string, length long")
    if files.dealt_out(spark, folder):
        return files.dealt_listing(spark, folder, hashed=True).select("name", "hash", "length").hint("merge")
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("hash"), "length").hint("merge")


def write_outputs(planned: DataFrame, folder: str, overwrite: bool = True) -> DataFrame:
    """Writes the files to be written as one transaction; returns name, action, code of all.

    Without overwrite a file that came to be there meanwhile stays as it is. What the
    folder holds afterwards decides the codes: OUTPUT_EXISTS where another text has the
    name, OUTPUT_UNWRITABLE where none has.
    """
    spark = planned.sparkSession
    planned = cut(planned.select("name", "action", "text"), "planned")
    trouble = None
    try:
        write_documents(planned.where("action = 'write'"), folder, exclusive=not overwrite)
    except PySparkException as e:  # a task or the commit met a folder that takes no files
        trouble = e
    after = planned.join(existing_files(spark, folder), "name", "left")
    same = F.col("hash") == F.sha2(F.coalesce("text", F.lit("")), 256)
    lost = F.when(F.col("hash").isNull() | F.lit(trouble is not None), "OUTPUT_UNWRITABLE").otherwise("OUTPUT_EXISTS")
    code = F.when(F.col("action") == "refused", "OUTPUT_EXISTS").when((F.col("action") == "write") & ~F.coalesce(same, F.lit(False)), lost)
    return cut(after.select("name", "action", code.alias("code")), "outcomes")


#: How often a replace that lost a race is tried, and the first wait in seconds, doubled each time.
TRIES, WAIT = 6, 0.002


def atomic_write(path: str, text: str, overwrite: bool = True) -> str | None:
    """A failure code, or null once path holds all of text. A failed write leaves nothing of its own behind.

    Text is forced to the disk under a name of its own before the name is claimed and
    replaced, so a reader sees the old text or the new one.
    """
    temporary = claimed = None
    try:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), suffix=".part")
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if not overwrite:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            claimed = path
        for k in range(TRIES):
            try:
                os.replace(temporary, path)
                return None
            except PermissionError:
                if k == TRIES - 1:
                    raise
                time.sleep(WAIT * 2**k)
    except OSError as e:
        for left in (temporary, claimed):
            if left and os.path.exists(left):
                os.unlink(left)
        return "OUTPUT_EXISTS" if isinstance(e, FileExistsError) else "OUTPUT_UNWRITABLE"


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exit_code(produced: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: 0 without failures, 2 where something was produced beside them, else 1."""
    one = lambda df, p, f: df.select(F.lit(p).alias("p"), F.lit(f).alias("f"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    n = one(produced, 1, 0).union(one(failed, 0, 1)).agg(total("p").alias("produced"), total("f").alias("failed"))
    return n.select("produced", "failed", F.when(F.col("failed") == 0, EXIT_OK).when(F.col("produced") > 0, EXIT_PARTIAL).otherwise(EXIT_FAILED).alias("exit_code"))


def envelope(documents: DataFrame, files: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row of JSON: ok, results (empty where files were written), files, errors, warnings.

    For a run's report: where documents were written to files it holds their names alone,
    else their texts, and is no larger than one value may be.
    """
    trouble = F.struct(redact(F.col("source_id")).alias("source"), F.col("failure.cause").alias("message"), F.col("failure.code").alias("code"), F.col("failure.try").alias("try"), F.col("failure.context").alias("context"))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    rows = documents.select(F.lit("d").alias("k"), F.col("source_id").cast("string").alias("o"), text("text").alias("v"))
    rows = rows.union(files.select(F.lit("f"), "name", text("name")))
    for kind, df in (("e", errors), ("w", warnings)):
        rows = rows.union(df.select(F.lit(kind), F.col("source_id").cast("string"), F.to_json(trouble, {"ignoreNullFields": "false"})))
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("o", "v"))))
    one = rows.agg(*[listed(k).alias(k) for k in "dfew"])
    joined = lambda k: F.concat(F.lit("["), F.array_join(F.transform(k, lambda x: x["v"]), ","), F.lit("]"))
    results = F.when(F.size("f") > 0, "[]").otherwise(joined("d"))
    ok = (F.size("e") == 0).cast("string")
    return one.select(F.concat(F.lit('{"ok":'), ok, F.lit(',"results":'), results, F.lit(',"files":'), joined("f"), F.lit(',"errors":'), joined("e"), F.lit(',"warnings":'), joined("w"), F.lit("}")).alias("json"))


VERSION = 1


def to_json(lectures: DataFrame) -> DataFrame:
    """Nested lectures as JSON lines with their schema's version."""
    return lectures.select(F.to_json(F.struct(F.lit(VERSION).alias("v"), *lectures.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(lectures, failures): lines of another version, or of none, are refused."""
    rows = lines.select("json", F.from_json("json", f"struct<v:int,{schema}>").alias("r"))
    fine = F.coalesce(F.col("r.v") == VERSION, F.lit(False))
    return rows.where(fine).select("r.*").drop("v"), rows.where(~fine).select(F.left("json", F.lit(60)).alias("source_id"), F.lit("MALFORMED_LECTURE").alias("code"))
