"""A run: requests made of names and files, what they give split into output and report.

What was made and what went wrong never mix: ``output`` holds documents or a listing
(what a command would print), ``report`` one line per failure (what it would say beside
that), and the exit code counts both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.languages import TIERS
from lectern.operators import resolve
from lectern.plans import outcome, render
from lectern.plans.fetch import Request, fetch
from lectern.sources.registry import UnknownName
from lectern.sources.shared import cut, hadoop

#: Most bytes of a glossary or of a file of corrections.
MAX_REFERENCE = 1024 * 1024
TAKE_BUDGET = ("context",)


class Refused(ValueError):
    """An input of the run itself cannot be used; code says why."""

    def __init__(self, code: str, source: str):
        self.code, self.source = code, source
        super().__init__(f"{code}: {source}")


def read_reference(spark: SparkSession, path: str, most: int = MAX_REFERENCE) -> str:
    """A small text file whole: its length in the listing is checked, and again the length of what is read."""
    at, fs = hadoop(spark, path)
    if not fs.exists(at):
        raise Refused("INPUT_UNREADABLE", path)
    size = fs.getFileStatus(at).getLen()
    if size == 0:
        return ""
    content = None if size > most else spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("content").first()
    if content is None:
        raise Refused("PAYLOAD_TOO_LARGE", path)
    try:
        return bytes(content[0]).decode("utf-8-sig")
    except UnicodeDecodeError:
        raise Refused("INPUT_UNREADABLE", path) from None


def glossary_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_idx, line of a glossary file."""
    lines = read_reference(spark, path).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line_idx int, line string")


def corrections_records(spark: SparkSession, path: str) -> DataFrame:
    """wrong, right, evidence of a JSON list of objects; what is no text is null. No list at all is refused."""
    text = spark.createDataFrame([(read_reference(spark, path),)], "json string").select(F.expr("try_parse_json(json)").alias("v"))
    kind = text.select(F.expr("schema_of_variant(v)")).first()[0]
    if not (kind or "").startswith("ARRAY<"):
        raise Refused("MALFORMED_CORRECTIONS", path)
    rows = text.select(F.explode(F.expr("cast(v as array<variant>)")).alias("r")).withColumn("is_object", F.expr("schema_of_variant(r)").startswith("OBJECT<"))

    def string(name: str):
        value = F.expr(f"try_variant_get(r, '$.{name}', 'variant')")
        return F.when(F.col("is_object") & (F.schema_of_variant(value) == "STRING"), F.expr(f"try_variant_get(r, '$.{name}', 'string')")).alias(name)

    return rows.select(string("wrong"), string("right"), string("evidence"))


def tiers_of(names: list[str] | None) -> list[str] | None:
    """Named tiers, in the order given; None for all."""
    known = [t for t, *_ in TIERS]
    if bad := [n for n in names or [] if n not in known]:
        raise Refused("CONFIG_ERROR", f"no tier is called {bad[0]}; known: {', '.join(known)}")
    return list(names) if names else None


def budgeted() -> list[str]:
    """The renderers that take a budget."""
    return sorted(TAKE_BUDGET)


#: What requests make, in the order of requests, then of sources.
DOCUMENTS = "request int, source_id string, title string, renderer string, text string"


@dataclass
class Run:
    output: DataFrame  # text: one row, empty where files were written
    report: DataFrame  # source_id, line
    files: DataFrame  # name, action, code
    exit_code: int
    envelope: DataFrame  # json: all of it as one object


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _lines(failures: DataFrame) -> DataFrame:
    """source_id, line: code, cause and what to try."""
    tried = F.array_join(F.transform("failure.try", lambda t: F.concat(F.lit(" - "), t)), "\n")
    return failures.select("source_id", F.concat_ws("\n", F.concat("failure.code", F.lit(": "), "failure.cause"), F.nullif(tried, F.lit(""))).alias("line"))


def run(spark: SparkSession, requests: list[Request], folder: str | None = None, overwrite: bool = False) -> Run:
    """Fetches every request; one that makes no sense, or whose source nothing handles, is a failure beside the others' documents.

    Each request has its own renderer and options. A document is known by its request and
    source together, so two folders may hold lectures of one name; files are named in the
    order of requests.
    """
    none = spark.createDataFrame([], "source_id string, code string, detail string")
    documents, failures = [spark.createDataFrame([], DOCUMENTS)], [outcome.failures(none, detail="detail")]
    for k, request in enumerate(requests):
        try:
            result = fetch(spark, request)
        except (UnknownName, ValueError) as e:
            row = (request.source, getattr(e, "code", "CONFIG_ERROR"), str(e))
            failures.append(outcome.failures(spark.createDataFrame([row], none.schema), detail="detail"))
            continue
        renderer = render.ALIASES.get(request.renderer, request.renderer)
        own = result.documents.select("source_id", "text").join(result.lectures.select("source_id", "title"), "source_id")
        documents.append(cut(own.select(F.lit(k).alias("request"), "source_id", "title", F.lit(renderer).alias("renderer"), "text"), "documents"))
        failures.append(result.failures)
    made = _union(documents)
    written = spark.createDataFrame([], "name string, action string, code string")
    if folder and len(documents) > 1:
        numbered = made.withColumn("doc_idx", F.struct("request", "source_id"))
        extension = F.create_map(*[F.lit(x) for kv in render.EXTENSIONS.items() for x in kv])[F.col("renderer")]
        named = numbered.withColumn("extension", extension).join(outcome.file_names(numbered.withColumn("extension", extension), "extension"), "doc_idx")
        planned = outcome.plan_outputs(named.select("name", "text"), outcome.existing_files(spark, folder), overwrite)
        written = outcome.write_outputs(planned, folder, overwrite)
        failures.append(outcome.failures(written.where("code is not null").select(F.col("name").alias("source_id"), "code")))
    failed = cut(_union(failures), "failures")
    done = written.where("code is null") if folder else made
    code = outcome.exit_code(done, failed).first()["exit_code"]
    output = render.render_several(made, ["request", "source_id"]) if not folder else spark.createDataFrame([("",)], "text string")
    return Run(output, _lines(failed), written, code, outcome.envelope(made, written.where("code is null"), failed, failed.limit(0)))


def listing(spark: SparkSession, request: Request) -> DataFrame:
    """source_id, line: the languages of each lecture, then its tracks, some of them where they are very many."""
    tracks = request.provider().list(spark, request.source).tracks
    spoken = resolve.languages(tracks).select("source_id", F.array_join(resolve.listed(F.col("languages"), 20), ", ").alias("languages"))
    own = tracks.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", resolve.describe().alias("d")))), lambda x: x["d"]).alias("d"))
    lines = F.array_join(F.transform(resolve.listed(F.col("d"), resolve.MAX_LISTED), lambda d: F.concat(F.lit("  "), d)), "\n")
    return own.join(spoken, "source_id").select("source_id", F.concat_ws("\n", F.concat("source_id", F.lit(": "), "languages"), lines).alias("line"))
