"""A whole request: discover, choose, load, refine, render.

Tracks are chosen before any payload is read, and stored payloads of remote sources are
taken before any is fetched. A source that fails costs only itself: everything that went
wrong is a row of ``failures``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import TRACK, glossary, paragraphs, parse, resolve, sections
from lectern.plans import outcome
from lectern.sources import store
from lectern.sources.providers import Provider, folder_provider
from lectern.sources.registry import default_renderers, provider_for
from lectern.sources.shared import cut

#: What names a stored payload; never an address, which may carry a signature.
PAYLOAD_KEY = ("source_id", "tier", "raw_language", "caption_format")


@dataclass
class Request:
    source: str
    languages: list[str] = field(default_factory=lambda: ["en"])
    tiers: list[str] | None = None
    glossary: DataFrame | None = None  # lines(line_idx, line)
    corrections: DataFrame | None = None  # wrong, right, evidence
    renderer: str = "markdown"
    budget: int | None = None
    retrieved_at: str = "1970-01-01 00:00:00"
    providers: list[Provider] | None = None  # in order; the folder provider if none are given
    cache: str | None = None  # folder of the payload store

    def check(self) -> str | None:
        """Why the request makes no sense, or null."""
        if self.budget is not None and self.renderer != "context":
            return "only the context renderer takes a budget"
        return None

    def provider(self) -> Provider:
        """The first provider that handles the source; raises UnknownName if none does."""
        known = self.providers or [folder_provider()]
        name = provider_for(self.source, {p.name: p.handles for p in known})
        return next(p for p in known if p.name == name)


@dataclass
class Result:
    documents: DataFrame  # source_id, text
    failures: DataFrame  # source_id, failure
    lectures: DataFrame
    sections: DataFrame
    passages: DataFrame
    corrections: DataFrame


def read_corrections(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(wrong, right, evidence) -> (variants(folded, term, evidence), failures); the first of a form counts."""
    from lectern.functions.text import fold

    rows = records.withColumn("i", F.monotonically_increasing_id())
    good = rows.where("wrong is not null and right is not null").withColumn("folded", fold("wrong")).where((F.col("folded") != "") & (F.col("folded") != fold("right")))
    first = good.groupBy("folded").agg(F.min_by(F.struct("right", "evidence"), "i").alias("r"))
    bad = rows.where("wrong is null or right is null").select(F.lit("corrections").alias("source_id"), F.lit("MALFORMED_CORRECTIONS").alias("code"))
    return first.select("folded", F.col("r.right").alias("term"), F.coalesce(F.nullif("r.evidence", F.lit("")), F.lit("given")).alias("evidence")), bad


def load(spark: SparkSession, chosen: DataFrame, provider: Provider, request: Request) -> DataFrame:
    """Payloads of the chosen tracks: the store's where it has them, else the provider's, which are then stored."""
    if not (provider.remote and request.cache):
        return provider.load(spark, chosen, request.source)
    known = cut(store.read(spark, chosen, request.cache, *PAYLOAD_KEY), "stored")
    kept = known.where("value is not null").withColumnRenamed("value", "payload").withColumn("content_hash", F.sha2("payload", 256)).withColumn("code", F.when(F.octet_length("payload") > parse.MAX_PAYLOAD, "PAYLOAD_TOO_LARGE"))
    loaded = cut(provider.load(spark, known.where("value is null").drop("value"), request.source), "loaded")
    store.write(loaded.where("code is null").withColumn("value", F.col("payload")), request.cache, *PAYLOAD_KEY)
    return kept.unionByName(loaded)


def names(spark: SparkSession, request: Request, mined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, variants, failures) of a request: mined terms of each source, and for all sources the glossary's and the corrections'.

    A glossary or a table of corrections that is damaged or over its ceiling is refused
    whole. Corrections come before a glossary's forms, and its terms before mined ones.
    """
    terms, variants = mined, spark.createDataFrame([], "source_id string, folded string, term string, evidence string")
    failures = spark.createDataFrame([], "source_id string, code string")
    everywhere = F.lit(None).cast("string").alias("source_id")

    def refused(bad: DataFrame, what: str) -> bool:
        nonlocal failures
        rows = bad.select(F.lit(what).alias("source_id"), "code").limit(1).collect()
        if rows:
            failures = failures.union(spark.createDataFrame(rows, failures.schema))
        return bool(rows)

    if request.glossary is not None:
        own, forms = glossary.read_glossary(request.glossary)
        if not refused(glossary.too_many_entries(own, forms), "glossary"):
            first = own.select(everywhere, "term", "origin", (F.col("term_idx") - glossary.MAX_ENTRIES * 1000).alias("term_idx"))
            terms = first.unionByName(mined.join(own.select("term"), "term", "left_anti"))
            variants = forms.select(everywhere, "folded", "term", "evidence")
    if request.corrections is not None:
        given, bad = read_corrections(request.corrections)
        many = request.corrections.agg(F.count("*").alias("n")).where(F.col("n") > glossary.MAX_CORRECTIONS).select(F.lit("PAYLOAD_TOO_LARGE").alias("code"))
        if not refused(many, "corrections") and not refused(bad, "corrections"):
            variants = given.select(everywhere, "folded", "term", "evidence").unionByName(variants.join(given.select("folded"), "folded", "left_anti"))
    return terms, variants, failures


def fetch(spark: SparkSession, request: Request, chapters: DataFrame | None = None, meta: DataFrame | None = None) -> Result:
    """chapters(source_id, chapter_idx, title, start) and meta(source_id, title, url, channel, published, duration) stand in for what the provider lists."""
    if why := request.check():
        raise ValueError(why)
    provider = request.provider()
    listing = provider.list(spark, request.source)
    tracks = cut(listing.tracks, "tracks")
    chosen = cut(resolve.resolve(tracks, request.languages, request.tiers), "chosen")
    missing = resolve.unresolved(tracks, chosen).select("source_id", "code")
    loaded = cut(load(spark, chosen, provider, request), "payloads")
    unread = loaded.where("code is not null").select("source_id", "code")
    payloads = loaded.where("code is null")
    damaged = parse.malformed(payloads).select("source_id", "code")
    cues = cut(parse.parse_captions(payloads), "cues")
    policy = paragraphs.policy_for(payloads.select(*TRACK, "tier", "caption_format"), cues)
    passages = cut(paragraphs.reflow(cues, policy).drop("track_idx"), "passages")
    empty = payloads.select("source_id").join(damaged.select("source_id"), "source_id", "left_anti").join(passages.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("EMPTY_TRANSCRIPT").alias("code"))
    chapters = chapters if chapters is not None else listing.chapters
    chapters = chapters if chapters is not None else spark.createDataFrame([], "source_id string, chapter_idx int, title string, start double")
    passages, secs = sections.build_sections(passages, chapters)
    passages, secs = cut(passages, "passages"), cut(secs, "sections")

    base = payloads.join(passages.select("source_id").distinct(), "source_id", "left_semi").select("source_id", F.lit(provider.name).alias("provider"), "tier", F.col("raw_language").alias("language"), "caption_format", F.lit(request.retrieved_at).cast("timestamp").alias("retrieved_at"), "content_hash")
    meta = meta if meta is not None else listing.meta
    if meta is None:
        meta = base.select("source_id", F.col("source_id").alias("title"), *[F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("channel", "string"), ("published", "date"), ("duration", "double"))])
    lectures = cut(base.join(meta, "source_id", "left").withColumn("title", F.coalesce("title", "source_id")), "lectures")

    listed = chapters.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter_idx", "title"))), lambda x: x["title"]).alias("chapters"))
    mined = cut(glossary.terms_from(lectures.join(listed, "source_id", "left")), "terms")
    terms, variants, refused = names(spark, request, mined)
    n_words = terms.select(F.size(F.split("term", " ")).alias("n")).union(variants.select(F.size(F.split("folded", " ")).alias("n"))).distinct()
    lengths = sorted(r["n"] for r in n_words.collect()) or [1]  # word counts of names: a handful
    fixes = cut(glossary.propose_corrections(passages, terms, variants, lengths), "corrections")

    renderer = default_renderers().get(request.renderer)
    extra = {"budget": request.budget} if request.budget is not None else {}
    documents = renderer(lectures, secs, passages, fixes, **extra)
    failed = outcome.failures(listing.failures.select("source_id", "code").union(missing).union(unread).union(damaged).union(empty).union(refused))
    return Result(documents, failed, lectures, secs, passages, fixes)
