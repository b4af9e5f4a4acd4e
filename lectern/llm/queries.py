"""The queries that apply each corpus operator to its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, html_extract, licenses, lm, media, nearjoin, packing, quality, resample, secrets, urls, whitening
from lectern.llm.common import table


#: Fixed value: a text that says what the chat template says.
CONTROL_CASE = "\\### Assistant: </turn> ok"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "p_good")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_conversations(rows))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_lm_scoring, op4_secret_scan, op5_quality_rules, op6_chat_format, op7_html_extraction, op8_ngram_jaccard_join, op9_decontamination, op10_license_scan, op11_lossless_webp, op12_importance_resampling, op13_embedding_whitening)}

#: Words of a text as in lectern.llm.common: A-Z lowered, split at 0x20 and 0x09-0x0D.
_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda w: w <> '')"""


def _shingle_rows(source: str, key: str, extra: str = "") -> str:
    return f"""select distinct {key}, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ') || ' .'] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from (select {key}{extra}, {_WORDS} as w from {source})"""


def _license_sql() -> str:
    """Dice of every unit with every template whose size is within the bounds."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, {k}, [{', '.join(map(quote, licenses.bigrams_of(t)))}])" for k, (name, t) in enumerate(licenses.TEMPLATES))
    return f"""
with t(license, template, g) as (values {rows}),
d as (select doc_id, coalesce(text, '') as text from documents),
u as (
  select doc_id, 'line' as unit, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'x': x, 'i': i - 1}})) as s from d
  union all select doc_id, unit, s from (select doc_id, 'paragraph' as unit, unnest(list_transform(regexp_split_to_array(text, '\n[ \x09-\x0D]*\n'), lambda x, i: {{'x': x, 'i': i - 1}})) as s from d) where contains(s.x, chr(10))
  union all select doc_id, 'text', {{'x': text, 'i': 0}} from d where contains(text, chr(10))),
w as (select doc_id, unit, s.i as position, list_filter(string_split(regexp_replace(lower(s.x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from u),
b as (select doc_id, unit, position, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from w where len(w) >= 2),
m as (select doc_id, unit, position, license, template, cast(len(b) as bigint) as n_bigrams, cast(2 * len(list_intersect(b, g)) as double) / (len(b) + len(g)) as dice
  from b join t on len(b) >= 0.6666 * len(g) and len(b) <= 1.5001 * len(g) and list_has_any(b, g))
select * from m where dice >= 0.8 qualify row_number() over (partition by doc_id, unit, position order by dice desc, license, template) = 1"""


ORACLES = {
    "op8_ngram_jaccard_join": f"""
with recursive texts as (select coalesce(text, '') as text, min(doc_id) as rep, count(*) as copies from documents group by 1),
sh as ({_shingle_rows("texts", "rep")}),
n as (select rep, count(*) as n from sh group by 1),
pairs as (select a.rep as u, b.rep as v, count(*) as c from sh a join sh b on a.s = b.s and a.rep <> b.rep group by 1, 2),
links as (select u, v from pairs join n x on x.rep = u join n y on y.rep = v where 10 * c >= 8 * (x.n + y.n - c)),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
cls as (select u, least(u, min(v)) as class_id from reach group by 1),
deg as (select u, sum(copies) as d from links join texts on texts.rep = v group by 1)
select d.doc_id, coalesce(class_id, rep) as class_id, rep as copy_of, cast(coalesce(d2.d, 0) + copies - 1 as bigint) as n_links
from documents d join texts t on t.text = coalesce(d.text, '') left join cls on cls.u = rep left join deg d2 on d2.u = rep""",
    "op9_decontamination": f"""
with i as ({_shingle_rows("benchmark", "item_id")}), d as ({_shingle_rows("documents", "doc_id")}), n as (select item_id, count(*) as n_item from i group by 1)
select doc_id, item_id, count(*) as n_shared, n_item, count(*) / n_item as containment from d join i using (s) join n using (item_id)
group by doc_id, item_id, n_item having 10 * count(*) >= 8 * n_item""",
    "op10_license_scan": _license_sql(),
}
