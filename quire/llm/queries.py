"""The operators applied to the tables, as registered queries, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, toxicity
from .ann import nearest
from .fingerprint import compare_with_edits
from .html_text import extract
from .line_dedup import drop_common_lines
from .mixing import mix
from .packing import pack
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .url_filter import judge
from .variants import variants, word_counts
from .whitening import whiten


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own: a production job names a lasting one
    cache = shared.new_path(spark, "token-cache")
    out = token_counts(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache, keep=["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def held_out(key: str = "doc_id"):
    """Whether a row's labels are held out: the crc32 of its key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    learnt = shared.table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.fit(shared.table(spark, sf_dir, "documents"), learnt)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.flag(docs, toxicity_model(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(shared.table(spark, sf_dir, "documents"), words=3, distance=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.table(spark, sf_dir, "pages"), html="html")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(shared.table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("kept")
    derive = {"kept_sha256": F.sha2(kept, 256), "n_kept": F.octet_length(kept).cast("long"), "n_kept_chars": F.length(kept.cast("string")).cast("long")}
    return remove_repeats(shared.table(spark, sf_dir, "documents"), length=400, derive=derive)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(shared.table(spark, sf_dir, "documents"), slip=31))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(shared.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_ann": op7_ann,
    "op8_fingerprint": op8_fingerprint,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_html_text": op12_html_text,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

#: SQL of sizes, key ranges and targets of a mix over {docs} (doc_id, text, source).
MIX_SQL = r"""
rows as (
  select *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, coalesce('a' || source, 'b') as sk,
         md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as h
  from {docs}),
sizes as (select sk, cast(sum(size) as bigint) as source_size from rows group by sk),
ranked as (
  select *, cast([3, 1, 2][(row_number() over (order by sk) - 1) % 3 + 1] as double) as w, cast(source_size * 2 as double) as cap from sizes),
levels as (
  select *, (cast(sum(source_size) over () as double) * 1.5
             - coalesce(sum(cap) over (order by cap / w, sk rows between unbounded preceding and 1 preceding), 0.0))
            / sum(w) over (order by cap / w, sk rows between current row and unbounded following) as level
  from ranked),
aims as (
  select sk, source_size, coalesce(least(cap, max(case when cap / w > level then level end) over () * w), cap) as target from levels),
placed as (
  select rows.*, source_size, target, sum(size) over (partition by sk order by h, doc_id, size rows between unbounded preceding and 1 preceding) as before
  from rows join aims using (sk)),
mixed as (
  select *, case when source_size > 0 then cast(floor(floor(target) / source_size) as bigint) else 0 end as full_epochs from placed)
"""

ORACLES: dict[str, str] = {
    "op6_mixing": "with " + MIX_SQL.replace("{docs}", "documents") + """
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(full_epochs * size + greatest(0, least(size, cast(floor(target) as bigint) - full_epochs * source_size - coalesce(before, 0))) as bigint) as taken
from mixed""",
    "op9_line_dedup": r"""
with lines as (select doc_id, source, text, string_split(text, chr(10)) as all_lines from documents),
filled as (select *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as f from lines),
counts as (select source, line, count(*) as pages from (select source, unnest(list_distinct(f)) as line from filled) group by source, line),
totals as (select source, count(*) as total from documents group by source),
common as (select c.source, list(line) as common from counts c join totals t on c.source is not distinct from t.source
           where pages > 1 and pages > total * cast(0.1 as double) group by c.source),
kept as (select f.*, list_filter(all_lines, lambda x: not (regexp_matches(x, '[^\x20\x09-\x0D]') and coalesce(list_contains(common, x), false))) as k
         from filled f left join common c on f.source is not distinct from c.source)
select doc_id, source, cast(coalesce(len(f), 0) as bigint) as n_lines, cast(coalesce(len(all_lines) - len(k), 0) as bigint) as n_dropped,
       sha256(array_to_string(k, chr(10))) as kept_sha256
from kept""",
}
