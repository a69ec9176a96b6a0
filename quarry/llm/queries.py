"""Queries of this subpackage, one per operator, over whole tables; SQL where SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import align, decontam, jaccard, lm_mix, packing, phrases, quality, substring, token_counts, token_output, topk, toxicity, url_filter
from quarry.llm.common import shared_dir, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(token_counts.trees(table(spark, sf_dir, "documents")), token_counts.standard_edits())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, read back from the written shards."""
    path = f"{shared_dir(spark)}/quarry/shards-{uuid.uuid4().hex}"
    token_output.write_shards(token_output.shards(table(spark, sf_dir, "documents")), path)
    got = token_output.read_shards(spark, path)
    return got.select("slot", "shard", "byte", "n_tokens", "ids_crc32", F.size("spans").cast("long").alias("n_spans"), F.element_at("spans", 1)["doc_id"].alias("doc_id"), F.element_at("spans", 1)["start"].alias("start"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mix.score(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.deduplicate(table(spark, sf_dir, "documents"))
    span = F.aggregate("dropped", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return got.select("doc_id", "n_chunks", "n_later", F.size("dropped").cast("long").alias("n_dropped"), span.alias("dropped_bytes"), F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), (F.size("dropped") > 0).alias("has_repeat"), "dropped")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_token_output": op6_token_output,
    "op7_quality": op7_quality,
    "op8_lm_mixing": op8_lm_mixing,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_phrases": op11_phrases,
    "op12_top_k": op12_top_k,
    "op13_alignment": op13_alignment,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_decontamination": rf"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
i as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') as t from i, unnest(range(greatest(len(w) - 9, 1))) r(k) where len(w) > 0),
pos as (select doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') as t from d, (select distinct n from win), unnest(range(greatest(len(w) - n + 1, 0))) r(k)),
hit as (select doc_id, item_id, k, n from pos join win using (n, t)),
covered as (select doc_id, count(distinct k + j) as n_hit from hit, unnest(range(n)) r(j) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id, item_id::varchar as item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (doc_id) left join named using (doc_id)""",
    "op3_ngram_jaccard": rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
g as (select distinct doc_id, array_to_string(w[k + 1 : k + 5], ' ') as t from d, unnest(range(greatest(len(w) - 4, 1))) r(k) where len(w) > 0),
n as (select doc_id, count(*) as n from g group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from g a join g b on a.t = b.t and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id group by 1, 2, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from (select a as doc_id, min(b) as component_id from reach group by a) left join n using (doc_id)""",
    "op11_phrases": rf"""
with d as (select coalesce(lang, 'und') as lang, {_LOWER} as t from documents where text is not null),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
total as (select lang, sum(len(w))::bigint as n from p group by lang),
f as (select lang, m, phrase, count(*) as f from (select lang, m, array_to_string(w[k + 1 : k + m], ' ') as phrase from p, unnest(range(1, 5)) as a(m), unnest(range(greatest(len(w) - m + 1, 0))) as b(k)) group by all),
c as (select lang, m, phrase, string_split(phrase, ' ') as w, f as a from f where m > 1 and f >= 30),
cut as (select c.*, k, l.f as l, r.f as r, (2000000::hugeint * a) // (l.f + r.f) as score from c, unnest(range(1, c.m)) as x(k) join f l on l.lang = c.lang and l.phrase = array_to_string(w[1 : k], ' ') and l.m = k join f r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1 : c.m], ' ') and r.m = c.m - k),
lowest as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
within as (select lang, phrase, max(a) as longer from (select lang, a, array_to_string(w[k + 1 : k + s], ' ') as phrase from c, unnest(range(2, m)) as x(s), unnest(range(m - s + 1)) as y(k)) group by all),
kept as (select lowest.* from lowest left join within using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join total using (lang) where rank <= 2000""",
    "op12_top_k": """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score from v q join v c on q.r <> c.r where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (select query_id, vec_id, score, (row_number() over (partition by r order by score desc, vec_id nulls last))::integer as rank from s) where rank <= 5""",
}
