"""One query for each operator, over its whole tables, and the pipeline; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import decontam, knn, langid, mixing, ngram, pii, tokens, toxicity, urls, warc


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def op1_mixing(spark, d):
    """doc_id, n_words, domain, rate of every document."""
    rates = mixing.mixing_rates(_read(spark, d, "documents"), mixing.labelled_domains(_read(spark, d, "labels")), mixing.TARGETS)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rates.withColumn("_k", copies).select("doc_id", "n_words", "domain", "rate")


def op2_decontamination(spark, d):
    return decontam.contamination(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def op3_knn(spark, d):
    return knn.top_k(_read(spark, d, "embeddings"))


def op4_ngram_jaccard(spark, d):
    return ngram.jaccard_links(_read(spark, d, "documents"))


def op5_warc(spark, d):
    """One row for each derived record: what links it, and digests and length of its block."""
    out = warc.serialized(warc.derivatives(warc.responses(_read(spark, d, "pages"))))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "source_payload_digest", F.octet_length("block").cast("long").alias("content_length"), F.sha2("record", 256).alias("record_sha256"))


def op6_pii(spark, d):
    return pii.personal_data(_read(spark, d, "documents"))


def op7_langid(spark, d):
    return langid.languages(_read(spark, d, "documents"), spans=False)


def op8_token_output(spark, d):
    return tokens.write_tokens(_read(spark, d, "documents")).documents()


def op9_url_filter(spark, d):
    return urls.judged(_read(spark, d, "pages"))


def op10_toxicity(spark, d):
    found = toxicity.toxicity(_read(spark, d, "documents"), _read(spark, d, "labels").where(~toxicity.held_out()), evidence=False)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_decontamination, op3_knn, op4_ngram_jaccard, op5_warc, op6_pii, op7_langid, op8_token_output, op9_url_filter, op10_toxicity, pipeline)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_decontamination": f"""
with dw as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
iw as (select cast(item_id as varchar) item, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark where text is not null and item_id is not null),
win as (select distinct item, least(8, len(w)) k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') g
        from (select item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) i from iw where len(w) > 0)),
ks as (select distinct k from win),
gram as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, ks where len(w) >= k)),
met as (select gram.doc_id, gram.i, gram.k, win.item from gram join win on gram.k = win.k and gram.g = win.g),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from met) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from met) group by doc_id)
select dw.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from dw left join hits on dw.doc_id = hits.doc_id left join its on dw.doc_id = its.doc_id
""",
    "op3_knn": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, d.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) score
      from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 20
""",
    "op4_ngram_jaccard": f"""
with recursive dw as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') w from documents),
sh as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from dw where len(w) >= 5)
       union all select doc_id, array_to_string(w, ' ') g from dw where len(w) between 1 and 4),
n as (select doc_id, count(*) c from sh group by doc_id),
common as (select a.doc_id x, b.doc_id y, count(*) m from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * m >= 80 * (p.c + q.c - m)),
pairs as (select x, y from link union all select y, x from link),
reach as (select doc_id, doc_id other from dw union select r.doc_id, b.y from reach r join pairs b on r.other = b.x)
select dw.doc_id, coalesce(n.c, 0)::bigint n_shingles, min(r.other) component_id
from dw left join n on dw.doc_id = n.doc_id join reach r on r.doc_id = dw.doc_id group by all
""",
}
