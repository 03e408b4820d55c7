"""Every operator bound to the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import constants as K
from ferrule.functions import text as T
from ferrule.operators import documents, graph, lines, search
from ferrule.plans.tools import Store, context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vector_of(spark, d, vec_id=0):
    return t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first().embedding


# ------------------------------------------------------------------ search

_Q = "(select embedding::double[] q from embeddings where vec_id = 0)"
_COS = "1 - list_cosine_similarity(embedding::double[], q)"


def _knn(metric):
    def run(spark, d):
        hits = search.knn(t(spark, d, "embeddings"), vector_of(spark, d), 10, metric, key="vec_id")
        rank = F.row_number().over(Window.orderBy("distance", "vec_id"))
        return hits.select("vec_id", F.round("distance", 6).alias("distance"), T.relevance("distance").alias("relevance"), rank.alias("rank"))

    return run


for _m, _e in (("cosine", _COS), ("l2", "list_distance(embedding::double[], q)"), ("l1", "list_sum(list_transform(list_zip(embedding::double[], q), lambda p: abs(p[1] - p[2])))")):
    QUERIES[f"knn_{_m}"] = _knn(_m)
    ORACLE_SQL[f"knn_{_m}"] = f"select vec_id, round(d, 6) distance, round(1 - d, 3) relevance, cast(row_number() over (order by d, vec_id) as integer) as rank from (select vec_id, {_e} d from embeddings, {_Q}) order by d, vec_id limit 10"


@query(f"select vec_id, label, round(d, 6) distance from (select vec_id, label, {_COS} d from embeddings, {_Q} order by d, vec_id limit 200) where label = 3 order by d, vec_id limit 10")
def knn_postfilter(spark, d):
    hits = search.filtered(search.knn(t(spark, d, "embeddings"), vector_of(spark, d), search.fetch_size(10, True), key="vec_id"), {"label": {"$eq": 3}})
    return hits.orderBy("distance", "vec_id").limit(10).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"select vec_id, label, round({_COS}, 6) distance from embeddings, {_Q} where label = 3 order by {_COS}, vec_id limit 10")
def knn_prefilter(spark, d):
    return search.knn(search.filtered(t(spark, d, "embeddings"), {"label": 3}), vector_of(spark, d), 10, key="vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""select query_id, vec_id, cast(r as integer) as rank, round(d, 6) distance from (select *, row_number() over (partition by query_id order by d, vec_id) r from (
select q.vec_id query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]) d from embeddings e, (select * from embeddings where vec_id % 50 = 0) q)) where r <= 10""")
def knn_batched_topk(spark, d):
    e = t(spark, d, "embeddings")
    hits = search.knn_batch(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, key="vec_id")
    return hits.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
_TERMS = ["the", "and", "of", "der"]
_IN = ", ".join(f"'{x}'" for x in _TERMS)


def _bm25_sql(source: str) -> str:
    return f"""src as ({source}),
w as (select doc_id, unnest({_TOK}) term from src), sizes as (select s.doc_id, count(w.term) size from src s left join w on s.doc_id = w.doc_id group by 1),
whole as (select count(*) n_docs, avg(size) avg_size from sizes), tf as (select doc_id, term, count(*) tf from w group by all), df as (select term, count(*) n from tf group by 1),
idf as (select term, n_docs, avg_size, ln((n_docs - n + 0.5) / (n + 0.5)) raw from df, whole), least_idf as (select 0.25 * avg(raw) least from idf),
sc as (select tf.doc_id, sum(case when raw < 0 then least else raw end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg_size))) s from tf join idf on tf.term = idf.term join sizes on sizes.doc_id = tf.doc_id, least_idf where tf.term in ({_IN}) group by 1),
scores as (select sizes.doc_id, coalesce(s, 0.0) bm25 from sizes left join sc on sizes.doc_id = sc.doc_id)"""


@query(f"with {_bm25_sql('select doc_id, text from documents')} select doc_id, round(bm25, 6) bm25 from scores")
def bm25_scores(spark, d):
    return search.bm25(t(spark, d, "documents").select("doc_id", "text"), _TERMS, "doc_id", "text").select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"with {_bm25_sql('select doc_id, text from documents')} select doc_id, round(bm25, 6) bm25 from scores order by scores.bm25 desc, doc_id limit 10")
def bm25_topk(spark, d):
    return search.bm25(t(spark, d, "documents").select("doc_id", "text"), _TERMS, "doc_id", "text").orderBy(F.desc("bm25"), "doc_id").limit(10).select("doc_id", F.round("bm25", 6).alias("bm25"))


_HITS = f"select k.doc_id, text, d from (select vec_id doc_id, {_COS} d from embeddings, {_Q} order by d, vec_id limit 50) k join documents on k.doc_id = documents.doc_id"


def _hits(spark, d):
    """The k nearest first, then their texts."""
    e, texts = t(spark, d, "embeddings"), t(spark, d, "documents").select("doc_id", "text")
    near = search.knn(e, vector_of(spark, d), search.fetch_size(10, False), key="vec_id").select(F.col("vec_id").alias("doc_id"), "distance")
    return texts.join(F.broadcast(near), "doc_id")  # k rows


@query(f"with h as ({_HITS}), {_bm25_sql('select doc_id, text from h')}, top as (select max(bm25) top from scores) select h.doc_id, round(0.7 * least(1.0, greatest(0.0, 1 - d)) + 0.3 * bm25 / case when top > 0 then top else 1 end, 6) score from h join scores on h.doc_id = scores.doc_id, top")
def hybrid_rerank(spark, d):
    return search.hybrid(_hits(spark, d), _TERMS, 0.7, "doc_id", "text").select("doc_id", F.round(1 - F.col("distance"), 6).alias("score"))


@query(f"""with recursive h as materialized (select doc_id, d, list_distinct({_TOK}) w, row_number() over (order by d, doc_id) i from ({_HITS})),
alike as materialized (select a.i, b.i j, len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) s from h a join h b on a.i <> b.i),
r as (select 0 step, cast([] as bigint[]) chosen
union all select step + 1, list_append(chosen, (select g.i from (select h.i, greatest(-1.0, 0.7 * (1 - h.d) - 0.3 * coalesce(max(case when list_contains(chosen, alike.j) then alike.s end), 0.0)) v
    from h left join alike on alike.i = h.i where not list_contains(chosen, h.i) group by h.i, h.d) g order by g.v desc, g.i limit 1)) from r where step < 10),
c as (select unnest(chosen) i, unnest(range(1, 11)) k from r where step = 10)
select cast(k as integer) as rank, doc_id, round(1 - d, 3) relevance from c join h on c.i = h.i""")
def mmr_select(spark, d):
    return search.formatted(search.mmr(_hits(spark, d), 10, 0.7, "doc_id", "text"), "doc_id").select("rank", "doc_id", "relevance")


@query(f"select doc_id, cast(len({_TOK}) as integer) n_tokens from documents")
def tokenize(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).alias("n_tokens"))


@query(f"with x as (select doc_id, list_distinct({_TOK}) w from documents) select a.doc_id a, b.doc_id b, round(len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))), 6) jaccard from x a join x b on b.doc_id = a.doc_id + 1")
def jaccard_pairs(spark, d):
    """Each document with the next one."""
    x = t(spark, d, "documents").select("doc_id", F.array_distinct(T.tokens("text")).alias("w"))
    return x.select(F.col("doc_id").alias("a"), F.col("w").alias("wa")).join(x.select(F.col("doc_id").alias("b"), F.col("w").alias("wb")), F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.jaccard("wa", "wb"), 6).alias("jaccard"))


@query("select cast(row_number() over (order by l.doc_id) as integer) as rank, l.doc_id, 1.0::double relevance from labels l join documents d on l.doc_id = d.doc_id where l.toxic = 1 and l.quality = 0 order by l.doc_id limit 20")
def by_object_name(spark, d):
    """Items of one name exactly, in order of their key."""
    kinds = t(spark, d, "labels").select("doc_id", F.concat_ws("-", "toxic", "quality").alias("object_name"))
    items = t(spark, d, "documents").select("doc_id").join(kinds, "doc_id")
    return search.by_object(items, "1-0", 20, "doc_id").select("rank", "doc_id", "relevance")


# ------------------------------------------------------------------ text

_LINES = "select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) n from documents"
_USES = r"regexp_matches(line, '(?i)(^|[^\p{L}\p{M}\p{N}_])des([^\p{L}\p{M}\p{N}_]|$)')"


def _grep(spark, d, limit=None):
    return lines.grep(t(spark, d, "documents").select("doc_id", "text"), "des", "doc_id", limit=limit).select("doc_id", "line_number", "line_content")


@query(f"select doc_id, cast(n as integer) line_number, substr(trim(line), 1, 200) line_content from ({_LINES}) where {_USES}")
def grep_lines(spark, d):
    return _grep(spark, d)


@query(f"select doc_id, cast(n as integer) line_number, substr(trim(line), 1, 200) line_content from ({_LINES}) where {_USES} order by doc_id, n limit 20")
def grep_topn(spark, d):
    return _grep(spark, d, 20)


@query("select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) in_turn from conversations")
def sticky_header(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("line_number"))
    return lines.with_header(rows, "conv_id", F.when(F.col("role") == "user", F.col("turn")), "in_turn").drop("line_number")


@query("""with f as (select doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda l: {'done': []::varchar[], 'cur': [l], 'len': length(l) + 1}),
lambda a, x: case when a.len + x.len > 844 then {'done': list_append(a.done, array_to_string(a.cur, chr(10))), 'cur': list_concat(a.cur[greatest(1, len(a.cur) - 3) :], x.cur), 'len': cast(list_sum(list_transform(a.cur[greatest(1, len(a.cur) - 3) :], lambda y: length(y) + 1)) + x.len as bigint)}
else {'done': a.done, 'cur': list_concat(a.cur, x.cur), 'len': a.len + x.len} end) r from documents)
select doc_id, cast(len(r.done) + 1 as integer) n_chunks, cast(coalesce(list_sum(list_transform(r.done, lambda y: length(y))), 0) + length(array_to_string(r.cur, chr(10))) as bigint) n_chars from f""")
def chunk_overlap(spark, d):
    c = t(spark, d, "documents").select("doc_id", lines.chunks("text").alias("c"))
    return c.select("doc_id", F.size("c").alias("n_chunks"), F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("n_chars"))


@query(f"""with l as (select doc_id, n, line, last_value(nullif(regexp_extract(line, '(?i)^\\s*(Процедура|Функция|Procedure|Function)\\s+([\\p{{L}}\\p{{M}}\\p{{N}}_]+)\\s*\\(', 2), '') ignore nulls) over (partition by doc_id order by n rows unbounded preceding) h
from (select doc_id, unnest(string_split(x, chr(10))) line, unnest(range(1, len(string_split(x, chr(10))) + 1)) n from (select doc_id, replace(text, chr(10), chr(10) || 'Procedure P' || doc_id || '()' || chr(10)) x from documents)))
select doc_id, cast(n as integer) line_number, coalesce(h, '') in_method from l where {_USES}""")
def grep_in_method(spark, d):
    """Usages with the method whose header stands above them."""
    head = F.concat(F.lit("\nProcedure P"), F.col("doc_id").cast("string"), F.lit("()\n"))
    texts = t(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), head).alias("text"))
    return lines.grep(texts, "des", "doc_id").select("doc_id", "line_number", "in_method")


@query("""with t as (select doc_id, text, string_split(text, chr(10)) ls from documents), p as (select doc_id, text, ls[1] top, ls[-1] last, ls[2:len(ls) - 1] body, len(ls) n from t),
f as (select doc_id, top, last, list_reduce(list_transform(body, lambda l: {'done': []::varchar[], 'cur': [l], 'len': length(l) + 1}),
lambda a, x: case when a.len + x.len > 844 then {'done': list_append(a.done, array_to_string(a.cur, chr(10))), 'cur': list_concat(a.cur[greatest(1, len(a.cur) - 3) :], x.cur), 'len': cast(list_sum(list_transform(a.cur[greatest(1, len(a.cur) - 3) :], lambda y: length(y) + 1)) + x.len as bigint)}
else {'done': a.done, 'cur': list_concat(a.cur, x.cur), 'len': a.len + x.len} end) r from p where length(text) > 844 and n >= 3 and length(array_to_string(body, chr(10))) > 844),
c as (select doc_id, text code, 0 i from p where doc_id not in (select doc_id from f)
union all select doc_id, top || chr(10) || unnest(list_append(r.done, array_to_string(r.cur, chr(10)))) || chr(10) || last, unnest(range(0, len(r.done) + 1)) from f)
select 'main_code_Documents_D' || c.doc_id || '_M_m_' || i item_id, md5(case when i = 0 then 'о ' || md5(text) || chr(10) else '' end || 'S()' || chr(10) || code) document_md5 from c join t on c.doc_id = t.doc_id""")
def code_document(spark, d):
    """Documents as methods: comments with the first chunk, signature and code of each make the text to embed."""
    x = t(spark, d, "documents")
    methods = x.select(F.lit("Documents").alias("object_type"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("object_name"), F.lit("M").alias("module_name"), F.lit("m").alias("method_name"), F.lit("S()").alias("signature"), F.col("text").alias("code"), F.array(F.concat(F.lit("о "), F.md5("text"))).alias("comments"))
    return documents.code_chunks(methods).select("item_id", F.md5("document").alias("document_md5"))


@query("select doc_id, case when length(text) > 100 then substr(text, 1, 97) || '...' else text end head from documents")
def truncate_ellipsis(spark, d):
    return t(spark, d, "documents").select("doc_id", T.truncated("text", 100).alias("head"))


@query(r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) text_md5 from pages")
def html_strip(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(T.strip_html("html")).alias("text_md5"))


@query("select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) title from pages")
def html_title_extract(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


@query(r"""with l as (select doc_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) v from (""" + _LINES + """)), f as (select doc_id, v, min(n) n from l where length(v) >= 2 group by all),
r as (select *, row_number() over (partition by doc_id order by n) k from f) select d.doc_id, cast(count(v) as integer) n_texts, coalesce(md5(string_agg(v, chr(10) order by n)), md5('')) texts_md5 from documents d left join (select * from r where k <= 40) r on d.doc_id = r.doc_id group by 1""")
def unique_texts(spark, d):
    x = t(spark, d, "documents").select("doc_id", T.unique_texts(F.split("text", "\n", -1), 40).alias("u"))
    return x.select("doc_id", F.size("u").alias("n_texts"), F.md5(F.array_join("u", "\n")).alias("texts_md5"))


_P = "string_split(regexp_extract(url, '^[a-z]+://[^/]*/?([^?#]*)', 1), '/')"


@query(f"select page_id, case when len({_P}) > 1 then {_P}[1] else 'Unknown' end object_type, case when len({_P}) > 2 then {_P}[2] else regexp_replace({_P}[-1], '\\.[^.]*$', '') end object_name, regexp_replace({_P}[-1], '\\.[^.]*$', '') module_name from pages")
def path_parts(spark, d):
    return t(spark, d, "pages").withColumn("p", T.path_parts(F.regexp_extract("url", "^[a-z]+://[^/]*/?([^?#]*)", 1))).select("page_id", "p.*")


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_type when p_partkey % 3 = 1 then p_type end object_type, p_name object_name, case when p_partkey % 3 < 2 then 'metadata:' || p_type || ':' || p_name end node_id
from (select p_partkey, replace(p_type, '.', '') p_type, replace(trim(p_name), '.', '') p_name from part)""")
def identifier_parse(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit("."), F.lit("")).alias("t"), F.replace(F.trim("p_name"), F.lit("."), F.lit("")).alias("n"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(":", F.lit("metadata"), "t", "n")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(".", "t", "n")).otherwise(F.col("n"))
    return p.withColumn("i", T.identifier(raw)).select("p_partkey", "i.*")


_CODE = "replace(replace(text, ' the ', ' Справочники.'), ' and ', '; документы.')"


@query(f"""select doc_id, list_reduce(list_prepend([]::varchar[], list_transform(regexp_extract_all({_CODE}, '(?i)(Справочники|Документы)\\.([\\p{{L}}\\p{{M}}\\p{{N}}_]+)'), lambda m: [case lower(split_part(m, '.', 1)) when 'справочники' then 'Catalogs' else 'Documents' end || '.' || split_part(m, '.', 2)])),
lambda a, x: case when list_contains(a, x[1]) then a else list_concat(a, x) end) refs_list from documents""".replace("refs_list from", "refs from"))
def code_references(spark, d):
    code = F.replace(F.replace("text", F.lit(" the "), F.lit(" Справочники.")), F.lit(" and "), F.lit("; документы."))
    return t(spark, d, "documents").select("doc_id", F.transform(T.code_references(code), lambda r: F.concat(r["ref_type"], F.lit("."), r["ref_name"])).alias("refs"))


_RAW_PREFIX = "regexp_replace(regexp_replace(url, '[^\\p{L}\\p{M}\\p{N}_\\-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"select page_id, substr({_RAW_PREFIX}, 1, 64) || '_code_' || page_id item_id from pages")
def item_id(spark, d):
    return t(spark, d, "pages").select("page_id", F.concat_ws("_", T.source_prefix("url", F.lit("")), F.lit("code"), F.col("page_id").cast("string")).alias("item_id"))


@query("select conv_id, turn, regexp_matches(lower(text), 'завис|ссыл|влия|использу|связ|затрон|impact|depend|where used') wants_graph from conversations")
def intent_filter(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.wants_graph("text").alias("wants_graph"))


@query("select doc_id, case when ends_with(text, '.') then text else text || '.' end = text has_eos from documents")
def eos_suffix(spark, d):
    return t(spark, d, "documents").select("doc_id", (T.with_eos("text", ".") == F.col("text")).alias("has_eos"))


@query("select o_orderkey, list_transform(string_split('Catalog.N' || o_custkey || '.Attr', '.'), lambda x: x)[2] object_name, case when o_orderkey % 2 = 0 then 'Catalogs' end object_type from orders")
def rights_target(spark, d):
    ref = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Catalog").otherwise("Nothing"), F.lit(".N"), F.col("o_custkey").cast("string"), F.lit(".Attr"))
    return t(spark, d, "orders").withColumn("r", T.rights_target(ref)).select("o_orderkey", "r.object_name", "r.object_type")


@query("""select page_id, case when contains(h, 'datacompositionschema') or contains(h, 'data-composition-system') then 'DataCompositionSchema' when contains(h, 'spreadsheet') then 'SpreadsheetDocument'
when contains(h, '<html') or contains(h, 'htmldocument') or contains(h, 'text/html') then 'HTMLDocument' when contains(h, 'geographicalschema') then 'GeographicalSchema' when contains(h, 'graphicalschema') then 'GraphicalSchema'
when contains(h, 'activedocument') then 'ActiveDocument' else 'Template' end kind from (select page_id, lower(substr(html, 1, 8000)) h from pages)""")
def template_kind(spark, d):
    return t(spark, d, "pages").select("page_id", T.template_kind("html", F.lit("html"), F.lit("")).alias("kind"))


@query("select event_id, json_extract_string(props, '$.k') k from events")
def json_extra(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select vec_id, cast(len(e) as integer) dim, round(list_sum(e)::double, 4) total from (select doc_id vec_id, (list_transform(range(16), lambda k: coalesce(list_sum(list_transform(range(k, length(text), 16), lambda i: (unicode(substr(text, cast(i + 1 as bigint), 1)) % 17) / 17.0)), 0) + case when k = 0 then 1 else 0 end)).list_transform(lambda x: x::float::double) e from documents)")
def toy_embedding(spark, d):
    e = t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), T.toy_embedding("text").alias("e"))
    return e.select("vec_id", F.size("e").alias("dim"), F.round(F.aggregate("e", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


# ------------------------------------------------------------------ graph

_NODES = """select 'metadata:Region:' || r_name id, 'Metadata' node_type, r_name as name, 'Region' object_type, r_name object_name from region
union all select 'metadata:Nation:' || n_name, 'Metadata', n_name, 'Nation', n_name from nation
union all select 'method:Nation:' || n_name || ':Supplier:' || s_name, 'Method', s_name, 'Nation', n_name from supplier join nation on s_nationkey = n_nationkey
union all select 'form:Nation:' || n_name || ':' || c_name, 'Form', c_name, 'Nation', n_name from customer join nation on c_nationkey = n_nationkey"""
_EDGES = """select 'metadata:Nation:' || n_name source, 'metadata:Region:' || r_name target, 'REFERENCES' edge_type from nation join region on n_regionkey = r_regionkey
union all select 'metadata:Nation:' || n_name, 'method:Nation:' || n_name || ':Supplier:' || s_name, 'HAS_METHOD' from supplier join nation on s_nationkey = n_nationkey
union all select 'metadata:Nation:' || n_name, 'form:Nation:' || n_name || ':' || c_name, 'HAS_FORM' from customer join nation on c_nationkey = n_nationkey"""


def _graph(spark, d):
    region, nation = t(spark, d, "region"), t(spark, d, "nation")
    suppliers = t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customers = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def node(df, kind, ident, name, object_type, object_name):
        return df.select(ident.alias("id"), F.lit(kind).alias("node_type"), F.col(name).alias("name"), F.lit(object_type).alias("object_type"), F.col(object_name).alias("object_name"))

    def edge(df, source, target, kind):
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"))

    def meta(kind, c):
        return F.concat(F.lit(f"metadata:{kind}:"), c)

    method, form = F.concat_ws(":", F.lit("method:Nation"), "n_name", F.lit("Supplier"), "s_name"), F.concat_ws(":", F.lit("form:Nation"), "n_name", "c_name")
    nodes = node(region, "Metadata", meta("Region", "r_name"), "r_name", "Region", "r_name").union(node(nation, "Metadata", meta("Nation", "n_name"), "n_name", "Nation", "n_name"))
    nodes = nodes.union(node(suppliers, "Method", method, "s_name", "Nation", "n_name")).union(node(customers, "Form", form, "c_name", "Nation", "n_name"))
    edges = edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), meta("Nation", "n_name"), meta("Region", "r_name"), "REFERENCES")
    edges = edges.union(edge(suppliers, meta("Nation", "n_name"), method, "HAS_METHOD")).union(edge(customers, meta("Nation", "n_name"), form, "HAS_FORM"))
    return nodes, edges


@query(_NODES)
def graph_nodes(spark, d):
    return _graph(spark, d)[0]


@query(_EDGES)
def graph_edges(spark, d):
    return _graph(spark, d)[1]


def _near_sql(here: str, there: str) -> str:
    return f"""with n as ({_NODES}), e as ({_EDGES}), me as (select id from n where id in ('Nation.NATION_3', 'metadata:Nation:NATION_3') or (object_type = 'Nation' and name = 'NATION_3') or object_name = 'NATION_3' or name = 'NATION_3'),
x as (select distinct n.id, n.name, n.object_type, n.object_name, e.edge_type from e join n on n.id = e.{there} where e.{here} in (select id from me))
select object_type || '.' || coalesce(nullif(object_name, ''), name) object, id node_id, edge_type from x order by edge_type, name, id limit 100"""


@query(_near_sql("target", "source"))
def graph_dependencies(spark, d):
    return graph.neighbours(*_graph(spark, d), "Nation.NATION_3", True)


@query(_near_sql("source", "target"))
def graph_references(spark, d):
    return graph.neighbours(*_graph(spark, d), "Nation.NATION_3", False)


def _built(spark, d):
    """Nations as objects, regions as templates of one of them, suppliers as methods whose code names objects, customers as forms."""
    nation = t(spark, d, "nation")
    rights = "array<struct<name: string, rights: array<string>>>"

    def table(df, kind, name, owner_type, owner, template):
        return df.select(F.lit(kind).alias("object_type_dir"), F.col(name).alias("name"), F.lit("").alias("synonym"), F.lit("").alias("kind"), F.lit(None).cast(rights).alias("granted_objects"), F.lit(owner_type).alias("owner_type"), F.lit(owner).alias("owner_name"), template.alias("template_name"))

    objects = table(nation, "Catalogs", "n_name", "", "", F.lit("")).union(table(t(spark, d, "region"), "Templates", "r_name", "Catalogs", "NATION_0", F.col("r_name")))
    code = F.concat(F.lit("x = Справочники.NATION_"), (F.col("s_suppkey") % 25).cast("string"), F.lit("; документы.Д"), (F.col("s_suppkey") % 3).cast("string"), F.lit(".Найти()"))
    methods = t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("Catalogs").alias("object_type"), F.col("n_name").alias("object_name"), F.lit("М").alias("module_name"), F.col("s_name").alias("method_name"), F.lit("").alias("signature"), code.alias("code"))
    forms = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("Catalogs").alias("object_type"), F.col("n_name").alias("object_name"), F.col("c_name").alias("form_name"), (F.col("c_custkey") % 5).cast("int").alias("elements_count"))
    return graph.build(objects, methods, forms)


@query("""with m as (select * from supplier join nation on s_nationkey = n_nationkey)
select 'metadata:Catalogs:' || n_name source, 'method:Catalogs:' || n_name || ':М:' || s_name target, 'HAS_METHOD' edge_type from m
union all select 'metadata:Catalogs:' || n_name, 'form:Catalogs:' || n_name || ':' || c_name, 'HAS_FORM' from customer join nation on c_nationkey = n_nationkey
union all select distinct 'metadata:Catalogs:' || n_name, 'metadata:Catalogs:NATION_' || s_suppkey % 25, 'USES_IN_CODE' from m
union all select distinct 'metadata:Catalogs:' || n_name, 'metadata:Documents:Д' || s_suppkey % 3, 'USES_IN_CODE' from m
union all select 'metadata:Catalogs:NATION_0', 'metadata:Templates:' || r_name, 'HAS_TEMPLATE' from region""")
def graph_built_edges(spark, d):
    return _built(spark, d)[1].select("source", "target", "edge_type")


@query("""select 'metadata:Catalogs:' || n_name id, 'Metadata' node_type, n_name as name, 'Catalogs' object_type, n_name object_name from nation
union all select 'metadata:Templates:' || r_name, 'Metadata', r_name, 'Templates', r_name from region
union all select distinct 'metadata:Documents:Д' || s_suppkey % 3, 'Metadata', 'Д' || s_suppkey % 3, 'Documents', 'Д' || s_suppkey % 3 from supplier
union all select 'method:Catalogs:' || n_name || ':М:' || s_name, 'Method', s_name, 'Catalogs', n_name from supplier join nation on s_nationkey = n_nationkey
union all select 'form:Catalogs:' || n_name || ':' || c_name, 'Form', c_name, 'Catalogs', n_name from customer join nation on c_nationkey = n_nationkey""")
def graph_built_nodes(spark, d):
    return _built(spark, d)[0].select("id", "node_type", "name", "object_type", "object_name")


@query(f"select coalesce(node_type, '') kind, count(*) n from ({_NODES}) group by rollup (node_type)")
def graph_stats_nodes(spark, d):
    return graph.counts(_graph(spark, d)[0], "node_type")


@query(f"select coalesce(edge_type, '') kind, count(*) n from ({_EDGES}) group by rollup (edge_type)")
def graph_stats_edges(spark, d):
    return graph.counts(_graph(spark, d)[1], "edge_type")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) event_id, arg_max(value, (ts, event_id)) value from events group by all")
def graph_upsert(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return graph.upsert(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select source, target, edge_type, extra from (select *, row_number() over (partition by source, target, edge_type order by extra desc) r from (select 'c' || o_custkey source, 's' || o_orderstatus target, 'REFERENCES' edge_type, o_orderpriority extra from orders)) where r = 1")
def graph_edge_dedupe(spark, d):
    o = t(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s"), "o_orderstatus").alias("target"), F.lit("REFERENCES").alias("edge_type"), F.col("o_orderpriority").alias("extra"))
    return graph.upsert(graph.checked_edges(o), ["source", "target", "edge_type"], ["extra"])


@query(f"with n as (select * from ({_NODES}) where node_type <> 'Form'), e as ({_EDGES}) select * from e where source in (select id from n) and target in (select id from n)")
def graph_drop_dangling(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.drop_dangling(edges, nodes.where("node_type <> 'Form'")).select("source", "target", "edge_type")


@query("select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey < 5 or c_mktsegment in ('BUILDING', 'MACHINERY')")
def known_or_fallback(spark, d):
    """References of orders to customers: those known, and those of types that are trusted unseen."""
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), K.FALLBACK_TYPES[0]).otherwise("Odd")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), kind.alias("ref_type"), F.col("c_custkey").cast("string").alias("ref_name"), "c_nationkey")
    known = c.where("c_nationkey < 5").select(F.col("ref_type").alias("object_type"), F.col("ref_name").alias("name"))
    refs = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c.drop("c_nationkey"), "o_custkey")
    return graph.admissible(refs, known).select("o_orderkey")


_ASIA = f"""with n as ({_NODES}), e as ({_EDGES}), me as (select id from n where id in ('Region.ASIA', 'metadata:Region:ASIA') or (object_type = 'Region' and name = 'ASIA') or object_name = 'ASIA' or name = 'ASIA'),
x as (select distinct n.id, n.name, n.object_type, n.object_name, e.edge_type from e join n on n.id = e.source where e.target in (select id from me)),
near as (select object_type || '.' || coalesce(nullif(object_name, ''), name) object, id node_id, edge_type from x order by edge_type, name, id limit 20)"""


@query(f"{_ASIA} select object, node_id, edge_type from near where object not in (select 'Nation.' || n_name from nation where n_nationkey % 2 = 0)")
def caller_anti(spark, d):
    """Graph neighbours of a name that are not among the callers found."""
    nodes, edges = _graph(spark, d)
    usages = t(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("Nation."), "n_name").alias("object"))
    return Store(spark, {"nodes": nodes, "edges": edges}).graph_related("Region.ASIA", usages).select("object", "node_id", "edge_type")


@query("""with g as (select distinct o_custkey, o_orderstatus s from orders where o_orderstatus <> 'P'), r as (select o_custkey, string_agg(s, ',' order by s) rights from g group by 1)
select 'metadata:Roles:R' || o_custkey source, 'metadata:Catalogs:N' || o_custkey target, 'HAS_RIGHT' edge_type, rights from r""")
def rights_explode(spark, d):
    """Roles that grant rights become edges, by the graph's builder."""
    own = t(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("rights"))  # a set of three values at most
    name = F.col("o_custkey").cast("string")
    granted = F.array(F.struct(F.concat(F.lit("Catalog.N"), name, F.lit(".Attribute.A")).alias("name"), F.col("rights").alias("rights")))
    objects = own.select(F.lit("Roles").alias("object_type_dir"), F.concat(F.lit("R"), name).alias("name"), F.lit("").alias("synonym"), F.lit("Role").alias("kind"), granted.alias("granted_objects"), F.lit("").alias("owner_type"), F.lit("").alias("owner_name"), F.lit("").alias("template_name"))
    methods = spark.createDataFrame([], "object_type string, object_name string, module_name string, method_name string, signature string, code string")
    forms = spark.createDataFrame([], "object_type string, object_name string, form_name string, elements_count int")
    return graph.build(objects, methods, forms)[1].select("source", "target", "edge_type", F.get_json_object("extra", "$.rights").alias("rights"))


@query("select 'code' collection, count(*) n from documents union all select 'metadata', count(*) from part union all select 'forms', count(*) from pages union all select 'total', (select count(*) from documents) + (select count(*) from part) + (select count(*) from pages)")
def collection_counts(spark, d):
    return Store(spark, {"code": t(spark, d, "documents"), "metadata": t(spark, d, "part"), "forms": t(spark, d, "pages")}).stats()


@query("""with l as (select l_partkey, string_agg(l_orderkey || ' (' || l_linenumber || ')', ', ' order by l_orderkey, l_linenumber) a from lineitem group by 1)
select p_partkey, 'Тип: ' || p_type || chr(10) || 'Имя: ' || p_name || chr(10) || 'Синоним: ' || p_brand || chr(10) || 'Комментарий: ' || coalesce(chr(10) || 'Реквизиты: ' || a, '') document from part left join l on l_partkey = p_partkey""")
def metadata_document(spark, d):
    """Parts as objects, their order lines as attributes."""
    order = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber")))
    attributes = F.transform(order, lambda a: F.struct(a["l_orderkey"].cast("string").alias("name"), a["l_linenumber"].cast("string").alias("type")))
    lists = t(spark, d, "lineitem").groupBy("l_partkey").agg(attributes.alias("attributes"))
    p = t(spark, d, "part").join(lists, F.col("p_partkey") == F.col("l_partkey"), "left")
    text, texts, fields = "string", "array<string>", "array<struct<name: string, type: string>>"
    none = {"comment": text, "kind": text, "object_type_dir": text, "body_text": text, "owner_type": text, "owner_name": text, "template_name": text, "dimensions": fields, "resources": fields, "tabular_sections": "array<struct<name: string, attributes: array<struct<name: string, type: string>>>>", "commands": texts, "granted_objects": "array<struct<name: string, rights: array<string>>>"}
    none |= {c: texts for c in ("queries", "cell_texts", "data_sets", "parameters", "fields", "named_areas")}
    objects = p.select("p_partkey", F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("synonym"), "attributes", *[F.lit(None).cast(k).alias(c) for c, k in none.items()])
    return objects.select("p_partkey", documents.object_document().alias("document"))


@query("select conv_id, 'Форма: F' || conv_id || chr(10) || 'Объект: ' || max(case when turn = 0 then role end) || chr(10) || 'Элементы: ' || string_agg(case when turn < 20 then role || turn end, ', ' order by turn) document, 'main_form_Conversation_' || max(case when turn = 0 then role end) || '_F' || conv_id item_id from conversations group by conv_id")
def form_document(spark, d):
    """Conversations as forms, their turns as elements, of which the first 20 count."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    own = t(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("s"))
    forms = own.select("conv_id", F.concat(F.lit("F"), F.col("conv_id").cast("string")).alias("form_name"), F.lit("Conversation").alias("object_type"), F.col("s")[0]["role"].alias("object_name"), F.transform("s", lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("elements"))
    return documents.form_items(forms).select("conv_id", "document", "item_id")


def _cut(text: str, n: int) -> str:
    return f"case when length({text}) > {n} then substr({text}, 1, {n - 3}) || '...' else {text} end"


@query(f"""with r as (select label question_id, vec_id, text, row_number() over (partition by label order by vec_id) r from embeddings join documents on vec_id = doc_id),
a as (select question_id, '== ОБЪЕКТЫ МЕТАДАННЫХ ==' || chr(10) || string_agg('- D.' || vec_id || ' (x)' || chr(10) || '  Описание: ' || {_cut('text', 300)}, chr(10) order by r) t from r where r <= 8 group by 1),
b as (select question_id, '== ФРАГМЕНТЫ КОДА ==' || chr(10) || string_agg('- D.' || vec_id || ' / M' || chr(10) || '  Сигнатура: S()' || chr(10) || '  Файл: /f/' || vec_id || chr(10) || '  ```bsl' || chr(10) || {_cut('text', 1200)} || chr(10) || '  ```', chr(10) order by r) t from r where r <= 6 group by 1),
c as (select question_id, '== ФОРМЫ ==' || chr(10) || string_agg('- ' || vec_id || ' (D), элементов: ' || vec_id % 7, chr(10) order by r) t from r where r <= 5 group by 1),
g as (select question_id, chr(10) || 'На объект ссылаются (зависят от него):' || chr(10) || string_agg(case when r <= 25 then '  - D.' || vec_id || ' [REFERENCES]' end, chr(10) order by r) || chr(10) || 'Объект ссылается на (использует):' || chr(10) || string_agg(case when r <= 25 then '  - E.' || vec_id || ' [HAS_FORM]' end, chr(10) order by r) t from r group by 1),
w as (select a.question_id, concat_ws(chr(10) || chr(10), a.t, b.t, c.t, '== ГРАФ ЗАВИСИМОСТЕЙ для ' || chr(39) || 'Q' || a.question_id || chr(39) || ' ==' || g.t) x from a join b on a.question_id = b.question_id join c on a.question_id = c.question_id join g on a.question_id = g.question_id)
select question_id, md5({_cut('x', 14000)}) context_md5 from w""")
def rag_context(spark, d):
    """Labels as questions, their vectors' documents as hits: 8 objects, 6 snippets, 5 forms, 25 neighbours a side, 14,000 characters."""
    e = t(spark, d, "embeddings").select(F.col("label").alias("question_id"), F.col("vec_id").alias("rank")).join(t(spark, d, "documents").select(F.col("doc_id").alias("rank"), "text"), "rank")
    name = F.col("rank").cast("string")
    objects = e.withColumns({"type": F.lit("D"), "name": name, "synonym": F.lit("x"), "description": F.col("text"), "file_path": F.lit("")})
    code = e.withColumns({"object": F.concat(F.lit("D."), name), "module": F.lit("M"), "method": F.lit(""), "signature": F.lit("S()"), "code": F.col("text"), "file_path": F.concat(F.lit("/f/"), name)})
    forms = e.withColumns({"form_name": name, "object": F.lit("D"), "elements_count": (F.col("rank") % 7).cast("int")})
    asked = F.concat(F.lit("Q"), F.col("question_id").cast("string"))
    near = [e.select("question_id", "rank", asked.alias("asked"), F.lit(side).alias("side"), F.concat(F.lit(p), name).alias("object"), F.lit(kind).alias("edge_type")) for side, p, kind in (("dependencies", "D.", "REFERENCES"), ("references", "E.", "HAS_FORM"))]
    return context(objects, code, forms, near[0].union(near[1])).select("question_id", F.md5("context").alias("context_md5"))


@query("select case when event_type = 'click' then 'Metadata' when event_type = 'view' then 'Method' else 'Form' end kind, count(*) n from events where event_type not in ('error', 'signup') group by 1 union all select '', count(*) from events where event_type not in ('error', 'signup')")
def checked_enum(spark, d):
    """Events as nodes: rows of unknown types and rows without an id fall out."""
    kind = F.when(F.col("event_type") == "click", "Metadata").when(F.col("event_type") == "view", "Method").when(F.col("event_type") == "purchase", "Form").otherwise(F.col("event_type"))
    nodes = t(spark, d, "events").select(F.when(F.col("event_type") != "signup", F.col("event_id").cast("string")).alias("id"), kind.alias("node_type"), *[F.lit("").alias(c) for c in ("name", "object_type", "object_name", "synonym", "extra")])
    return graph.counts(graph.checked_nodes(nodes), "node_type")


@query("select p_partkey, list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '') words from part")
def csv_list(spark, d):
    return t(spark, d, "part").select("p_partkey", T.csv_list(F.replace("p_name", F.lit(" "), F.lit(","))).alias("words"))
