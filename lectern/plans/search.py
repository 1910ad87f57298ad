"""Queries of search, fusion and context, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import citation, embed_text, terms
from lectern.operators import context, dense, fusion, ingest, lexical, variants
from lectern.plans.tables import table

K = 10


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vector_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(_questions(spark, d), table(spark, d, "documents"), K)


def bm25_filtered_global_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(_questions(spark, d), table(spark, d, "documents"), K, F.col("source").isin("src1", "src2"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(_vector_questions(spark, d), table(spark, d, "embeddings"), K)


def dense_topk_arrow(spark: SparkSession, d: str) -> DataFrame:
    """The same against an index that is built first, as a batch of searches shares one."""
    vectors = table(spark, d, "embeddings")
    return dense.search(_vector_questions(spark, d), vectors, K, index=dense.build(vectors))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(_vector_questions(spark, d), table(spark, d, "embeddings"), K, F.col("label").isin(1, 3))


def _lists(spark: SparkSession, d: str, k: int = 40) -> DataFrame:
    """Dense and lexical lists; a benchmark item and the vector of the same number are one query,
    a document and the vector of its number one passage."""
    bm = lexical.search(_questions(spark, d), table(spark, d, "documents"), k).select("query_id", "doc_id", F.lit("bm25").alias("retriever"), "rank")
    emb = table(spark, d, "embeddings")
    q = emb.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    known = emb.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    de = dense.search(q, known, k).select("query_id", F.col("vec_id").alias("doc_id"), F.lit("dense").alias("retriever"), "rank")
    return de.unionByName(bm).withColumn("variant", F.lit(0))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d), K)


def variant_search(spark: SparkSession, d: str) -> DataFrame:
    """Four variants of each item in one search: itself, its first and its last half, and the beginning of the
    document of its number as a hypothetical passage."""
    words = F.split("text", " ")
    half = (F.size(words) / 2).cast("int")
    rewrites = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "), F.lit(" "))
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 300).alias("passage"))
    asked = variants.keyed(variants.asked(_questions(spark, d).withColumn("rewrites", rewrites).join(passages, "query_id", "left"), 2))
    found = lexical.search(asked, table(spark, d, "documents"), 40, query="asked").select("asked", "doc_id", F.lit("bm25").alias("retriever"), "rank")
    return fusion.fuse(variants.unkeyed(found, "bigint"), K)


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Fusion alone, over lists made from the labels of vectors: four lists of two variants."""
    emb = table(spark, d, "embeddings").select("vec_id", "label")
    make = lambda variant, retriever, off: emb.select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), F.lit(variant).alias("variant"), F.lit(retriever).alias("retriever"), F.row_number().over(W.partitionBy("label").orderBy(F.pmod(F.col("vec_id") * (7 + off), F.lit(101)), "vec_id")).cast("long").alias("rank")).where("rank <= 12")
    lists = make(0, "dense", 0).unionByName(make(0, "bm25", 1)).unionByName(make(1, "dense", 2)).unionByName(make(1, "bm25", 4))
    return fusion.fuse(lists, 12)


def rerank_floor(spark: SparkSession, d: str) -> DataFrame:
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    top = lexical.search(q, docs, 12)
    rows = top.join(q.select("query_id", terms(F.col("text")).alias("qt")), "query_id").join(docs.select("doc_id", terms(F.col("text")).alias("dt")), "doc_id")
    rows = rows.withColumn("overlap", F.round(fusion.overlap_score(F.col("qt"), F.col("dt")), 6))
    return fusion.rerank(rows, F.col("overlap"), 8, 0.3).select("query_id", "doc_id", "rerank_score", "relevance_rank")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the source is the book, the order of ids the ordinal."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("ordinal"), "text", "lang")


def _hits(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    top = lexical.search(_questions(spark, d), table(spark, d, "documents"), 4).withColumnsRenamed({"doc_id": "id", "rank": "relevance_rank"})
    return top.join(chunks.select("id", "book_id", "ordinal"), "id")


def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return context.expand_neighbours(_hits(spark, d, chunks), chunks, 1).select("query_id", "id", "book_id", "ordinal", F.round("score", 6).alias("score"), "is_neighbor", "relevance_rank")


def dedup_gap_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours over ordinals that passage dedup left with gaps."""
    chunks = _chunks(spark, d)
    kept = ingest.dedup_passages(chunks, "text", ("id",))
    hits = kept.where(F.col("id") % 50 == 0).select(F.lit(0).cast("long").alias("query_id"), "id", "book_id", "ordinal", F.lit(1.0).alias("score"), F.col("id").alias("relevance_rank"))
    return context.expand_neighbours(hits, kept, 1).select("id", "book_id", "ordinal", "score", "is_neighbor")


def _context_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    rows = context.reading_order(context.expand_neighbours(_hits(spark, d, chunks), chunks, 1))
    rows = rows.join(chunks.select("id", "text"), "id")
    return rows.withColumn("citation", citation(F.col("book_id"), F.lit(""), F.lit(""), F.col("ordinal"), F.col("ordinal")))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return context.select_within(_context_rows(spark, d), 1500).select("query_id", "id", "position", "number", "tokens")


def context_render(spark: SparkSession, d: str) -> DataFrame:
    made = context.render(context.select_within(_context_rows(spark, d), 1500))
    return made.select("query_id", F.size("citations").alias("n_citations"), F.array_join("citations", " | ").alias("citations"), F.length("context").alias("context_chars"))


def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    section = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")))
    made = embed_text(F.col("source"), F.col("lang"), section, F.col("text"))
    label = citation(F.col("source"), F.col("lang"), section, F.col("doc_id"), F.col("doc_id") + F.col("doc_id") % 2)
    return docs.select("doc_id", made.alias("embed_text"), label.alias("citation"))


BM25 = r"""
tok as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
sz as (select count(*) as n, avg(len(t)) as avgdl from tok),
tf as (select doc_id, term, count(*) as f, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from tok) group by 1, 2),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, sz group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
qt as (select query_id, term, count(*) as qf from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by 1, 2),
hit as (select query_id, doc_id, round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
        from qt join idf using (term) join tf using (term), sz group by 1, 2),
bm as (select item_id as query_id, doc_id, coalesce(score, 0) as score from benchmark, documents left join hit on hit.query_id = item_id and hit.doc_id = documents.doc_id @)
"""
BM25 = BM25.replace("from benchmark, documents left join", "from (select item_id, doc_id, source from benchmark, documents) as bd left join").replace("hit.query_id = item_id and hit.doc_id = documents.doc_id", "hit.query_id = bd.item_id and hit.doc_id = bd.doc_id").replace("select item_id as query_id, doc_id, coalesce", "select bd.item_id as query_id, bd.doc_id, coalesce")


def bm25_sql(k: int, name: str = "top", where: str = "") -> str:
    return f"{BM25.replace('@', where)}, {name} as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm qualify rank <= {k})"


DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::double * v.embedding[i]::double))"


def _dense(where: str = "") -> str:
    return f"""
with q as (select vec_id as query_id, embedding from embeddings where vec_id % 50 = 0),
s as (select query_id, v.vec_id, round({DOT}, 6) as score from q, embeddings v {where})
select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= {K}"""


FUSE = """
w as (select *, (case retriever when 'dense' then 1.0 else 0.8 end * case variant when 0 then 1.0 else 0.7 end)::double / (60 + rank) as w, variant * 2 + (retriever <> 'dense')::int as list from lists),
f as (select query_id, doc_id, round(sum(w), 9) as score, min(case when retriever = 'dense' then rank end) as dense_rank,
             min(case when retriever = 'bm25' then rank end) as bm25_rank, min(list * 1000000 + rank) as tie from w group by 1, 2)
select query_id, doc_id, score, dense_rank, bm25_rank, row_number() over (partition by query_id order by score desc, tie) as rank from f qualify rank <= @
"""
CHUNKS = "c as (select doc_id as id, source as book_id, row_number() over (partition by source order by doc_id) as ordinal, text from documents)"
NEAR = """
h as (select query_id, id, book_id, ordinal, score, rank as relevance_rank from top join c on c.id = top.doc_id),
nb as (select h.query_id, c.id, c.book_id, c.ordinal, h.score * 0.5 as score, true as is_neighbor, h.relevance_rank
       from h join c on c.book_id = h.book_id and abs(c.ordinal - h.ordinal) = 1
       where (h.query_id, c.id) not in (select query_id, id from h)
       qualify row_number() over (partition by h.query_id, c.id order by h.relevance_rank) = 1),
x as (select query_id, id, book_id, ordinal, score, false as is_neighbor, relevance_rank from h union all select * from nb)
"""
BUDGET = """
y as (select x.*, text, book_id || ', p.' || ordinal as citation, row_number() over (partition by query_id order by book_id, ordinal) as position, count(*) over (partition by query_id) as n from x join c using (id, book_id, ordinal)),
z as (select *, greatest(1, length(text) // 4) as cost, greatest(1, length('[' || n || '] ' || citation) // 4) + 4 as header from y),
g as (select query_id, list(struct_pack(p := position, late := is_neighbor, cost := cost, header := header) order by is_neighbor, -score, position) as items from z group by 1),
r as (select query_id, list_reduce(list_prepend(struct_pack(used := 0::bigint, taken := []::struct(p bigint, t bigint)[], p := 0::bigint, late := false, cost := 0::bigint, header := 0::bigint),
        list_transform(items, lambda i: struct_pack(used := 0::bigint, taken := []::struct(p bigint, t bigint)[], p := i.p, late := i.late, cost := i.cost, header := i.header))),
        lambda a, i: case when a.used + i.cost + i.header <= 1500 then struct_pack(used := a.used + i.cost + i.header, taken := list_append(a.taken, struct_pack(p := i.p, t := i.cost)), p := 0::bigint, late := false, cost := 0::bigint, header := 0::bigint)
                     when len(a.taken) = 0 and not i.late and 1500 - a.used - i.header >= 20 then struct_pack(used := 1500::bigint, taken := list_append(a.taken, struct_pack(p := i.p, t := 1500 - a.used - i.header)), p := 0::bigint, late := false, cost := 0::bigint, header := 0::bigint)
                     else a end).taken as taken from g),
k as (select query_id, unnest(taken) as t from r),
s as (select z.query_id, z.id, z.position, row_number() over (partition by z.query_id order by z.position)::int as number, k.t.t::int as tokens, z.text, z.citation from k join z on z.query_id = k.query_id and z.position = k.t.p)
"""
HYBRID = f"""
dq as (select vec_id as query_id, embedding from embeddings where vec_id in (select item_id from benchmark)),
dv as (select vec_id, embedding from embeddings where vec_id in (select doc_id from documents)),
ds as (select query_id, v.vec_id as doc_id, round({DOT}, 6) as score from dq q, dv v),
dt as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from ds qualify rank <= 40),
lists as (select query_id, doc_id, 'dense' as retriever, rank, 0 as variant from dt union all select query_id, doc_id, 'bm25', rank, 0 from top),
"""
VARIANTS = f"""
with items as (select item_id, text, string_split(text, ' ') as w from benchmark),
v as (select item_id, 0 as variant, text from items
      union all select item_id, 1, array_to_string(w[1:len(w) // 2], ' ') from items where len(w) > 1
      union all select item_id, case when len(w) > 1 then 2 else 1 end, array_to_string(w[len(w) // 2 + 1:], ' ') from items where len(w) > 1
      union all select item_id, case when len(w) > 1 then 3 else 1 end, substring(d.text, 1, 300) from items join documents d on d.doc_id = item_id where substring(d.text, 1, 300) <> ''),
qs as (select item_id * 10 + variant as item_id, text from v),
{bm25_sql(40).replace("benchmark", "qs")},
lists as (select query_id // 10 as query_id, (query_id % 10)::int as variant, 'bm25' as retriever, doc_id, rank from top), {FUSE.replace("@", str(K))}"""
MAKE = "select label::bigint as query_id, vec_id as doc_id, {v} as variant, '{r}' as retriever, row_number() over (partition by label order by (vec_id * (7 + {o})) % 101, vec_id) as rank from embeddings qualify rank <= 12"

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered_global_stats, dense_topk, dense_topk_arrow, dense_topk_filtered, rrf_fuse, variant_search, hybrid_search, rerank_floor, neighbor_expand, dedup_gap_neighbors, context_budget, context_render, embed_texts)}
ORACLE_SQL = {
    "bm25_topk": f"with {bm25_sql(K)} select query_id, doc_id, score, rank from top",
    "bm25_filtered_global_stats": f"with {bm25_sql(K, where=chr(10) + 'where source in ({})'.format(chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src2' + chr(39)))} select query_id, doc_id, score, rank from top",
    "dense_topk": _dense(),
    "dense_topk_arrow": _dense(),
    "dense_topk_filtered": _dense("where v.label in (1, 3)"),
    "variant_search": VARIANTS,
    "rrf_fuse": "with lists as (" + " union all ".join(f"({MAKE.format(v=v, r=r, o=o)})" for v, r, o in ((0, "dense", 0), (0, "bm25", 1), (1, "dense", 2), (1, "bm25", 4))) + ")," + FUSE.replace("@", "12"),
    "hybrid_search": f"with {bm25_sql(40)}, {HYBRID} {FUSE.replace('@', str(K))}",
    "rerank_floor": f"""with {bm25_sql(12)},
s as (select query_id, top.doc_id, rank, round((select count(distinct t) from (select unnest(regexp_extract_all(lower(b.text), '[a-z0-9]+')) as t) where list_contains(regexp_extract_all(lower(d.text), '[a-z0-9]+'), t))::double
        / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 6) as rerank_score from top join benchmark b on b.item_id = query_id join documents d on d.doc_id = top.doc_id)
select query_id, doc_id, rerank_score, row_number() over (partition by query_id order by rerank_score desc, rank) as relevance_rank from s where rerank_score >= 0.3 qualify relevance_rank <= 8""",
    "neighbor_expand": f"with {bm25_sql(4)}, {CHUNKS}, {NEAR} select query_id, id, book_id, ordinal, round(score, 6) as score, is_neighbor, relevance_rank from x",
    "dedup_gap_neighbors": f"""with {CHUNKS},
k as (select * from c qualify row_number() over (partition by trim(regexp_replace(lower(text), '[\\s\\x{{00A0}}]+', ' ', 'g')) order by id) = 1),
h as (select * from k where id % 50 = 0)
select id, book_id, ordinal, 1.0::double as score, false as is_neighbor from h
union all select distinct k.id, k.book_id, k.ordinal, 0.5::double, true from h join k on k.book_id = h.book_id and abs(k.ordinal - h.ordinal) = 1 where k.id not in (select id from h)""",
    "context_budget": f"with {bm25_sql(4)}, {CHUNKS}, {NEAR}, {BUDGET} select query_id, id, position, number, tokens from s",
    "context_render": f"""with {bm25_sql(4)}, {CHUNKS}, {NEAR}, {BUDGET}
select query_id, count(*)::int as n_citations, string_agg(citation, ' | ' order by number) as citations,
       length(string_agg('[' || number || '] ' || citation || chr(10) || substring(text, 1, tokens * 4 + 3), chr(10) || chr(10) order by number))::int as context_chars from s group by 1""",
    "embed_texts": """with d as (select doc_id, source, lang, case when doc_id % 3 = 0 then '' else 's' || doc_id % 5 end as section, text as t, doc_id as a, doc_id + doc_id % 2 as b from documents)
select doc_id, '[' || source || ' > ' || lang || case when section <> '' then ' > ' || section else '' end || ']' || chr(10) || t as embed_text,
       source || ' > ' || lang || case when section <> '' and section <> lang then ' > ' || section else '' end || ', ' || case when a = b then 'p.' || a else 'pp.' || a || '-' || b end as citation from d""",
}
