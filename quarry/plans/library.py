"""Queries of the library of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import squeeze
from quarry.operators import admin, answer
from quarry.plans import sqltext as q
from quarry.plans.retrieval import load
from quarry.plans.texts import inline
from quarry.sources import documents

FILES = [("a.pdf", 10), ("b.xlsx", 10), ("c.md", 0), ("d.txt", 60 << 20), ("e.DOCX", 5), ("noending", 3)]
LANGS = ["de", "en", "es", "fr", "it"]


def list_documents_page(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return admin.page(docs, [F.col("n_chars").desc(), "doc_id"], limit=20, offset=10, lang="en")


def stats_by_status(spark, d):
    return admin.counts_by(load(spark, d, "documents"), "lang", LANGS)


def library_totals(spark, d):
    return load(spark, d, "documents").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


def library_hint(spark, d):
    docs = load(spark, d, "documents").where("lang = 'en'")
    five = docs.orderBy(F.col("doc_id").desc()).limit(5).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("doc_id", "source")))), lambda s: F.concat_ws("#", s["source"], s["doc_id"].cast("string"))), ", ").alias("names"))
    total = docs.agg(F.count("*").alias("total"))
    return five.crossJoin(total)  # a row each


def source_preview(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", answer.label(F.col("source"), F.col("lang"), F.lit(0), F.col("doc_id")).alias("label"), F.substring("text", 1, 600).alias("preview"))


def delete_document_cascade(spark, d):
    """What documents, vectors and labels keep when every third document goes."""
    docs = load(spark, d, "documents")
    tables = {"documents": (docs, "doc_id"), "embeddings": (load(spark, d, "embeddings"), "vec_id"), "labels": (load(spark, d, "labels"), "doc_id")}
    kept = admin.purge(tables, docs.where("doc_id % 3 = 0"), "doc_id")
    out = None
    for name, df in kept.items():
        part = df.select(F.lit(name).alias("table_name"), F.col(tables[name][1]).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def upsert_chunks(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("doc_id % 5 = 0").withColumn("n_chars", F.lit(0).cast("long")).unionByName(docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    return admin.upsert(docs, new, "doc_id")


def reindex_embed_hash(spark, d):
    """Every document embedded anew under its header: the numbers that aren't zero."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("section"), F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 4).cast("int")).alias("page"), "text")
    v = documents.reindex(docs).select(F.col("chunk_id").alias("doc_id"), F.posexplode("embedding").alias("dim", "value"))
    return v.where("value <> 0").select("doc_id", "dim", "value")


def upload_validation(spark, d):
    return admin.verdicts(inline(spark, FILES, "name string, length long")).select("name", "reason")


def document_state(spark, d):
    return admin.latest(load(spark, d, "events"), "user_id", "event_id", "event_type")


def file_names(spark, d):
    """The source of each passage's document, by a lookup join."""
    hits = load(spark, d, "labels").select("doc_id", "quality")
    return hits.join(load(spark, d, "documents").select("doc_id", "source"), "doc_id", "left").select("doc_id", "quality", "source")


def history_squeezed(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", squeeze(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (list_documents_page, stats_by_status, library_totals, library_hint, source_preview, delete_document_cascade, upsert_chunks, reindex_embed_hash, upload_validation, document_state, file_names, history_squeezed)}
SQL = {
    "list_documents_page": "select doc_id, lang, source, n_chars from documents where lang = 'en' order by n_chars desc, doc_id limit 20 offset 10",
    "stats_by_status": f"select l lang, count(doc_id) n from (select unnest({q.listed(LANGS)}) l) left join documents on lang = l group by 1",
    "library_totals": "select count(*) documents, coalesce(sum(n_chars), 0)::bigint chars from documents",
    "library_hint": "select (select string_agg(source || '#' || doc_id, ', ' order by doc_id desc) from (select * from documents where lang = 'en' order by doc_id desc limit 5)) as names, (select count(*) from documents where lang = 'en') total",
    "source_preview": "select doc_id, source || ' > ' || lang as label, substr(text, 1, 600) preview from documents",
    "delete_document_cascade": "select 'documents' as table_name, doc_id id from documents where doc_id % 3 <> 0 union all select 'embeddings', vec_id from embeddings where vec_id % 3 <> 0 or vec_id not in (select doc_id from documents) union all select 'labels', doc_id from labels where doc_id % 3 <> 0 or doc_id not in (select doc_id from documents)",
    "upsert_chunks": "select doc_id, source, case when doc_id % 5 = 0 then 0 else n_chars end n_chars from documents union all select doc_id + 1000000, source, n_chars from documents where doc_id < 10",
    "reindex_embed_hash": f"""with e as (select doc_id, '[Document: ' || source || case when doc_id % 3 > 0 then ' | Section: ' || lang else '' end || ' | Page: ' || doc_id % 4 || ']' || chr(10) || text as text from documents),
k as (select doc_id, md5(unnest({q.tok('text')})) h from e), b as (select doc_id, ('0x' || substr(h, 1, 7))::bigint % 64 dim, case when ('0x' || substr(h, 8, 1))::int % 2 = 0 then 1.0::double else -1.0 end s from k)
select doc_id, dim, sum(s) as value from b group by 1, 2 having sum(s) <> 0""",
    "upload_validation": "select * from (values ('a.pdf', null), ('b.xlsx', 'unsupported'), ('c.md', 'empty'), ('d.txt', 'too large'), ('e.DOCX', null), ('noending', 'unsupported')) v(name, reason)",
    "document_state": "select user_id, arg_max(event_type, event_id) event_type from events group by 1",
    "file_names": "select l.doc_id, quality, source from labels l left join documents using (doc_id)",
    "history_squeezed": f"select conv_id, turn, {q.squeeze('text')} as text from conversations",
}
