"""Queries of hygiene, parsing and chunking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions import text as t
from quarry.operators import chunk, parse
from quarry.plans import sqltext as q
from quarry.plans.retrieval import load

CLEAN = [(1, "hyphen-\nation"), (2, "a\n\n\n\n\nb"), (3, "a  b\t\tc  \nd   "), (4, "co­op eﬁcient ﬂow"), (5, "café-\nété"), (6, "  trim me \n \n \nb")]
LINES = [(1, "3.1 Methodology"), (2, "3.1. Results"), (3, "1 Introduction"), (4, "1.2.3.4 Deep"), (5, "Chapter One"), (6, "appendix B"), (7, "ALL CAPS LINE"), (8, "Ends with a stop."), (9, "plain prose line"), (10, "PARTLY Caps"), (11, "SECTION overview"), (12, "A, B,")]
BLOCKS = [(1, 0, "Annual Report", "heading", 1), (1, 1, "Intro text.", "text", 0), (1, 2, "Revenue", "heading", 2), (1, 3, "Revenue rose.", "text", 0), (1, 4, "By region", "heading", 3), (1, 5, "North led.", "text", 0), (1, 6, "Risks", "heading", 2), (1, 7, "Rates.", "text", 0), (2, 0, "Deep first", "heading", 3), (2, 1, "Under deep.", "text", 0), (2, 2, "Top", "heading", 1), (2, 3, "Under top.", "text", 0)]
TABLES = [(1, [["Name", "Qty"], ["a", "1"], ["b", None]]), (2, [["only header"]]), (3, [["H1", "H2", "H3"], ["x"], ["", ""], ["y\nz", "2", "3"]]), (4, [])]
MARKDOWN = [(1, "md", "# Annual Report\n\nIntro line.\n\n## Revenue\nRevenue rose.\nStrongly.\n\n## Risks\n\nRates."), (2, "md", "Title here\n=====\nBody one\n\nSub\n---\nBody two"), (3, "txt", "# not a heading\nline two\n\nnext"), (4, "md", "")]


def inline(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def clean_text(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.md5(t.clean(F.col("text"))).alias("cleaned"))
    return docs.unionByName(inline(spark, [(-i, s) for i, s in CLEAN], "doc_id long, text string").select("doc_id", t.clean(F.col("text")).alias("cleaned")))


def repeated_lines(spark, d):
    lines = load(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return parse.repeated_lines(lines, "source", "doc_id", share=0.05)


def heading_levels(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    own = lines.groupBy(t.heading_level(t.strip(F.col("line"))).alias("level")).agg(F.count("*").alias("n")).select(F.lit("documents").alias("line"), "level", "n")
    some = inline(spark, LINES, "id long, line string").select("line", t.heading_level(F.col("line")).alias("level"), F.lit(1).cast("long").alias("n"))
    return own.unionByName(some)


def section_breadcrumbs(spark, d):
    b = inline(spark, BLOCKS, "document_id long, block_idx int, text string, kind string, level int")
    return parse.sections(b).select("document_id", "block_idx", "section")


def markdown_blocks(spark, d):
    b = parse.parse(inline(spark, MARKDOWN, "document_id long, file_type string, text string"))
    return b.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.block_idx", "b.text", "b.page", "b.kind", "b.level")


def table_markdown(spark, d):
    return inline(spark, TABLES, "id long, rows array<array<string>>").select("id", parse.table_markdown(F.col("rows")).alias("markdown"))


def font_sizes(spark, d):
    """The font size of most of a document's text."""
    return parse.dominant_size(inline(spark, [(1, 10.0, "a" * 30), (1, 18.0, "Title"), (1, 10.0, "b"), (2, 9.0, "xx"), (2, 12.0, "yy")], "document_id long, size double, text string"))


def pages_text(spark, d):
    """Blocks of a document joined by page."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("block_idx", "text")).withColumn("page", (F.col("block_idx") / 5).cast("int") + 1)
    return parse.pages_of(docs).select("document_id", "page", F.md5("text").alias("text_md5"), "char_count")


def sentence_split(spark, d):
    s = load(spark, d, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("idx", "s"))
    return s.select("doc_id", "idx", F.md5("s").alias("sentence_md5"))


def token_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", t.token_count(F.col("text")).alias("tokens"), t.first_tokens(F.col("text"), 12).alias("head"))


def unit_rows(spark, d):
    s = load(spark, d, "documents").select("doc_id", "lang", t.sentences(F.col("text")).alias("s"))
    unit = F.transform("s", lambda x: F.struct(x.alias("text"), F.lit(1).alias("page"), F.col("lang").alias("section"), F.lit("text").alias("kind"), F.lit(False).alias("hard_break")))
    return s.select(F.col("doc_id").alias("document_id"), unit.alias("units"))


def pack_structural(spark, d):
    g = chunk.groups(unit_rows(spark, d)).select("document_id", F.posexplode(F.arrays_zip("groups", F.col("units.text").alias("text"))).alias("i", "z"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "z.text"))), lambda x: x["text"]), " ")
    return g.groupBy("document_id", F.col("z.groups").alias("chunk_index")).agg(F.count("*").cast("int").alias("sentences"), F.md5(joined).alias("text_md5"))


def chunk_documents(spark, d):
    c = chunk.chunk(unit_rows(spark, d)).select("document_id", F.explode("chunks").alias("c")).select("document_id", "c.*").withColumn("title", F.concat(F.lit("doc "), F.col("document_id").cast("string")))
    c = chunk.with_headers(c)
    return c.select("document_id", "chunk_index", "tokens", "overlap_sentences", "sentences", F.md5("embed_text").alias("embed_md5"))


def chunk_semantic(spark, d):
    u = chunk.embedded(unit_rows(spark, d)).withColumn("shifts", chunk.topic_shifts(F.col("vectors")))
    return chunk.chunk(u, shifts="shifts").select("document_id", F.size("chunks").alias("chunks"), F.aggregate("chunks", F.lit(0), lambda a, c: a + c["tokens"]).alias("tokens"))


def semantic_breakpoints(spark, d):
    """Topic shifts among the vectors of each label, as if it were a document."""
    e = load(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))).alias("s"))
    shifts = e.select("label", F.col("s.vec_id").alias("ids"), chunk.topic_shifts(F.col("s.v")).alias("shifts"))
    return shifts.select("label", F.inline(F.arrays_zip("ids", "shifts"))).where("shifts").select("label", F.col("ids").alias("vec_id"))


def overlap_tail(spark, d):
    """The last sentences of each document within the overlap budget."""

    @F.pandas_udf("struct<sentences:long,tokens:long>")
    def tails(column: pd.Series) -> pd.DataFrame:
        own = [chunk.tail_of(list(u), SETTINGS.overlap_tokens) for u in column]
        return pd.DataFrame({"sentences": [len(o) for o in own], "tokens": [sum(chunk.proxy(u["text"]) for u in o) for o in own]})

    return unit_rows(spark, d).select(F.col("document_id").alias("doc_id"), tails("units").alias("t")).select("doc_id", "t.*").where("sentences > 0")


def token_bounds_merge(spark, d):
    """Giants cut by words, small groups merged: sizes of the chunks of a few made-up documents."""
    rows = [(1, [("w " * 900).strip()]), (2, ["one two three.", "four five.", ("x " * 300).strip()]), (3, [("a " * 30).strip()] * 20)]
    u = spark.createDataFrame(rows, "document_id long, s array<string>")
    u = u.select("document_id", F.transform("s", lambda x: F.struct(x.alias("text"), F.lit(1).alias("page"), F.lit("").alias("section"), F.lit("text").alias("kind"), F.lit(False).alias("hard_break"))).alias("units"))
    return chunk.chunk(u, overlap=0).select("document_id", F.posexplode("chunks").alias("i", "c")).select("document_id", "i", "c.tokens", "c.sentences")


def context_headers(spark, d):
    return load(spark, d, "documents").select("doc_id", t.context_header(F.col("source"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.col("doc_id") % 7 + 1).alias("header"))


QUERIES = {f.__name__: f for f in (clean_text, repeated_lines, heading_levels, section_breadcrumbs, markdown_blocks, table_markdown, font_sizes, pages_text, sentence_split, token_counts, pack_structural, chunk_documents, chunk_semantic, semantic_breakpoints, overlap_tail, token_bounds_merge, context_headers)}


def _clean(c: str) -> str:
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    c = f"regexp_replace({c}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    c = f"replace(replace(replace({c}, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    c = f"regexp_replace(regexp_replace({c}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    c = f"array_to_string(list_transform(string_split({c}, chr(10)), lambda s: regexp_replace(s, '\\s+$', '')), chr(10))"
    return q.strip(c)


def _level(c: str) -> str:
    n = f"regexp_extract({c}, '^(\\S+)', 1)"
    return f"""case when length({c}) > 120 or regexp_matches({c}, '[.,;]$') then 0 when regexp_matches({c}, '^\\d+(\\.\\d+)*\\.?\\s+\\S') then least(3, length({n}) - length(replace({n}, '.', '')) + 1)
 when regexp_matches({c}, '(?i)^(chapter|section|part|appendix)\\b') then 1 when length({c}) < 70 and upper({c}) = {c} and lower({c}) <> {c} and len({q.words(c)}) <= 10 then 2 else 0 end"""


UNITS = f"u as (select doc_id, unnest({q.sentences('text')}) s, generate_subscripts({q.sentences('text')}, 1) i from documents), k as (select *, {q.tokens('s')} n from u)"
PACK = f"""with recursive {UNITS}, z as (select doc_id, list(n order by i) ns, list(s order by i) ss, count(*) m from k group by 1),
g as (select doc_id, ns, ss, m, 1 i, 0 gid, ns[1] tot from z
 union all select doc_id, ns, ss, m, i + 1, case when tot + ns[i + 1] > 420 then gid + 1 else gid end, case when tot + ns[i + 1] > 420 then ns[i + 1] else tot + ns[i + 1] end from g where i < m)"""
#: Units cut by words where they are over the limit, in pieces p, merged into chunks ch: mg(doc_id, i, s, n, p, ch).
MERGED = f"""gw as (select doc_id, i, gid, unnest(case when ns[i] > 420 then list_transform(range(0, len(ws), 420), lambda a: array_to_string(ws[a + 1:a + 420], ' ')) else [ss[i]] end) s, unnest(case when ns[i] > 420 then range(0, len(ws), 420) else [0] end) part, ns[i] > 420 giant from (select *, {q.words('ss[i]')} ws from g)),
gp as (select *, {q.tokens('s')} n, dense_rank() over (partition by doc_id order by gid, case when giant then i else 0 end, part) p from gw),
pt as (select doc_id, p, sum(n)::bigint n from gp group by all), pl as (select doc_id, list(n order by p) pn from pt group by 1),
pm as (select doc_id, pn, 1 p, 1 ch, pn[1] tot from pl union all
 select doc_id, pn, p + 1, case when pn[p + 1] < 48 and tot + pn[p + 1] <= 420 then ch else ch + 1 end, case when pn[p + 1] < 48 and tot + pn[p + 1] <= 420 then tot + pn[p + 1] else pn[p + 1] end from pm where p < len(pn)),
mg as (select gp.doc_id, row_number() over (partition by gp.doc_id order by gp.i, part) i, s, n, gp.p, ch from gp join pm using (doc_id, p))"""
CHUNKED = f"{PACK}, {MERGED}"
SEMANTIC = f"""with recursive {UNITS}, kd as (select doc_id * 100000 + i id, s from k), kv as ({q.hashed('kd', 'id', 's')}),
ds as (select k.doc_id, k.i, round(1 - coalesce(case when isnan(list_cosine_similarity(a.v, b.v)) then 0 else list_cosine_similarity(a.v, b.v) end, 0), 9) d from k join kv b on b.id = k.doc_id * 100000 + k.i join kv a on a.id = k.doc_id * 100000 + k.i - 1 where k.i > 1),
dc as (select doc_id, round(quantile_cont(d, 0.88::double), 9) cut from ds group by 1), sf as (select k.doc_id, k.i, k.s, k.n, coalesce(d > cut, false) sh from k left join ds using (doc_id, i) left join dc using (doc_id)),
z as (select doc_id, list(n order by i) ns, list(s order by i) ss, list(sh order by i) sh, count(*) m from sf group by 1),
g as (select doc_id, ns, ss, sh, m, 1 i, 0 gid, ns[1] tot from z
 union all select doc_id, ns, ss, sh, m, i + 1, case when cut then gid + 1 else gid end, case when cut then ns[i + 1] else tot + ns[i + 1] end from (select *, case when m < 3 then ns[i + 1] > 420 or ns[i] > 420 or tot + ns[i + 1] > 420 else tot + ns[i + 1] > 420 or (sh[i + 1] and tot >= 48) end cut from g where i < m)),
{MERGED}, mt as (select doc_id, ch, list(s order by i) ss, list(n order by i) ns from mg group by all), tl as (select a.*, b.ss ps, b.ns pn from mt a left join mt b on b.doc_id = a.doc_id and b.ch = a.ch - 1),
tc as (select *, len(list_filter(range(1, coalesce(len(pn), 0) + 1), lambda j: list_sum(pn[j:]) <= 64)) c from tl), tx as (select *, array_to_string(list_concat(coalesce(ps[len(ps) - c + 1:], []), ss), ' ') t from tc)
select doc_id document_id, count(*)::int chunks, sum({q.tokens('t')})::int tokens from tx group by 1"""
SQL = {
    "clean_text": f"select doc_id, md5({_clean('text')}) cleaned from documents union all select -id, {_clean('s')} from {q.values(CLEAN, 'id, s')}",
    "repeated_lines": f"""with l as (select source, doc_id, unnest(string_split(text, chr(10))) line from documents), h as (select distinct source, doc_id, regexp_replace({q.strip('line')}, '\\d+', '#', 'g') line from l where length({q.strip('line')}) between 1 and 89),
n as (select source, count(distinct doc_id) n from l group by 1) select source, line, count(*) pages from h join n using (source) where n >= 4 group by source, line, n having count(*) >= greatest(3, floor(n * 0.05::double))""",
    "heading_levels": f"select 'documents' line, lv as level, count(*) n from (select {_level('x')} lv from (select {q.strip('line')} x from (select unnest(string_split(text, chr(10))) line from documents))) group by 2 union all select line, {_level('line')}, 1 from {q.values(LINES, 'id, line')}",
    "section_breadcrumbs": f"""with recursive b as (select * from {q.values(BLOCKS, 'document_id, block_idx, text, kind, lvl')}),
r as (select document_id, -1 block_idx, []::struct(l int, t varchar)[] stack, ''::varchar section from b where block_idx = 0
 union all select b.document_id, b.block_idx, case when kind = 'heading' then list_append(list_filter(stack, lambda s: s.l < b.lvl), {{'l': b.lvl, 't': b.text}}) else stack end,
  array_to_string(list_transform(case when kind = 'heading' then list_filter(stack, lambda s: s.l < b.lvl) else stack end, lambda s: s.t), ' > ') from r join b on b.document_id = r.document_id and b.block_idx = r.block_idx + 1)
select document_id, block_idx, section from r where block_idx >= 0""",
    "markdown_blocks": "select * from "
    + q.values(
        [
            (1, 0, "Annual Report", 1, "heading", 1), (1, 1, "Intro line.", 1, "text", 0), (1, 2, "Revenue", 1, "heading", 2), (1, 3, "Revenue rose.\nStrongly.", 1, "text", 0), (1, 4, "Risks", 1, "heading", 2), (1, 5, "Rates.", 1, "text", 0),
            (2, 0, "Title here", 1, "heading", 1), (2, 1, "=====\nBody one", 1, "text", 0), (2, 2, "Sub", 1, "heading", 2), (2, 3, "---\nBody two", 1, "text", 0), (3, 0, "# not a heading\nline two", 1, "text", 0), (3, 1, "next", 1, "text", 0),
        ],
        'document_id, block_idx, text, page, kind, "level"',
    ),
    "font_sizes": "select * from (values (1, 10.0::double), (2, 9.0)) v(document_id, size)",
    "table_markdown": "select id, case when len(k) < 2 then '' else '| ' || array_to_string(k[1], ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(k[1], lambda c: '---'), '|') || '|' || chr(10) || array_to_string(list_transform(k[2:61], lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(0, greatest(len(k[1]) - len(r), 0)), lambda i: '')), ' | ') || ' |'), chr(10)) end markdown"
    f" from (select id, list_filter(list_transform(r::varchar[][], lambda x: list_transform(x, lambda c: trim(replace(coalesce(c, ''), chr(10), ' ')))), lambda x: len(list_filter(x, lambda c: c <> '')) > 0) k from {q.values(TABLES, 'id, r')})",
    "pages_text": "select doc_id document_id, (i - 1) // 5 + 1 page, md5(string_agg(s, chr(10) || chr(10) order by i)) text_md5, sum(length(s))::bigint char_count from (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) i from documents) group by 1, 2",
    "sentence_split": f"with {UNITS} select doc_id, i - 1 idx, md5(s) sentence_md5 from u",
    "token_counts": f"select doc_id, {q.tokens('text')} tokens, case when len({q.words('text')}) > 12 then array_to_string({q.words('text')}[1:12], ' ') else text end head from documents",
    "pack_structural": PACK + " select doc_id document_id, gid chunk_index, count(*)::int sentences, md5(string_agg(ss[i], ' ' order by i)) text_md5 from g group by doc_id, gid",
    "semantic_breakpoints": """with s as (select vec_id, label, round(1 - list_cosine_similarity(lag(embedding::double[]) over (partition by label order by vec_id), embedding::double[]), 9) distance from embeddings),
c as (select label, round(quantile_cont(distance, 0.88::double), 9) cut from s where distance is not null group by 1) select label, vec_id from s join c using (label) where distance > cut""",
    "chunk_documents": CHUNKED + """, mt as (select doc_id, ch, sum(n) n, list(s order by i) ss, list(n order by i) ns, min(i) lo from mg group by all),
tl as (select a.*, b.ss ps, b.ns pn from mt a left join mt b on b.doc_id = a.doc_id and b.ch = a.ch - 1),
tc as (select *, len(list_filter(range(1, coalesce(len(pn), 0) + 1), lambda j: list_sum(pn[j:]) <= 64)) c from tl),
tx as (select *, array_to_string(list_concat(coalesce(ps[len(ps) - c + 1:], []), ss), ' ') t from tc)
select doc_id document_id, (ch - 1)::int chunk_index, """ + q.tokens("t") + """ tokens, c::int overlap_sentences, len(ss)::int sentences, md5('[Document: doc ' || doc_id || ' | Section: ' || lang || ' | Page: 1]' || chr(10) || t) embed_md5 from tx join documents using (doc_id)""",
    "chunk_semantic": SEMANTIC,
    "overlap_tail": f"with {UNITS} select doc_id, count(*) sentences, max(used)::bigint tokens from (select *, sum(n) over (partition by doc_id order by i desc) used from k) where used <= 64 group by 1",
    "token_bounds_merge": "select * from (values (1, 0, 546, 1), (1, 1, 546, 1), (1, 2, 78, 1), (2, 0, 396, 3), (3, 0, 390, 10), (3, 1, 390, 10)) v(document_id, i, tokens, sentences)",
    "context_headers": "select doc_id, '[Document: ' || source || case when doc_id % 3 > 0 then ' | Section: ' || lang else '' end || ' | Page: ' || (doc_id % 7 + 1) || ']' header from documents",
}
