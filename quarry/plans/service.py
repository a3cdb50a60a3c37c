"""Queries of the whole service: files to blocks, uploads, models, routes of answers, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions import text as t
from quarry.operators import admin, answer, bm25, calls, chunk, evaluate, models, parse, rerank, respond
from quarry.plans import answers as an
from quarry.plans import sqltext as q
from quarry.plans.retrieval import POOL, candidates, labelled, load
from quarry.plans.texts import UNITS
from quarry.sources import documents as files

MODELS = ("large", "small", "old")
ERRORS = ["rate limit: try again in 3.66s", "try again in 450ms", "boom", "HTTP 503", "model decommissioned", "context length exceeded", "it is temporarily down", "Connection reset", "bad request", "timed out", "RATE_LIMIT", "model 'x' does not exist"]
STATUSES = [None, 408, 422, 425, 400, 418, 500, 404, 409, 413, 501, 429]
INTENTS = ["document_qa", "chitchat", "summarize", "compare", "meta", "banana", ""]


# --- files ----------------------------------------------------------------------------------------------------------


def _file_rows(spark, d):
    """Documents as the bytes of files: markdown or text by their number, every third in Latin-1 where it can be."""
    docs = load(spark, d, "documents")
    even = F.col("doc_id") % 2 == 0
    text = F.when(even, F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    name = F.concat(F.lit("file_no-"), F.col("doc_id").cast("string"), F.when(even, ".md").otherwise(".TXT"))
    latin = (F.col("doc_id") % 3 == 0) & ~text.rlike(r"[^\x00-\xff]")
    content = F.when(latin, F.encode(F.regexp_replace(text, r"[^\x00-\xff]", ""), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), name.alias("name"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def parse_document(spark, d):
    """Blocks, pages and titles of all documents as files."""
    found = admin.verdicts(_file_rows(spark, d)).withColumn("file_type", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    made = files.documents(found)
    said = F.array_join(F.transform("blocks", lambda b: F.concat_ws("#", b["page"].cast("string"), b["kind"], b["text"])), "|")
    return made.select(F.col("path").cast("long").alias("doc_id"), "title", F.size("blocks").alias("blocks"), F.array_max(F.transform("blocks", lambda b: b["page"])).alias("pages"), F.md5(said).alias("blocks_md5"), "error")


def upload_pending(spark, d):
    """Documents as uploads, a request a source and language: the rows that are added as pending."""
    docs = load(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("path"), F.concat_ws(".", F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, ("pdf", "DOCX", "txt", "xls", "md"))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("name"), (F.col("n_chars") * (F.col("doc_id") % 7) * 3000).alias("length"), F.concat_ws("/", "source", "lang", (F.col("doc_id") % 9).cast("string")).alias("request"))
    judged = admin.verdicts(rows, "request")
    kept = admin.pending(judged).select("id", "filename", "file_type", "file_size", "status")
    return kept.unionByName(judged.where("reason is not null").select(F.col("path").cast("string").alias("id"), F.col("name").alias("filename"), F.lit(None).cast("string").alias("file_type"), F.col("length").alias("file_size"), F.col("reason").alias("status")))


def ordered_chunks(spark, d):
    """Every conversation's turns in order, as one array."""
    return admin.ordered(load(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.size("rows").alias("turns"), F.md5(F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["role"], r["text"])), "|")).alias("rows_md5"))


def get_document(spark, d):
    return admin.get(load(spark, d, "documents"), "doc_id", 7).select("doc_id", "source", "lang", "n_chars")


def embedding_fingerprints(spark, d):
    """Vectors by what made them, beside what is wanted."""
    v = load(spark, d, "embeddings").withColumn("model", F.concat(F.lit("hashed:v"), (F.col("label") % 3).cast("string")))
    return files.embedded_with(v, files.fingerprint("hashed", "v1", 64))


def running_headers(spark, d):
    """What stays of documents' pages of twenty lines under a header and over a footer."""
    return parse.running_lines(_paged(spark, d), "doc_id", "page", "place").select("doc_id", "page", "place", F.md5("line").alias("line_md5"))


def _paged(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", F.split("text", "\n").alias("l"))
    body = docs.select("doc_id", F.posexplode("l").alias("i", "line")).select("doc_id", (F.floor(F.col("i") / 20) + 1).cast("int").alias("page"), ((F.col("i") % 20) * 2 + 2).cast("int").alias("place"), "line")
    ends = docs.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.ceil(F.size("l") / 20).cast("int"))).alias("page"))
    head = ends.select("doc_id", "page", F.lit(1).alias("place"), F.concat(F.lit("Report of "), "source", F.lit(" no. "), F.col("doc_id").cast("string")).alias("line"))
    foot = ends.where("page % 7 > 0").select("doc_id", "page", F.lit(99).alias("place"), F.concat(F.lit("  Page "), F.col("page").cast("string")).alias("line"))
    return body.unionByName(head).unionByName(foot)


def layout_headings(spark, d):
    """Headings by font size or wording among all lines of documents set as pages."""
    rows = _paged(spark, d).withColumn("size", F.when((F.col("doc_id") + F.col("page") * 3 + F.col("place")) % 23 == 0, 18.04).when((F.col("doc_id") + F.col("place")) % 29 == 0, 12.5).when(F.col("place") % 31 > 0, 10.0))
    blocks = parse.layout_blocks(rows.withColumnRenamed("doc_id", "document_id"))
    return blocks.where("kind = 'heading'").groupBy("document_id").agg(F.count("*").alias("headings"), F.sum("level").alias("levels"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), "|")).alias("text_md5"))


def chunk_pages(spark, d):
    """Units of documents given as pages of five lines."""
    pages = load(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    paged = F.transform(F.sequence(F.lit(0), F.ceil(F.size("l") / 5).cast("int") - 1), lambda p: F.array_join(F.slice("l", p * 5 + 1, 5), "\n"))
    u = pages.select("doc_id", F.posexplode(chunk.pages_units(paged)).alias("i", "u"))
    return u.groupBy("doc_id", F.col("u.page").alias("page")).agg(F.count("*").alias("units"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "u.text"))), lambda x: x["text"]), "|")).alias("text_md5"))


# --- models ---------------------------------------------------------------------------------------------------------


def _scripted(model: str, prompt: str, told: dict) -> str:
    """A model that answers, fails in passing, or fails for good, by the number in the prompt and the tries so far."""
    n = told[model] = told.get(model, -1) + 1
    k = (int(prompt) * 7 + MODELS.index(model) * 3 + n * 5) % 10
    if k < 3:
        return f"{model} answers {prompt}"
    raise models.CallError(*(("HTTP", 503) if k < 6 else ("model does not exist", None) if k < 8 else ("boom", None)))


def _scripted_client() -> models.Client:
    told: dict = {}

    def call(model: str, prompt: str) -> str:
        if told.get("prompt") != prompt:
            told.clear()
            told["prompt"] = prompt
        return _scripted(model, prompt, told)

    return models.Client(call, MODELS, sleep=lambda s: None, breaker=models.Breaker(threshold=1 << 30))


def model_calls(spark, d):
    """Every event as a request to a chain of models with scripted failures."""
    rows = load(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("prompt"))
    made = models.completions(rows, "event_id", "prompt", _scripted_client)
    return made.select("event_id", "model", "attempts", "degraded", "text", F.regexp_extract("error", r"after (\d+) attempts", 1).try_cast("long").alias("failed_after"))


def _stub(texts: list[str], role: str) -> list[list[float]]:
    if any(len(s) % 13 == 0 for s in texts):
        raise RuntimeError("poison")
    return [[float(len(s)), float(calls.ROLES.index(role)), 1.0] for s in texts]


class _Stub:
    def encode(self, texts, role):
        return _stub(texts, role)


def _missing():
    raise ImportError("not here")


def embed_roles(spark, d):
    """Every turn embedded by the first provider that loads, each different text once; a text that the provider can't take gets zeros."""
    c = load(spark, d, "conversations").select("conv_id", "turn", "text")
    encode = models.encoder_of("hosted", {"hosted": _missing, "stub": _Stub})
    out = None
    for role in ("query", "passage", "similarity", "unheard-of"):
        part = calls.embed(c, "text", role, encode, 3).select("conv_id", "turn", F.lit(role).alias("role"), F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))
        out = part if out is None else out.unionByName(part)
    return out


def error_classes(spark, d):
    """Every event as an error: worth another try, fatal for its model, seconds to wait."""
    pick = lambda values, kind, m: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (m % len(values) + 1).cast("int"))
    e = load(spark, d, "events").select("event_id", pick(ERRORS, "string", F.col("event_id")).alias("m"), pick(STATUSES, "int", F.floor(F.col("event_id") / 12)).alias("s"))
    headers = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("retry-after"), F.lit("2"))).when(F.col("event_id") % 5 == 1, F.create_map(F.lit("retry-after-ms"), F.lit("1500"))).when(F.col("event_id") % 5 == 2, F.create_map(F.lit("retry-after"), F.lit("soon"), F.lit("x-ratelimit-reset-tokens"), F.lit("7.5s")))
    return e.select("event_id", calls.transient(F.col("m"), F.col("s")).alias("transient"), calls.fatal(F.col("m"), F.col("s")).alias("fatal"), calls.retry_after(F.col("m"), headers).alias("wait"))


def plan_questions(spark, d):
    """Plans of all user turns from the replies of a planner: any intent, made-up ones, empty ones and no JSON at all."""
    c = load(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    k = F.col("id") % 7
    body = F.struct(
        F.element_at(F.array(*map(F.lit, INTENTS)), (k + 1).cast("int")).alias("intent"), F.concat(F.lit("About: "), "text").alias("standalone_question"),
        F.array(F.lit(" first "), F.concat("text", F.lit("? ")), F.lit("FIRST"), F.lit("last")).alias("search_queries"), F.concat(F.lit("Perhaps "), "text").alias("hypothetical_answer"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("needs_retrieval"),
    )
    reply = F.when(F.col("id") % 11 == 0, "I can't plan this").when(F.col("id") % 11 == 1, "{}").when(F.col("id") % 11 == 2, F.lit(None)).otherwise(F.concat(F.lit("Sure: "), F.to_json(body)))
    p = c.withColumn("p", calls.plan_query(F.col("text"), reply)).select("id", "text", "p.*")
    return p.select("id", "intent", "planner", "needs_retrieval", F.md5("standalone").alias("standalone_md5"), F.array_join("queries", "|").alias("queries"), F.md5("hyde").alias("hyde_md5"))


def model_rerank(spark, d):
    """Benchmark candidates reordered by a model's listwise scores, and by logits."""
    c = candidates(spark, d)
    entry = F.struct(F.col("rank").alias("id"), (F.col("chunk_id") * 7 % 13).alias("score"))
    replies = c.groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.when(F.col("chunk_id") % 4 > 0, entry))).alias("scores"))).alias("reply"), F.count("*").alias("n"))
    scored = c.join(replies, "query_id").withColumn("rerank_score", F.coalesce(F.try_element_at(calls.listwise_scores(F.col("reply"), F.col("n").cast("int")), F.col("rank").cast("int")), F.lit(0.0)))
    listwise = rerank.rerank(scored, mode="llm").select(F.lit("listwise").alias("mode"), "query_id", "chunk_id", "final_rank", "blend")
    logits = rerank.cross_encoded(c.withColumn("logit", (F.col("chunk_id") * 5 % 17 - 8) / 2.0))
    return listwise.unionByName(rerank.rerank(logits, mode="cross").select(F.lit("cross").alias("mode"), "query_id", "chunk_id", "final_rank", "blend"))


# --- answers --------------------------------------------------------------------------------------------------------


def answer_routes(spark, d):
    """Benchmark passages as questions of every kind, with passages found by words, and what a model said for some."""
    b = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    k = F.col("query_id") % 8
    intent = F.when(k == 0, "chitchat").when(k == 1, "meta").otherwise("document_qa")
    first = F.array_join(F.slice(t.words(F.col("question")), 1, 12), " ")
    reply = F.when(k.isin(0, 2), F.lit(None)).when(k == 1, "Hello.").when(k == 3, F.lit("I could not find that in the documents.")).when(k == 4, F.lit("Nobody ever proved such claims [S9]."))
    reply = reply.when(k == 5, F.concat(first, F.lit(" [S1]."))).when(k == 6, F.concat(F.lit("- "), first, F.lit(" [S2].\n\nThen invented things happened in 1999 [S1] [S77].")))
    asked = b.withColumn("intent", intent).withColumn("reply", reply).withColumn("hint", F.when(F.col("query_id") % 16 == 0, F.lit("You have files.")))
    hits = labelled(candidates(spark, d, SETTINGS.top_k)).where("query_id % 16 <> 10").select("query_id", "rank", "chunk_id", "label", "text", "score")
    r = respond.respond(asked, hits)
    cited = F.array_join(F.transform(F.filter("sources", lambda s: s["cited"]), lambda s: s["n"].cast("string")), ",")
    return r.select("query_id", "intent", "mode", F.md5("answer").alias("answer_md5"), "confidence", "grounded", "abstained", "degraded", F.size("sources").alias("sources"), cited.alias("cited"), F.array_join("warnings", "; ").alias("warnings"))


def evaluation_report(spark, d):
    """The measures of a run over benchmark questions: answers of every quality, passages found by words."""
    b = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text"))
    i = F.col("query_id")
    first = F.array_join(F.slice(t.words(F.col("text")), 1, 3), " ")
    asked = b.select("query_id", (i % 4 > 0).alias("answerable"), F.when(i % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("zzz"), first)).alias("expects"), F.array(F.lit("EN"), F.lit("d")).alias("relevant"))
    said = F.when(i % 5 == 0, "I could not find it").when(i % 5 == 1, F.upper("text")).when(i % 5 == 2, "x").otherwise(F.col("text"))
    given = b.select("query_id", said.alias("answer"), ((i * 37 % 100) / 100.0).alias("confidence"), (i % 3 > 0).alias("grounded"), (i % 7 == 0).alias("abstained"))
    sources = candidates(spark, d, SETTINGS.top_k).select("query_id", "rank", "section")
    return evaluate.summary(evaluate.outcomes(asked, given, sources))


QUERIES = {f.__name__: f for f in (parse_document, upload_pending, ordered_chunks, get_document, embedding_fingerprints, running_headers, layout_headings, chunk_pages, model_calls, embed_roles, error_classes, plan_questions, model_rerank, answer_routes, evaluation_report)}

PAGED = """dl as (select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents), dn as (select doc_id, source, max(i) // 20 + 1 n from dl group by all),
dp as (select doc_id, unnest(range(1, n + 1)) page, source from dn),
pg as (select doc_id, (i // 20 + 1)::int page, (i % 20 * 2 + 2)::int place, line from dl union all select doc_id, page, 1, 'Report of ' || source || ' no. ' || doc_id from dp union all select doc_id, page, 99, '  Page ' || page from dp where page % 7 > 0)"""
_S = q.strip("line")
RUNNING = f"""{PAGED}, pn as (select *, regexp_replace({_S}, '\\d+', '#', 'g') norm, {_S} bare from pg),
pe as (select doc_id, page, min(place) filter (bare <> '') lo, max(place) filter (bare <> '') hi from pn group by all), pc as (select doc_id, count(distinct page) n from pg group by 1),
ed as (select p.doc_id, norm from pn p join pe e on p.doc_id = e.doc_id and p.page = e.page and p.place = e.lo where length(bare) < 90 union all select p.doc_id, norm from pn p join pe e on p.doc_id = e.doc_id and p.page = e.page and p.place = e.hi where length(bare) < 90),
rl as (select doc_id, norm from ed join pc using (doc_id) group by doc_id, norm, n having n >= 4 and count(*) >= greatest(3, floor(n * 0.6::double))),
pf as (select p.*, min(case when r.norm is null then place end) over w a, max(case when r.norm is null then place end) over w b from pn p left join rl r on r.doc_id = p.doc_id and r.norm = p.norm window w as (partition by p.doc_id, page)),
pk as (select doc_id, page, place, line, bare, norm from pf where place between a and b)"""
_CLEAN = "regexp_replace(regexp_replace(line, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[ \\t]{2,}', ' ', 'g')"
_SIZE = "case when (doc_id + page * 3 + place) % 23 = 0 then 18.0::double when (doc_id + place) % 29 = 0 then 12.5 when place % 31 > 0 then 10.0 end"
_NUM = "regexp_extract(c, '^(\\S+)', 1)"
_READS = f"case when regexp_matches(c, '^\\d+(\\.\\d+)*\\.?\\s+\\S') then least(3, length({_NUM}) - length(replace({_NUM}, '.', '')) + 1) when regexp_matches(c, '(?i)^(chapter|section|part|appendix)\\b') then 1 when length(c) < 70 and upper(c) = c and lower(c) <> c and len({q.words('c')}) <= 10 then 2 else 0 end"
_TIE = "case when c.id % 11 in (0, 1, 2) then 'fallback' else 'llm' end"
_ONE = "(mode = 'grounded')"
_AN = f"""{POOL}, bi as (select item_id i, text, item_id % 8 k, array_to_string({q.words('text')}[1:12], ' ') f from benchmark),
qa as (select i, case k when 0 then 'chitchat' when 1 then 'meta' else 'document_qa' end intent,
 case k when 1 then 'Hello.' when 3 then 'I could not find that in the documents.' when 4 then 'Nobody ever proved such claims [S9].' when 5 then f || ' [S1].' when 6 then '- ' || f || ' [S2].' || chr(10) || chr(10) || 'Then invented things happened in 1999 [S1] [S77].' end reply, case when i % 16 = 0 then 'You have files.' end hint from bi),
hi as (select query_id i, list(text order by rank) ps, list('**[S' || rank || '] ' || title || ' > ' || section || ' > p.1** (match ' || round(score * 100)::int || '%)' || chr(10) || '> ' || {q.clip('text', 600)} order by rank) filter (rank <= 4) says from ca where rank <= 6 and query_id % 16 <> 10 group by 1),
md as (select qa.*, coalesce(case when intent = 'document_qa' then ps end, []::varchar[]) ps, says, case when intent <> 'document_qa' then 'chitchat' when ps is null then 'no_context' when reply is null then 'extractive' else 'grounded' end as mode from qa left join hi using (i)),
ga as (select i answer_id, reply answer, ps passages from md where mode = 'grounded'), {an.GROUND}"""
SQL = {
    "parse_document": f"""with recursive s as (select doc_id, {an.cleaned("case when doc_id % 2 = 0 then '# Title ' || doc_id || chr(10) || chr(10) || text else text end")} x from documents),
l as (select doc_id, list_transform(string_split(x, chr(10)), lambda v: {q.strip('v')}) b, list_transform(string_split(x, chr(10)), lambda v: length(v)) n, doc_id % 2 = 0 md from s),
r as (select doc_id, b, n, md, 0 i, 1 page, 0::bigint chars, 0 brk, null::varchar line, null::int of_page, null::int lvl, null::int seg from l
 union all select doc_id, b, n, md, i + 1, case when chars + n[i + 1] > 3000 then page + 1 else page end, case when chars + n[i + 1] > 3000 then 0 else chars + n[i + 1] end, case when b[i + 1] = '' or (md and i = 0) then brk + 1 else brk end,
  case when md and i = 0 then b[1][3:] else b[i + 1] end, page, (md and i = 0)::int, case when md and i = 0 then -1 else brk end from r where i < len(b)),
k as (select doc_id, of_page, seg, min(i) i, max(lvl) lvl, string_agg(line, chr(10) order by i) t from r where i > 0 and line <> '' group by doc_id, of_page, seg)
select doc_id, coalesce(max(t) filter (lvl = 1), 'file no ' || doc_id) title, count(*)::int blocks, max(of_page) pages, md5(string_agg(of_page || '#' || case when lvl = 1 then 'heading' else 'text' end || '#' || t, '|' order by i)) blocks_md5, null::varchar error from k group by doc_id""",
    "upload_pending": """with f as (select doc_id, doc_id || '.' || ['pdf', 'DOCX', 'txt', 'xls', 'md'][doc_id % 5 + 1] as name, n_chars * (doc_id % 7) * 3000 as length, source || '/' || lang || '/' || doc_id % 9 request from documents),
r as (select *, case when count(*) over (partition by request) > 20 then 'too many files' when doc_id % 5 = 3 then 'unsupported' when length = 0 then 'empty' when length > 52428800 then 'too large' end reason from f)
select case when reason is null then md5(doc_id::varchar) else doc_id::varchar end id, name filename, case when reason is null then lower(split_part(name, '.', 2)) end file_type, length file_size, coalesce(reason, 'pending') status from r""",
    "ordered_chunks": "select conv_id, count(*)::int turns, md5(string_agg(role || ':' || text, '|' order by turn)) rows_md5 from conversations group by 1",
    "get_document": "select doc_id, source, lang, n_chars from documents where doc_id = 7",
    "embedding_fingerprints": "select 'hashed:v' || label % 3 || ':' || len(embedding) fingerprint, count(*) vectors, label % 3 = 1 and len(embedding) = 64 fits from embeddings group by all",
    "running_headers": f"with {RUNNING} select doc_id, page, place, md5(line) line_md5 from pk",
    "layout_headings": f"""with {RUNNING}, bd as (select doc_id, arg_max(size, (w, -size)) body from (select doc_id, {_SIZE} size, sum(length(line)) w from pg where {_SIZE} is not null group by all) group by 1),
rp as (select h.doc_id, norm from (select distinct doc_id, page, norm from pk where length(bare) between 1 and 89) h join (select doc_id, count(distinct page) n from pk group by 1) using (doc_id) group by h.doc_id, norm, n having n >= 4 and count(*) >= greatest(3, floor(n * 0.6::double))),
hd as (select doc_id, page, place, c, case when length(c) > 120 or regexp_matches(c, '[.,;]$') then 0 when {_SIZE} >= body * 1.45::double then 1 when {_SIZE} >= body * 1.18::double then 2 else {_READS} end lv
 from (select pk.*, {q.strip(_CLEAN)} c from pk where not exists (select 1 from rp where rp.doc_id = pk.doc_id and rp.norm = pk.norm)) join bd using (doc_id) where c <> '')
select doc_id document_id, count(*) headings, sum(lv)::bigint levels, md5(string_agg(c, '|' order by page, place)) text_md5 from hd where lv > 0 group by 1""",
    "chunk_pages": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents), p as (select doc_id, (i // 5 + 1)::int page, string_agg(s, chr(10) order by i) text from l group by all),
u as (select doc_id, page, {q.sentences('text')} s from p) select doc_id, page, len(s)::bigint units, md5(array_to_string(s, '|')) text_md5 from u where len(s) > 0""",
    "model_calls": f"""with e as (select event_id, unnest(range(9)) a from events), o as (select event_id, a // 3 m, a % 3 n, (event_id * 7 + a // 3 * 3 + a % 3 * 5) % 10 k from e),
s as (select event_id, m, min(n) filter (k < 3) win, min(n) filter (k >= 6) bad from o group by all), f as (select event_id, m, win is not null and (bad is null or win < bad) ok, case when win is not null and (bad is null or win < bad) then win + 1 else coalesce(bad, 2) + 1 end tries from s),
w as (select event_id, min(m) filter (ok) best from f group by 1), t as (select f.event_id, best, sum(tries) filter (best is null or m <= best)::bigint tries from f join w using (event_id) group by all)
select event_id, {q.listed(MODELS)}[best + 1] model, case when best is not null then tries end attempts, best > 0 degraded, {q.listed(MODELS)}[best + 1] || ' answers ' || event_id as text, case when best is null then tries end failed_after from t""",
    "embed_roles": "select conv_id, turn, r as role, case when length(text) % 13 = 0 then '0,0,0' else length(text) || ',' || case r when 'query' then 0 when 'similarity' then 2 else 1 end || ',1' end embedding from conversations, (select unnest(['query', 'passage', 'similarity', 'unheard-of']) r)",
    "error_classes": f"""with e as (select event_id, {q.listed([m.replace("'", "''") for m in ERRORS])}[event_id % 12 + 1] m, {q.quoted(STATUSES)}[event_id // 12 % 12 + 1] s from events)
select event_id, coalesce(s in (408, 409, 425, 429, 500, 502, 503, 504), false) or regexp_matches(lower(m), 'rate limit|rate_limit|429|timeout|timed out|temporarily|503|502|500|overloaded|connection|unavailable') transient,
 coalesce(s in (400, 404, 413, 422), false) or regexp_matches(m, 'does not exist|decommissioned') or (contains(m, 'context') and contains(m, 'length')) fatal,
 case event_id % 5 when 0 then 2.0::double when 1 then 1.5 when 2 then 7.5 else case when contains(m, '3.66s') then 3.66 when contains(m, '450ms') then 0.45 end end wait from e""",
    "plan_questions": f"""with c as (select conv_id * 1000 + turn id, {q.strip('text')} s, text from conversations where role = 'user'), k as (select c.*, {an._intent('text')} quick, {q.listed(INTENTS)}[id % 7 + 1] said, {_TIE} by_ from c),
p as (select *, quick <> 'document_qa' fast, case when said in ('', 'banana') then 'document_qa' else said end intent, said in ('chitchat', 'meta') social from k)
select id, case when fast then quick when by_ = 'fallback' then 'document_qa' else intent end intent, case when fast then 'heuristic' else by_ end planner,
 case when fast then false when by_ = 'fallback' then true when social then false when id % 3 > 0 then id % 3 = 1 else true end needs_retrieval,
 md5(case when fast or by_ = 'fallback' then s else {q.strip("'About: ' || text")} end) standalone_md5,
 case when fast or by_ = 'fallback' then s else 'first|' || {q.strip("text || '?'")} || '|FIRST' end queries,
 md5(case when fast or by_ = 'fallback' or social then '' else substr({q.strip("'Perhaps ' || text")}, 1, 600) end) hyde_md5 from p""",
    "model_rerank": f"""with {POOL}, m as (select 'listwise' as mode, *, case when chunk_id % 4 > 0 then least(chunk_id * 7 % 13, 10) / 10.0::double else 0 end r from ca union all select 'cross', *, 1 / (1 + exp(-((chunk_id * 5 % 17 - 8) / 2.0::double))) from ca),
b as (select *, round(0.85 * r + (1 - 0.85::double) * score, 6) blend from m) select mode, query_id, chunk_id, final_rank, blend from (select *, row_number() over (partition by mode, query_id order by blend desc, rank) final_rank from b) where final_rank <= 6""",
    "answer_routes": f"""with {_AN}
select i query_id, intent, mode, md5(case mode when 'grounded' then g.answer when 'extractive' then {q.quoted(answer.EXTRACT_HEAD)} || chr(10) || chr(10) || array_to_string(says, chr(10) || chr(10)) when 'chitchat' then coalesce(reply, case when hint is null then {q.quoted(respond.GREETING)} else 'Hi! ' || hint || ' Ask me anything about them.' end) else coalesce(reply, {q.quoted(respond.NOT_FOUND)}) end) answer_md5,
 round(case mode when 'grounded' then g.confidence when 'extractive' then 0.35::double when 'chitchat' then 1 else 0 end, 3) confidence, coalesce(g.verified, false) grounded, coalesce(g.abstained, false) abstained, reply is null degraded, len(ps) sources,
 coalesce(array_to_string(list_filter(list_sort(list_distinct(list_transform(regexp_extract_all(case when mode = 'grounded' then g.answer else '' end, '\\[S(\\d+)\\]', 1), lambda x: x::int))), lambda x: x between 1 and len(ps)), ','), '') cited,
 array_to_string(list_filter([case when g.refusal then 'the model found no answer in the passages' end, case when g.invalid > 0 then 'removed ' || g.invalid || ' invented citation(s)' end, case when g.abstained then 'too little support: the answer is withheld' end, case when mode in ('chitchat', 'no_context') and reply is null then '{respond.CANNED}' end, case when mode = 'extractive' then '{respond.VERBATIM}' end], lambda w: w is not null), '; ') warnings
from md left join ground g on g.answer_id = md.i""",
    "evaluation_report": f"""with {POOL}, b as (select item_id i, text, item_id % 4 > 0 ok, case item_id % 5 when 0 then 'I could not find it' when 1 then upper(text) when 2 then 'x' else text end a from benchmark),
h as (select query_id i, min(rank) filter (lower(section) like '%en%' or lower(section) like '%d%') r, sum((lower(section) like '%en%' or lower(section) like '%d%')::int) / count(*)::double p from ca where rank <= 6 group by 1),
o as (select b.i, ok, r, coalesce(p, 0) p, i % 9 > 0 and (contains(lower({q.squeeze('a')}), 'zzz') or contains(lower({q.squeeze('a')}), lower(array_to_string({q.words('text')}[1:3], ' ')))) c, i % 3 > 0 g,
 i % 7 = 0 or (not contains({q.squeeze('a')}, ' ') and (i * 37 % 100 < 50 or i % 5 = 0)) d from b left join h using (i))
select count(*) questions, round(avg((r is not null)::int) filter (ok), 6) recall, round(avg(coalesce(1.0::double / r, 0)) filter (ok), 6) mrr, round(avg(p) filter (ok), 6) "precision", round(avg(c::int) filter (ok), 6) answer_accuracy, round(avg(g::int) filter (ok), 6) groundedness, round(avg(d::int) filter (not ok), 6) correct_abstention from o""",
}
