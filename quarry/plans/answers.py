"""Queries of citations, claims, verification, planning and calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions import text as t
from quarry.functions.vectors import cosine
from quarry.operators import calls, evaluate, ground, planning
from quarry.plans import sqltext as q
from quarry.plans.retrieval import POOL, candidates, load
from quarry.plans.texts import inline

CITED = [(1, "Revenue rose【S1】."), (2, "It grew (S2)."), (3, "Both [S1, S2] say so."), (4, "See [Source 5] here."), (5, "In (2024) it fell."), (6, "Revenue was $48.2M. [S1]"), (7, "Real [S1] and fake [S9]."), (8, "A [S1] B [S2]."), (9, "Joined[S3] words  twice."), (10, "No marks."), (11, "Order [S4][S2] [S4].")]
REPLIES = [(1, "I could not find that in the documents."), (2, "Revenue was $48.2M [S1]."), (3, "The policy allows remote work."), (4, "The context does not mention any budget."), (5, "No dates are available."), (6, "")]
ANSWERS = [
    (1, "Q3 revenue was $48.2 million [S1]. Margin was 74.9% [S2].", ["Q3 revenue was $48.2 million, up 14.6 percent.", "Gross margin was 74.9% in the quarter."]),
    (2, "The CEO resigned in March after a scandal.", ["Q3 revenue was $48.2 million, up 14.6 percent."]),
    (3, "Revenue was $91.7 million [S1]. Fake claim here [S9].", ["Q3 revenue was $48.2 million, up 14.6 percent."]),
    (4, "I could not find the answer in the documents.", ["Anything."]), (5, "Yes. No.", ["Anything at all."]), (6, "Something said.", []),
]
QUESTIONS = [(1, "hey there!"), (2, "I am Dhanu"), (3, "thanks!"), (4, "what documents do I have?"), (5, "What was revenue in the third quarter?"), (6, "and when is it due?"), (7, "what about the second one?"), (8, "What is the remote work policy?"), (9, ""), (10, "hello everyone"), (11, "how many files are uploaded here")]
PLANS = [(1, "and when is it due?", "when is the report due?", ["report due date", "REPORT due date"], "llm"), (2, "what about expenses?", "expense policy under STD-441", ["expenses", "travel expenses"], "llm"), (3, "What is X policy?", "What is X policy?", ["x policy", "policy x", "a b", "c d", "e f", "g h"], "fallback")]
JSONS = [(1, '{"a": 1}'), (2, 'text ```json\n{"b": [1, 2]}\n``` tail'), (3, 'Sure: {"c": "x"} done'), (4, "garbage"), (5, ""), (6, "[1, 2]"), (7, '{"broken": ')]
ERRORS = [(1, "rate limit: try again in 3.66s"), (2, "try again in 450ms"), (3, "boom"), (4, "HTTP 503 unavailable"), (5, "bad request")]
EXPECT = [(1, "The total is  $48.2 Million.", ["48.2 million"]), (2, "No such thing", ["yes", "maybe"]), (3, "Green and blue", ["green", "red"]), (4, "I could not find it", ["x"])]


def parse_citations(spark, d):
    return inline(spark, CITED, "id long, s string").select("id", F.array_join(t.citations(t.normal_citations(F.col("s"))).cast("array<string>"), ",").alias("numbers"))


def normalize_citations(spark, d):
    return inline(spark, CITED, "id long, s string").select("id", t.normal_citations(F.col("s")).alias("s"))


def strip_invalid(spark, d):
    return inline(spark, CITED, "id long, s string").select("id", t.strip_invalid(F.col("s"), F.lit(2)).alias("s"))


def split_claims(spark, d):
    c = load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(t.claims(F.col("text"))).alias("idx", "c"))
    return c.select("conv_id", "turn", "idx", F.md5("c").alias("claim_md5"))


def refusal_detection(spark, d):
    own = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), t.refusal(F.col("text")).alias("refusal"))
    return own.unionByName(inline(spark, REPLIES, "id long, s string").select((-F.col("id")).alias("id"), t.refusal(F.col("s")).alias("refusal")))


def lexical_support(spark, d):
    """Each benchmark passage against the documents that share most of its words."""
    c = candidates(spark, d, SETTINGS.top_k)
    return c.select("query_id", "chunk_id", F.round(t.lexical_support(F.col("question"), F.col("text")), 6).alias("support"))


def semantic_support(spark, d):
    """The likest vector of the same label for every vector whose id is divisible by 100."""
    e = load(spark, d, "embeddings")
    c = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("claim"), "label", F.col("embedding").alias("a"))
    near = e.select("vec_id", "label", "embedding").join(c, "label").where("vec_id <> claim")
    return near.groupBy("claim").agg(F.round(F.max(cosine(F.col("a"), F.col("embedding"))), 5).alias("support"))


def grounding_confidence(spark, d):
    """Confidence of answers with three checked claims each, a made-up one for every document."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("claim_idx"))
    s = F.pmod(F.col("answer_id") * 7 + F.col("claim_idx") * 13, F.lit(100)) / 100.0
    rows = docs.withColumn("semantic", s).withColumn("lexical", 1 - s / 2).withColumn("citations", F.when(F.col("claim_idx") == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))))
    f = ground.confidence(ground.judged(rows))
    return f.select("answer_id", "claims", "uncited_claims", F.round("support_ratio", 5).alias("support_ratio"), "confidence", "verified")


def ground_answers(spark, d):
    """A few made-up answers, and every assistant turn as an answer from the turns before it in its conversation (at most six)."""
    c = load(spark, d, "conversations").where("role <> 'system'")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    own = c.withColumn("passages", F.collect_list("text").over(before)).where("role = 'assistant'")
    cite = F.when(F.col("turn") % 3 == 0, " [S1]").when(F.col("turn") % 3 == 1, " [S1] [S8]").otherwise("")
    own = own.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", cite).alias("answer"), "passages")
    made = inline(spark, ANSWERS, "answer_id long, answer string, passages array<string>").withColumn("answer_id", -F.col("answer_id"))
    a = ground.ground(own.unionByName(made))
    return a.select("answer_id", "method", "verified", "abstained", "confidence", F.size("invalid").alias("invalid"), F.md5("answer").alias("answer_md5"))


def intent_routing(spark, d):
    own = load(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), t.intent(F.col("text")).alias("intent"))
    return own.unionByName(inline(spark, QUESTIONS, "id long, s string").select((-F.col("id")).alias("id"), t.intent(F.col("s")).alias("intent")))


def needs_history(spark, d):
    own = load(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), t.needs_history(F.col("text")).alias("needed"))
    return own.unionByName(inline(spark, QUESTIONS, "id long, s string").select((-F.col("id")).alias("id"), t.needs_history(F.col("s")).alias("needed")))


def retrieval_queries(spark, d):
    p = inline(spark, PLANS, "id long, original string, standalone string, searches array<string>, planner string")
    p = p.withColumn("resolved", planning.resolved(F.col("original"), F.col("standalone"), F.col("planner")))
    return p.select("id", "resolved", F.array_join(planning.extra_queries(F.col("original"), F.col("standalone"), F.col("searches"), F.col("resolved")), "|").alias("extras"))


def history_window(spark, d):
    return planning.history(load(spark, d, "conversations").where("role <> 'system'"))


def json_extract(spark, d):
    e = load(spark, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"))
    own = e.groupBy("valid").agg(F.count("*").alias("n")).select(F.concat(F.lit("events "), F.col("valid").cast("string")).alias("k"), F.col("n").cast("string").alias("v"))
    return own.unionByName(inline(spark, JSONS, "id long, s string").select(F.col("id").cast("string").alias("k"), F.regexp_replace(t.found_json(F.col("s")), r"\s", "").alias("v")))


def breaker_states(spark, d):
    e = load(spark, d, "events").withColumn("failed", F.pmod(F.col("event_id") * 7, F.lit(10)) < 7).withColumn("seconds", F.col("event_id") * 3.0)
    return calls.breaker(e.withColumn("key", F.col("user_id") % 20), "key", "event_id", "failed", "seconds")


def error_hints(spark, d):
    return inline(spark, ERRORS, "id long, s string").select("id", calls.transient(F.col("s")).alias("transient"), calls.retry_after(F.col("s")).alias("wait"))


def answer_accuracy(spark, d):
    r = inline(spark, EXPECT, "id long, answer string, needles array<string>")
    return r.select("id", evaluate.expected(F.col("answer"), F.col("needles")).alias("any"), evaluate.expected(F.col("answer"), F.col("needles"), every=True).alias("all"), evaluate.declined(F.col("answer")).alias("declined"))


def latency_quantiles(spark, d):
    return evaluate.nearest_rank(load(spark, d, "events"), "value", ["event_type"])


QUERIES = {f.__name__: f for f in (parse_citations, normalize_citations, strip_invalid, split_claims, refusal_detection, lexical_support, semantic_support, grounding_confidence, ground_answers, intent_routing, needs_history, retrieval_queries, history_window, json_extract, breaker_states, error_hints, answer_accuracy, latency_quantiles)}

CONV = "(select conv_id * 1000 + turn id, text s, role from conversations)"
REFUSES = "regexp_matches({s}, '(?i)\\b(could\\s*n[o'']?t|cannot|can\\s*not|do(?:es)?\\s*n[o'']?t|no|not)\\b[^.]{{0,60}}?\\b(find|found|contain|mention|state|specify|include|appear|available|provided)\\b')"


def _refusal(c: str) -> str:
    s = q.strip(c)
    return f"({s} <> '' and length({s}) < 700 and not regexp_matches({s}, '\\[S\\d+\\]') and {REFUSES.format(s=s)})"


def _matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q.quoted(pattern)})"


def _intent(c: str) -> str:
    s = q.strip(c)
    return f"case when {s} = '' then 'document_qa' when {_matches(s, t.ABOUT_LIBRARY)} then 'meta' when length({s}) <= 60 and ({_matches(s, t.GREETING)} or {_matches(s, t.SELF_INTRODUCTION)}) then 'chitchat' else 'document_qa' end"


def _needs(c: str) -> str:
    s = q.strip(c)
    return f"({s} <> '' and ({_matches(s, t.ANAPHORA)} or len(list_filter({q.tok(s)}, lambda k: not list_contains({q.FUNC}, k))) = 0))"


LINE = f"{q.strip('''regexp_replace(l, '^\\s*([-*•]|\\d+[.)])\\s+', '')''')}"
CLAIMS = f"""cl as (select conv_id, turn, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) li from conversations where role = 'assistant'),
cb as (select conv_id, turn, li, {LINE} l from cl), cs as (select conv_id, turn, li, unnest({q.sentences('l')}) c, generate_subscripts({q.sentences('l')}, 1) si from cb where l <> '' and l not like '#%'),
ck as (select * from cs where len(regexp_extract_all(regexp_replace(c, '\\[S(\\d+)\\]', '', 'g'), '[A-Za-z0-9]+')) >= 3 and length(c) >= 12)"""
WEIGHT = "case when regexp_matches(trim(coalesce(w, k), '.,;:()'), '^(\\d[\\d,.%/-]*|[A-Z][A-Za-z0-9.-]{2,})$') then 3.0::double else 1.0::double end"


def cleaned(c: str) -> str:
    """Text hygiene of texts without marks that join lines."""
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    c = f"regexp_replace({c}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    c = f"array_to_string(list_transform(string_split({c}, chr(10)), lambda v: regexp_replace(v, '\\s+$', '')), chr(10))"
    return q.strip(c)


_MARKS = "[ \\t]*((?:\\[S\\d+\\])+)"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(answer, '([.!?])" + _MARKS + "', ' \\2\\1', 'g'), '([^\\s(\\[])(\\[S\\d+\\])', '\\1 \\2', 'g'), '[ \\t]{2,}', ' ', 'g')"
_BARE = "regexp_replace(claim, '\\[S(\\d+)\\]', '', 'g')"
#: From ga(answer_id, answer, passages), answers that cite as [S#] in two marks in a row at most, to ground(answer_id, answer, refusal, invalid, confidence, verified, abstained, method).
GROUND = f"""gn as (select answer_id, passages, {_NORMAL} answer from ga), gr as (select *, {_refusal('answer')} refusal, list_filter(list_distinct(list_transform(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), lambda x: x::int)), lambda x: x < 1 or x > len(passages)) bad from gn),
gs as (select answer_id, passages, refusal, len(bad) invalid, case when refusal then answer else {q.strip("regexp_replace(regexp_replace(list_reduce(list_concat([answer], list_transform(bad, lambda x: '[S' || x || ']')), lambda a, m: replace(a, m, '')), '[ \\t]{2,}', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g')")} end answer from gr),
gl as (select answer_id, passages, unnest(string_split(answer, chr(10))) l, generate_subscripts(string_split(answer, chr(10)), 1) li from gs where not refusal and len(passages) > 0),
gb as (select answer_id, passages, li, {LINE} l from gl), gc as (select answer_id, passages, li, unnest({q.sentences('l')}) claim, generate_subscripts({q.sentences('l')}, 1) si from gb where l <> '' and l not like '#%'),
gk as (select *, answer_id || '/' || row_number() over (partition by answer_id order by li, si) id, {_BARE} bare, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(claim, '\\[S(\\d+)\\]', 1), lambda x: x::int)), lambda x: x between 1 and len(passages))) cites from gc
 where len(regexp_extract_all({_BARE}, '[A-Za-z0-9]+')) >= 3 and length(claim) >= 12),
ge as (select *, array_to_string(case when len(cites) > 0 then list_transform(cites, lambda n: passages[n]) else passages end, chr(10)) evidence from gk),
gp as (select id, id || '#' || j pid, p from (select id, unnest(list_append(passages, evidence)) p, generate_subscripts(list_append(passages, evidence), 1) j from ge)),
gcv as ({q.hashed('gk', 'id', 'bare')}), gpv as ({q.hashed('gp', 'pid', 'p')}),
gm as (select gp.id, max(coalesce(case when isnan(list_cosine_similarity(c.v, p.v)) then 0 else list_cosine_similarity(c.v, p.v) end, 0)) semantic from gp join gcv c on c.id = gp.id join gpv p on p.id = gp.pid group by 1),
gt as (select id, {q.tok('evidence')} ev, unnest(list_distinct({q.tok('bare')})) k, {q.words('bare')} ws from ge), gu as (select id, ev, k, list_filter(ws, lambda x: ({q.tok('x')})[1] = k)[1] w from gt),
gx as (select id, case when len(any_value(ev)) = 0 then 0 else sum(case when list_contains(ev, k) then {WEIGHT} else 0 end) / sum({WEIGHT}) end lexical from gu group by 1),
gw as (select answer_id, len(cites) = 0 alone, round(0.55::double * semantic + 0.45::double * coalesce(lexical, 0), 9) raw from ge join gm using (id) left join gx using (id)),
gv as (select answer_id, alone, case when raw >= 0.42::double + 0.15::double then case when alone then 'partial' else 'supported' end when raw >= 0.42::double then 'partial' else 'unsupported' end verdict, round(case when alone then raw * 0.9::double else raw end, 3) support from gw),
gq as (select answer_id, sum(case verdict when 'supported' then 1.0::double when 'partial' then 0.5 else 0 end) / count(*) ratio, avg(support) mean, bool_or(not alone) cited from gv group by 1),
gf as (select *, round(least(1.0::double, 0.5::double * ratio + 0.35::double * mean + 0.15::double * case when cited then 1.0::double else 0.55 end), 3) conf from gq),
gh as (select gs.*, gf.ratio, gf.conf, answer = '' or len(passages) = 0 empty from gs left join gf using (answer_id)),
gi as (select *, round(greatest(0.0::double, case when refusal then 0.5::double when empty then 0.0 else coalesce(conf, 0.6) end - case when refusal then 0.0::double else 0.1::double * invalid end), 3) confidence,
 case when refusal then true when empty then false else coalesce(ratio >= 0.5 and conf >= 0.25, true) end verified, case when refusal then 'refusal' when ratio is null and not empty then 'trivial' when empty then 'none' else 'hybrid-lexical-semantic' end as method from gh),
ground as (select answer_id, refusal, invalid, confidence, verified, method, not refusal and confidence < 0.25 abstained, case when not refusal and confidence < 0.25 then {q.quoted(ground.ABSTAINED)} else answer end answer from gi)"""
S_ = "(((i * 7 + c * 13) % 100) / 100.0::double)"
SQL = {
    "parse_citations": "select * from (values (1, '1'), (2, '2'), (3, '1,2'), (4, '5'), (5, ''), (6, '1'), (7, '1,9'), (8, '1,2'), (9, '3'), (10, ''), (11, '2,4')) v(id, numbers)",
    "normalize_citations": "select * from (values (1, 'Revenue rose [S1].'), (2, 'It grew [S2].'), (3, 'Both [S1] [S2] say so.'), (4, 'See [S5] here.'), (5, 'In (2024) it fell.'), (6, 'Revenue was $48.2M [S1].'), (7, 'Real [S1] and fake [S9].'), (8, 'A [S1] B [S2].'), (9, 'Joined [S3] words twice.'), (10, 'No marks.'), (11, 'Order [S4] [S2] [S4].')) v(id, s)",
    "strip_invalid": "select id, " + q.strip("regexp_replace(regexp_replace(regexp_replace(s, '\\[S([3-9]|\\d\\d+)\\]', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g')") + f" s from {q.values(CITED, 'id, s')}",
    "split_claims": f"with {CLAIMS} select conv_id, turn, row_number() over (partition by conv_id, turn order by li, si) - 1 idx, md5(c) claim_md5 from ck",
    "refusal_detection": f"select id, {_refusal('s')} refusal from {CONV} union all select -id, {_refusal('s')} from {q.values(REPLIES, 'id, s')}",
    "lexical_support": f"""with {POOL}, j as (select query_id, chunk_id, question c, {q.tok('text')} ev from ca where rank <= 6),
k as (select query_id, chunk_id, ev, unnest(list_distinct({q.tok('c')})) k, {q.words('c')} ws from j),
sw as (select query_id, chunk_id, ev, k, list_filter(ws, lambda x: ({q.tok('x')})[1] = k)[1] w from k)
select query_id, chunk_id, round(case when len(any_value(ev)) = 0 then 0 else sum(case when list_contains(ev, k) then {WEIGHT} else 0 end) / sum({WEIGHT}) end, 6) support from sw group by query_id, chunk_id""",
    "semantic_support": "select a.vec_id claim, round(max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 5) support from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0 group by 1",
    "grounding_confidence": f"""with r as (select doc_id i, unnest([0, 1, 2]) c from documents), s as (select i, c, round(0.55::double * {S_} + 0.45::double * (1 - {S_} / 2), 9) raw from r),
v as (select i, c, case when raw >= 0.42::double + 0.15::double then case when c = 1 then 'partial' else 'supported' end when raw >= 0.42 then 'partial' else 'unsupported' end verdict, round(case when c = 1 then raw * 0.9::double else raw end, 3) support from s),
a as (select i, count(*) claims, sum((c = 1)::int)::bigint uncited_claims, sum(case verdict when 'supported' then 1.0::double when 'partial' then 0.5 else 0 end) / count(*) ratio, avg(support) mean from v group by 1),
f as (select *, round(least(1.0, 0.5::double * ratio + 0.35::double * mean + 0.15::double), 3) confidence from a) select i answer_id, claims, uncited_claims, round(ratio, 5) support_ratio, confidence, ratio >= 0.5 and confidence >= 0.25 verified from f""",
    "ground_answers": f"""with cv as (select *, list(text) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding) p from conversations where role <> 'system'),
ga as (select conv_id * 1000 + turn answer_id, text || case turn % 3 when 0 then ' [S1]' when 1 then ' [S1] [S8]' else '' end answer, coalesce(p, []::varchar[]) passages from cv where role = 'assistant' union all select -i, a, p::varchar[] from {q.values(ANSWERS, 'i, a, p')}), {GROUND}
select answer_id, method, verified, abstained, confidence, invalid::int invalid, md5(answer) answer_md5 from ground""",
    "intent_routing": f"select id, {_intent('s')} intent from {CONV} where role = 'user' union all select -id, {_intent('s')} from {q.values(QUESTIONS, 'id, s')}",
    "needs_history": f"select id, {_needs('s')} needed from {CONV} where role = 'user' union all select -id, {_needs('s')} from {q.values(QUESTIONS, 'id, s')}",
    "retrieval_queries": "select * from (values (1, 'when is the report due?', 'and when is it due?|report due date'), (2, 'what about expenses?', 'expense policy under STD-441|expenses|travel expenses'), (3, 'What is X policy?', 'x policy|policy x|a b|c d|e f')) v(id, resolved, extras)",
    "history_window": f"select conv_id, string_agg(case when role = 'user' then 'User' else 'Assistant' end || ': ' || substr({q.squeeze('text')}, 1, 400), chr(10) order by turn) history from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations where role <> 'system') where n <= 6 and {q.squeeze('text')} <> '' group by 1",
    "json_extract": "select 'events ' || json_valid(props) k, count(*)::varchar v from events group by 1 union all select * from (values ('1', '{\"a\":1}'), ('2', '{\"b\":[1,2]}'), ('3', '{\"c\":\"x\"}'), ('4', null), ('5', null), ('6', null), ('7', null)) v(k, v)",
    "breaker_states": f"""with recursive z as (select user_id % 20 as key, list(event_id order by event_id) e, count(*)::int calls from events group by 1),
r as (select key, e, calls, 0 i, 'closed' state, 0 run, 0.0::double since, 0 opened, 0 rejected from z
 union all select key, e, calls, i + 1, case when blk then state when op then 'open' else 'closed' end, case when blk then run when f then run + 1 else 0 end, case when blk or not op then since else ts end, opened + case when op and not blk then 1 else 0 end, rejected + blk::int
 from (select *, f and (state = 'open' or run + 1 >= {SETTINGS.breaker_threshold}) op from (select *, (e[i + 1] * 7) % 10 < 7 f, e[i + 1] * 3.0::double ts, state = 'open' and e[i + 1] * 3.0::double - since < {SETTINGS.breaker_cooldown} blk from r where i < calls)))
select key, calls, rejected, opened, state from r where i = calls""",
    "error_hints": "select * from (values (1, true, 3.66::double), (2, false, 0.45), (3, false, null), (4, true, null), (5, false, null)) v(id, transient, wait)",
    "answer_accuracy": "select * from (values (1, true, true, false), (2, false, false, false), (3, true, false, false), (4, false, false, true)) v(id, \"any\", \"all\", declined)",
    "latency_quantiles": "select event_type, count(*) n, (list(value order by value))[count(*) // 2 + 1] p50, (list(value order by value))[least(count(*) - 1, floor(count(*) * 0.95::double)::bigint) + 1] p95 from events where value is not null group by 1",
}
