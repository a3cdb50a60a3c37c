"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from quarry.config import ABBREVIATIONS, FUNCTION_WORDS, STOPWORDS


def quoted(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(quoted, v)) + "]"
    parts = ["'" + p.replace("'", "''") + "'" for p in v.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") v({names})"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP, FUNC, ABBR = listed(STOPWORDS), listed(FUNCTION_WORDS), listed(ABBREVIATIONS)


def tok(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9._/-]*'), lambda x: trim(x, '._/-')), lambda x: length(x) > 1 and not list_contains({STOP}, x))"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def tokens(c: str) -> str:
    return f"greatest(1, floor(len({words(c)}) * 1.3::double))::int"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def squeeze(c: str) -> str:
    return strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")


def clip(c: str, n: int) -> str:
    s = squeeze(c)
    return f"case when length({s}) <= {n} then {s} else regexp_replace(substr({s}, 1, {n}), ' [^ ]*$', '') || ' ...' end"


def sentences(c: str) -> str:
    """For texts without blank lines."""
    cut = f"list_filter(list_transform(string_split(regexp_replace({strip(c)}, '([.!?])[\"'')\\]]*\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
    word = "rtrim(lower(regexp_extract(a, '([A-Za-z.]+)\\.[\"'')\\]]*$', 1)), '.')"
    joined = f"list_reduce({cut}, lambda a, s: a || case when regexp_matches(a, '[A-Za-z.]+\\.[\"'')\\]]*$') and (list_contains({ABBR}, {word}) or length({word}) = 1) then ' ' else chr(1) end || s)"
    return f"case when len({cut}) = 0 then []::varchar[] else string_split({joined}, chr(1)) end"


def hashed(table: str, key: str, text: str, size: int = 64) -> str:
    """(id, v): the hashed embedding of each row's text."""
    hashes = f"select {key} id, md5(unnest({tok(text)})) h from {table}"
    parts = f"select id, ('0x' || substr(h, 1, 7))::bigint % {size} dim, case when ('0x' || substr(h, 8, 1))::int % 2 = 0 then 1.0::double else -1.0 end w from ({hashes})"
    sums = f"select id, map(list(dim), list(w)) m from (select id, dim, sum(w) w from ({parts}) group by all) group by 1"
    return f"select t.{key} id, list_transform(range({size}), lambda i: coalesce(m[i], 0.0::double)) v from {table} t left join ({sums}) k on k.id = t.{key}"


def bm25(where: str = "", asked: str = "benchmark", ask_id: str = "item_id", ask_text: str = "text") -> str:
    """CTEs up to s(query_id, chunk_id, score)."""
    return f"""
dt as (select doc_id chunk_id, {tok("concat_ws(' ', source, lang, text)")} t from documents),
dd as (select *, len(t) dl from dt where len(t) > 0),
tot as (select count(*) n, avg(len(t)) avgdl from dd),
po as (select chunk_id, dl, term, count(*) tf from (select chunk_id, dl, unnest(t) term from dd) group by all),
raw as (select term, count(*) df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) r from po, tot group by term, n),
terms as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end idf from raw),
q as (select query_id, term, count(*) qtf from (select {ask_id} query_id, unnest({tok(ask_text)}) term from {asked}) group by all),
s as (select query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from q join terms using (term) join po using (term), tot group by all {where})"""


def top(source: str, k: int) -> str:
    return f"select query_id, chunk_id, rank, round(score / max(score) over (partition by query_id), 4) score from (select *, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) rank from {source} where score > 0) where rank <= {k}"


def dense(name: str, k: int, queries: str, where: str = "true") -> str:
    return f"{name} as (select query_id, chunk_id, rank, round(s, 4) score from (select *, row_number() over (partition by query_id order by round(s, 6) desc, chunk_id) rank from (select q.id query_id, e.vec_id chunk_id, greatest(0, list_cosine_similarity(q.v, e.embedding::double[])) s from {queries} q, embeddings e where {where})) where rank <= {k})"
