"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import ABBREVIATIONS, FUNCTION_WORDS, SETTINGS, STOPWORDS

# Fixed values here and below: patterns by which results must agree.
TOKEN = "([a-z0-9][a-z0-9._/-]*)"
CITATION = r"\[S(\d+)\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space as single spaces, trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def raw_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1)), lambda t: F.btrim(t, F.lit("._/-")))


def tokens(c: Column) -> Column:
    """Index terms: lower-case ASCII words and codes, without stop words and single characters."""
    return F.filter(raw_tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    """Tokens by the word proxy: 1.3 a word, at least one."""
    return F.greatest(F.lit(1), F.floor(F.size(words(c)) * F.lit(1.3)).cast("int"))


_TOKENIZERS: dict = {}


def token_count_by(c: Column, path: str) -> Column:
    """Tokens by a tokenizer's vocabulary file (JSON), which must be at that path on every node; null as empty."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if path not in _TOKENIZERS:
            from tokenizers import Tokenizer  # optional

            _TOKENIZERS[path] = Tokenizer.from_file(path)
        found = _TOKENIZERS[path].encode_batch([t if t is not None else "" for t in texts], add_special_tokens=False)
        return pd.Series([len(e.ids) for e in found])

    return count(c)


def first_tokens(c: Column, n: int) -> Column:
    return F.when(F.size(words(c)) > n, F.array_join(F.slice(words(c), 1, n), " ")).otherwise(c)


def clip(c: Column, limit: int) -> Column:
    """Squeezed text of at most limit characters, cut at a space with ' ...' after it."""
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, limit), r" [^ ]*$", ""), F.lit(" ...")))


def clean(c: Column) -> Column:
    """Text hygiene: control characters, hyphens at line ends, ligatures, runs of spaces and blank lines."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    c = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    c = F.replace(F.replace(F.replace(c, F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?|[\u0085  ]", "\n"), r"(?U)[\s&&[^\n]]+(?=\n|$)", "")
    return strip(c)


def heading_level(c: Column) -> Column:
    """Level of a line that reads like a heading, 0 if it doesn't."""
    number = F.regexp_extract(c, r"^(\S+)", 1)
    return (
        F.when((F.length(c) > 120) | c.rlike(r"[.,;]$"), 0)
        .when(c.rlike(r"(?U)^\d+(\.\d+)*\.?\s+\S"), F.least(F.lit(3), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1))
        .when(c.rlike(r"(?i)^(chapter|section|part|appendix)\b"), 1)
        .when((F.length(c) < 70) & (F.upper(c) == c) & (F.lower(c) != c) & (F.size(words(c)) <= 10), 2)
        .otherwise(0)
    )


def _abbreviated(s: Column) -> Column:
    word = F.rtrim(F.lower(F.regexp_extract(s, r"([A-Za-z.]+)\.[\"')\]]*$", 1)), F.lit("."))
    return s.rlike(r"[A-Za-z.]+\.[\"')\]]*$") & (word.isin(*ABBREVIATIONS) | (F.length(word) == 1))


def sentences(c: Column) -> Column:
    """Sentences of a text; a fragment that ends in an abbreviation takes in the next one."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda p: p != "")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.filter(F.transform(F.split(p, r"(?U)(?<=[.!?])[\"')\]]*\s+(?=[A-Z0-9\"'(\[])"), strip), lambda s: s != "")))
    start = F.array().cast("array<string>")
    return F.aggregate(
        parts, start,
        lambda acc, s: F.when((F.size(acc) > 0) & _abbreviated(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), s)))).otherwise(F.concat(acc, F.array(s))),
    )


def context_header(title: Column, section: Column, page: Column) -> Column:
    parts = F.concat_ws(
        " | ",
        F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Document: "), first_tokens(title, SETTINGS.title_tokens))),
        F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), first_tokens(section, SETTINGS.section_tokens))),
        F.concat(F.lit("Page: "), page.cast("string")),
    )
    return F.concat(F.lit("["), parts, F.lit("]"))


# --- citations and claims -----------------------------------------------------------------------------------------


def citations(c: Column) -> Column:
    """The distinct numbers of [S#] marks, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))))


def uncited(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


# Fixed value: other ways of citing.
LOOSE = r"[\[(]\s*(?:S|Source|source|SOURCE)\s*\.?\s*(?:\d+(?:\s*[,;&]\s*(?:S|Source|source)?\s*\.?\s*\d+)*)\s*[\])]"


def normal_citations(c: Column) -> Column:
    """All ways of citing as [S#]: brackets of other scripts, (S2), [Source 3], [S1, S2]; marks inside their sentence."""
    c = F.translate(c, "【】［］‹›", "[][][]")
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({LOOSE})"), F.lit(1)))
    mark = lambda m: F.array_join(F.transform(F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("[S"), n.cast("long").cast("string"), F.lit("]"))), "")
    c = F.aggregate(found, c, lambda acc, m: F.replace(acc, m, mark(m)))
    c = F.regexp_replace(c, r"([.!?])[ \t]*((?:\[S\d+\])+)", " $2$1")
    c = F.regexp_replace(c, r"(?U)(?<=[^\s(\[])(\[S\d+\])", " $1")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def invalid_citations(c: Column, valid: Column) -> Column:
    return F.filter(citations(c), lambda n: (n < 1) | (n > valid))


def strip_invalid(c: Column, valid: Column) -> Column:
    """The text without [S#] marks beyond the valid count."""
    marks = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\[S\d+\])"), F.lit(1)))
    number = lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("long")
    bad = F.filter(marks, lambda m: (number(m) < 1) | (number(m) > valid))
    c = F.aggregate(bad, c, lambda acc, m: F.replace(acc, m, F.lit("")))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"(?U)\s+([.,;:])", "$1"))


def refusal(c: Column) -> Column:
    """Whether an answer says that the documents don't hold one."""
    s = strip(F.coalesce(c, F.lit("")))
    said = s.rlike(r"(?i)\b(could\s*n[o']?t|cannot|can\s*not|do(?:es)?\s*n[o']?t|no|not)\b[^.]{0,60}?\b(find|found|contain|mention|state|specify|include|appear|available|provided)\b")
    return (s != "") & (F.length(s) < 700) & (F.size(citations(s)) == 0) & said


def claims(c: Column) -> Column:
    """Sentences that assert something: at least three words and twelve characters, outside headings."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n?|\n"), lambda s: strip(F.regexp_replace(s, r"(?U)^\s*([-*•]|\d+[.)])\s+", "")))
    lines = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))
    every = F.flatten(F.transform(lines, sentences))
    return F.filter(every, lambda s: (F.size(F.regexp_extract_all(uncited(s), F.lit("([A-Za-z0-9]+)"), F.lit(1))) >= 3) & (F.length(s) >= 12))


def lexical_support(claim: Column, evidence: Column) -> Column:
    """Share of the claim's distinct tokens that the evidence has; numbers and names count three times."""
    bare = uncited(claim)
    own, there = F.array_distinct(tokens(bare)), tokens(evidence)
    named = F.filter(F.transform(words(bare), lambda w: F.struct(F.coalesce(F.try_element_at(tokens(w), F.lit(1)), F.lit("")).alias("t"), w.alias("w"))), lambda s: s["t"] != "")
    surface = lambda t: F.coalesce(F.try_element_at(F.filter(named, lambda s: s["t"] == t), F.lit(1))["w"], t)
    weight = lambda t: F.when(F.btrim(surface(t), F.lit(".,;:()")).rlike(r"^(\d[\d,.%/-]*|[A-Z][A-Za-z0-9.-]{2,})$"), 3.0).otherwise(1.0)
    total = F.aggregate(own, F.lit(0.0), lambda a, t: a + weight(t))
    matched = F.aggregate(F.filter(own, lambda t: F.array_contains(there, t)), F.lit(0.0), lambda a, t: a + weight(t))
    return F.when((F.size(own) == 0) | (F.size(there) == 0), 0.0).otherwise(matched / total)


# --- questions ------------------------------------------------------------------------------------------------------

# Patterns of messages that need no search, and of references to earlier turns.
GREETING = (
    r"(?i)^\s*(hi|hey+|hello+|yo|sup|howdy|hola|namaste|good\s+(morning|afternoon|evening|day)|how\s+(are|r)\s+(you|u)|what'?s\s+up|thanks?|thank\s+you|thx|ty|ok(ay)?|cool|nice|great|"
    r"bye|goodbye|see\s+ya|who\s+are\s+you|what\s+can\s+you\s+do|help)\b(\s+(there|all|again|team|guys|folks|everyone|mate|buddy|bot|so\s+much))?[\s!.?,]*$"
)
SELF_INTRODUCTION = r"(?i)^\s*(i\s*am|i'm|my\s+name\s+is|this\s+is)\s+[\w\s.]{1,40}[\s!.?]*$"
ABOUT_LIBRARY = r"(?i)\b(what|which|how\s+many)\b.{0,30}\b(documents?|files?|pdfs?|uploads?)\b.{0,30}\b(do\s+i\s+have|are\s+(there|uploaded|loaded)|have\s+i\s+uploaded|did\s+i\s+upload)\b"
ANAPHORA = r"(?i)\b(it|its|it's|that|this|these|those|they|them|their|he|she|him|her|his|hers|same|one|ones|above|former|latter|previous|earlier|there)\b"


def intent(c: Column) -> Column:
    s = strip(c)
    short = F.length(s) <= SETTINGS.fast_path_chars
    return F.when(s == "", "document_qa").when(s.rlike(ABOUT_LIBRARY), "meta").when(short & (s.rlike(GREETING) | s.rlike(SELF_INTRODUCTION)), "chitchat").otherwise("document_qa")


def has_content(c: Column) -> Column:
    return F.exists(tokens(c), lambda t: ~t.isin(*FUNCTION_WORDS))


def needs_history(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return (s != "") & (s.rlike(ANAPHORA) | ~has_content(s))


def found_json(c: Column) -> Column:
    """The JSON object in a model's reply: fenced, bare, or from the first brace to the last; null if there is none."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    span = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    whole = lambda s: F.when(strip(s).startswith("{") & F.try_parse_json(s).isNotNull(), F.to_json(F.try_parse_json(s)))
    return F.coalesce(whole(fence), whole(strip(c)), whole(span))
