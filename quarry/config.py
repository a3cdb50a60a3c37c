"""Settings of the retrieval and verification engine, with its defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunks
    chunk_tokens: int = 420
    overlap_tokens: int = 64
    min_chunk_tokens: int = 48
    breakpoint_percentile: float = 0.88
    page_chars: int = 3000
    docx_page_chars: int = 2600
    title_tokens: int = 24
    section_tokens: int = 40
    # retrieval
    retrieval_mode: str = "hybrid"
    top_k: int = 6
    pool: int = 40
    rrf_k: int = 60
    mmr_lambda: float = 0.65
    relevance_floor: float = 0.15
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    # reranking
    rerank_input: int = 20
    rerank_weight: float = 0.85
    # planning
    max_sub_queries: int = 3
    history_turns: int = 6
    fast_path_chars: int = 60
    hyde_chars: int = 600
    # answers
    context_tokens: int = 6000
    passage_overhead: int = 30
    extractive_passages: int = 4
    snippet_chars: int = 600
    # verification
    min_support: float = 0.42
    supported_margin: float = 0.15
    abstain_below: float = 0.25
    semantic_weight: float = 0.55
    uncited_factor: float = 0.9
    # uploads
    max_files: int = 20
    max_bytes: int = 50 << 20
    # embedding
    dimension: int = 64
    batch: int = 32
    # model calls
    breaker_threshold: int = 5
    breaker_cooldown: float = 45.0
    call_tries: int = 3
    call_backoff: float = 0.8
    call_timeout: float = 45.0


SETTINGS = Settings()

# Fixed values, by which results must agree: words without weight in the index, words without a topic of their own,
# and words that end in a full stop inside a sentence.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i", "if",
    "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "were",
    "what", "when", "where", "which", "who", "will", "with", "would", "you", "your",
)
FUNCTION_WORDS = (
    "about", "and", "what", "how", "the", "it", "that", "this", "those", "these", "one", "ones", "second", "third", "first", "last", "next", "other",
    "another", "of", "for", "is", "are", "was", "were", "do", "does", "did", "so", "then", "also", "too", "much", "many", "more", "why", "when",
    "where", "who", "which", "me", "my", "i", "you", "your", "we", "our", "they", "them", "there", "here",
)
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "no", "vs", "fig", "eq", "al", "etc", "inc", "ltd", "co", "corp", "dept", "est", "approx",
    "e.g", "i.e", "cf", "vol", "ch", "sec", "p", "pp",
)
