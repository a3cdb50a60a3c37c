"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers count what the tokenizer would emit, without building its tokens.

1. The splitter reads code points by class and marks where a pre-token begins. It is run in parallel: a batch is cut
   into chunks, each chunk is run from every state at once (its state map), the maps are composed by a prefix
   scan, and a second run from the now known entry states marks the boundaries.
2. The merger reads the bytes of a pre-token. Its state holds, for each place where the current token may have begun,
   the node in the vocabulary trie, the token that would end there and its relative count; a transition is
   annotated with the tokens it settles. The last token of a prefix is the only one that ends there and stands next to
   its predecessor as the merges would leave it, so the automaton is deterministic. States are made when
   first reached and kept as packed numbers; beyond KEPT they are made anew from the one that is being left, so a worker's
   memory is bounded for any text, however long a pre-token.

The vocabulary file is a parameter and must be at that path on every node; one that asks for another splitter, a normalizer or
other flags raises. Strings of added tokens inside a text count
as one token each, as the library does by default.

Defined cases: a null text is empty, and an empty text has no token; repeated rows are counted each; a text of any
length is counted whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, buffers, table, windows

LIMIT = 512
CHUNK = 128  # code points in a chunk
STEP = 1 << 20  # bytes of text worked on at once, at least one text
KEPT = 1 << 18  # pre-tokens, states or seams remembered by a worker
SETTLED = 20  # bits for the tokens that a transition settles, fewer than a vocabulary's longest token has bytes

# --- the splitter -----------------------------------------------------------------------------------------------

(LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, C_STMD, C_R, C_V, C_L, C_E, END) = range(12)
(START, IN_L, IN_N, IN_O, AFTER_SPACE, AFTER_WHITE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE) = range(11)
HERE, BEFORE = 1, 2  # a pre-token begins at this code point, at the one before


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state * 16 + class, for contractions, runs of letters, numbers, others, white space."""
    nxt, out = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    fresh = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: AT_QUOTE, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, END: START} | {c: IN_L for c in (C_STMD, C_R, C_V, C_L, C_E)}
    letters = (LETTER, C_STMD, C_R, C_V, C_L, C_E)

    def put(state: int, c: int, to: int, mark: int) -> None:
        nxt[state * 16 + c], out[state * 16 + c] = to, mark

    for state in range(11):
        for c, to in fresh.items():
            put(state, c, to, HERE)
    for c in letters:
        put(IN_L, c, IN_L, 0)
    put(IN_N, NUMBER, IN_N, 0)
    put(IN_O, OTHER, IN_O, 0)
    put(IN_O, QUOTE, IN_O, 0)
    for c in (SPACE, WHITE):  # a run of white space goes on
        for state in (AFTER_SPACE, AFTER_WHITE):
            put(state, c, fresh[c], 0)
    for c, to in fresh.items():
        if c not in (SPACE, WHITE, END):
            put(AFTER_SPACE, c, IN_O if c == QUOTE else to, BEFORE)  # the last space joins what follows
            put(AFTER_WHITE, c, to, BEFORE | HERE)  # the last white space stands alone
    put(AT_QUOTE, OTHER, IN_O, 0)
    put(AT_QUOTE, QUOTE, IN_O, 0)
    put(AT_QUOTE, C_STMD, DONE, 0)
    for c, to in ((C_R, QUOTE_R), (C_V, QUOTE_V), (C_L, QUOTE_L)):
        put(AT_QUOTE, c, to, 0)
    for state, wanted in ((QUOTE_R, C_E), (QUOTE_V, C_E), (QUOTE_L, C_L)):
        for c, to in fresh.items():
            put(state, c, IN_L if c in letters else to, BEFORE if c in letters else BEFORE | HERE)
        put(state, wanted, DONE, 0)
    return nxt, out


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASSES:
        kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = LETTER
            elif k == "N":
                kinds[c] = NUMBER
        for c in [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            kinds[c] = WHITE
        kinds[32], kinds[39] = SPACE, QUOTE
        for chars, k in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
            for c in chars:
                kinds[ord(c)] = k
        _CLASSES.append(kinds)
    return _CLASSES[0]


def boundaries(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens begin in a run of code point classes, through composed state maps of its chunks."""
    nxt, out = splitter()
    n = len(kinds)
    m = -(-n // chunk)
    grid = np.full(m * chunk, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(m, chunk).T)
    maps = np.repeat(np.arange(11, dtype=np.uint8)[:, None], m, axis=1)
    for row in grid:
        maps = nxt[(maps << 4) | row]
    step = 1
    while step < m:  # prefix scan: maps[:, i] becomes the map of chunks 0..i
        maps = np.concatenate((maps[:, :step], np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)), axis=1)
        step *= 2
    state = np.concatenate(([START], maps[START, :-1])).astype(np.uint8)
    marks = np.empty_like(grid)
    for k, row in enumerate(grid):
        at = (state << 4) | row
        marks[k] = out[at]
        state = nxt[at]
    marks = marks.T.reshape(-1)
    here = (marks & HERE) > 0
    here[:-1] |= (marks[1:] & BEFORE) > 0
    return np.nonzero(here[:n])[0]


# --- the merger -------------------------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def expected(spec: dict) -> None:
    """Raises if the vocabulary file asks for what the transducers don't compile: another splitter, a normalizer, other flags."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [k for k, ok in {
        "normalizer": spec.get("normalizer") is None, "pre_tokenizer": pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True),
        "model": model.get("type", "BPE") == "BPE" and not model.get("ignore_merges") and not model.get("byte_fallback") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"),
        "added_tokens": not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }.items() if not ok]
    if wrong:
        raise ValueError(f"not compiled for this {', '.join(wrong)} of the vocabulary file")


FIRST = array("i", (0, -1, 0)).tobytes()  # the state at the beginning of a pre-token


class Merger:
    """Counts the tokens of a pre-token's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        expected(spec)
        byte = _byte_of()
        coded = lambda s: bytes(byte[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for r, (a, b) in enumerate(pairs):
            a, b = coded(a), coded(b)
            self.rank.setdefault((a, b), r)
            self.made.setdefault(a + b, (r, a, b))
        self.tokens = sorted({bytes([b]) for b in range(256)} | set(self.made))
        self.trie: list[dict[int, int]] = [{}]
        self.token = [-1]  # by node, the number of the token that ends there
        for k, t in enumerate(self.tokens):
            node = 0
            for b in t:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][b]
            self.token[node] = k
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.together: dict[int, bool] = {}
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.steps: dict[int, int] = {}  # by state and byte
        self.closing: list[int] = []
        self.counts: dict[str, int] = {}
        self.former: dict[str, int] = {}  # the counts before these
        self.numbered(FIRST)

    def numbered(self, state: bytes) -> int:
        """The number of a state: node, number of the token before (-1: none) and relative count of each place."""
        if (known := self.number.get(state)) is not None:
            return known
        if len(self.states) >= KEPT:
            for kept in (self.states, self.number, self.steps, self.closing):
                kept.clear()
            self.numbered(FIRST)
        k = self.number[state] = len(self.states)
        self.states.append(state)
        self.closing.append(memoryview(state).cast("i")[-1])
        return k

    def neighbours(self, before: int, token: int) -> bool:
        """Whether the merges leave two tokens next to each other: no pair at the seam merges before its token is taken in."""
        if before < 0:
            return True
        seam = before * len(self.tokens) + token
        if (known := self.together.get(seam)) is not None:
            return known
        if len(self.together) >= KEPT:
            self.together.clear()
        x, y, limit, out = self.tokens[before], self.tokens[token], 1 << 60, True
        while True:
            if self.rank.get((x, y), 1 << 60) < limit:
                out = False
                break
            rx = self.made[x][0] if x in self.made else -1
            ry = self.made[y][0] if y in self.made else -1
            if rx < 0 and ry < 0:
                break
            if rx > ry:  # undo the later merge; only pairs ranked before it were there at that time
                limit, x = rx, self.made[x][2]
            else:
                limit, y = ry + 1, self.made[y][1]
        self.together[seam] = out
        return out

    def step(self, state: int, byte: int) -> int:
        """The next state and, in the lowest bits, the tokens settled."""
        live, last = [], None
        places = iter(memoryview(self.states[state]).cast("i").tolist())
        for node, before, n in zip(places, places, places):
            child = self.trie[node].get(byte)
            if child is None:
                continue
            live.append((child, before, n))
            t = self.token[child]
            if last is None and t >= 0 and self.neighbours(before, t):
                last = (0, t, n + 1)
        live.append(last)
        base = min(n for _, _, n in live)
        made = array("i", [x for node, before, n in live for x in (node, before, n - base)]).tobytes()
        new = made not in self.number and len(self.states) >= KEPT
        found = self.numbered(made) << SETTLED | base
        if not new:  # else the state that is left has no number any more
            self.steps[state << 8 | byte] = found
        return found

    def count(self, word: str) -> int:
        state = total = 0
        steps, settled = self.steps, (1 << SETTLED) - 1
        for byte in word.encode():
            found = steps.get(state << 8 | byte)
            if found is None:
                found = self.step(state, byte)
            total += found & settled
            state = found >> SETTLED
        return total + self.closing[state]

    def total(self, words: list[str]) -> np.ndarray:
        """The count of each word; those of the last words are remembered, so frequent words are counted once."""
        out = np.zeros(len(words), np.int64)
        for a, b in windows(len(words), KEPT // 2):
            if len(self.counts) > KEPT // 2:
                self.former, self.counts = self.counts, {}
            some, counts, former = words[a:b], self.counts, self.former
            for w in set(some).difference(counts):
                counts[w] = self.count(w) if (known := former.get(w)) is None else known
            out[a:b] = np.fromiter(map(counts.__getitem__, some), np.int64, b - a)
        return out


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def count_texts(texts: list[str], m: Merger) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, t in enumerate(texts):
        if m.special is not None and m.special.search(t):
            split = m.special.split(t)
            out[i] += len(split) - 1
            parts += split
            owner += [i] * len(split)
        else:
            parts.append(t)
            owner.append(i)
    whole = "\n".join(parts) + "\n"  # the joints are marked as ends below
    kinds = classes()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    kinds[ends] = END
    at = boundaries(kinds)
    cuts = np.append(at, len(whole)).tolist()
    words = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
    n = m.total(words)
    n[np.searchsorted(at, ends)] = 0
    np.add.at(out, np.array(owner, np.int64)[np.searchsorted(ends, at)], n)
    return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    schema = rows.select(id_col).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            _, at = buffers(batch.column(1))
            n, a = [], 0
            while a < len(at) - 1:
                b = max(a + 1, int(np.searchsorted(at, at[a] + STEP, "right")) - 1)
                n.append(count_texts([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], m))
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=schema.names)

    return arrow_batches(rows).mapInArrow(each, schema)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
