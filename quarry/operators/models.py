"""Models behind interfaces: chains of embedding providers, completions with retries, fallback models and a breaker.

A provider is an object with name, model, size and encode(texts, role); a call is a function (model, prompt) -> text that raises
CallError. What needs a network or a model file gets it as a parameter (a post function, an encoder), so that all else is
the same offline. Providers and calls are made in the task that uses them.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from quarry.config import SETTINGS

# --- embedding providers --------------------------------------------------------------------------------------------

# The task that a typed embedding service knows a role by.
TASKS = {"query": "retrieval.query", "passage": "retrieval.passage", "similarity": "text-matching"}


class TryAgain(RuntimeError):
    """A failure that another try may mend: too many requests, a fault of the server, a short reply."""


def backoff(attempt: int, base: float, jitter: float) -> float:
    """Seconds before the next try; attempt counts from 0."""
    wait = base * 2**attempt
    return wait + random.uniform(0, wait * jitter)


@dataclass
class TypedService:
    """An embedding service that wants typed inputs and the role as a task. post(payload) gives (status, reply as a dict)."""

    post: Callable[[dict], tuple[int, dict]]
    model: str
    size: int | None = None
    tries: int = 4
    base: float = 1.0
    sleep: Callable[[float], None] = time.sleep
    name: str = "typed-service"

    def payload(self, texts: list[str], role: str) -> dict:
        wanted = {"model": self.model, "task": TASKS.get(role, TASKS["passage"]), "input": [{"text": t} for t in texts], "truncate": True}
        return wanted | ({"dimensions": self.size} if self.size else {})

    def _once(self, texts: list[str], role: str) -> list[list[float]]:
        status, reply = self.post(self.payload(texts, role))
        if status == 429 or status >= 500:
            raise TryAgain(f"HTTP {status}")
        if status >= 400:
            raise RuntimeError(f"HTTP {status}: {reply}")
        items = reply.get("data") or []
        if len(items) != len(texts):
            raise TryAgain(f"{len(items)} vectors for {len(texts)} texts")
        return [[float(x) for x in item["embedding"]] for item in sorted(items, key=lambda item: item.get("index", 0))]

    def encode(self, texts: list[str], role: str = "passage") -> list[list[float]]:
        for attempt in range(self.tries):
            try:
                return self._once(texts, role)
            except TryAgain as e:
                if attempt + 1 == self.tries:
                    raise RuntimeError(f"no vectors after {self.tries} tries: {e}") from e
                self.sleep(backoff(attempt, self.base, 0.25))
        return []


@dataclass
class LocalModel:
    """A model on the machine; encoder(texts) gives vectors. Queries get the prefix that some models want."""

    encoder: Callable[[list[str]], list[list[float]]]
    model: str
    query_prefix: str = ""
    name: str = "local-model"
    size: int = field(init=False)

    def __post_init__(self) -> None:
        self.size = len(self.encode(["how long is a vector"])[0])

    def encode(self, texts: list[str], role: str = "passage") -> list[list[float]]:
        asked = [self.query_prefix + t for t in texts] if role == "query" else list(texts)
        return [list(map(float, v)) for v in self.encoder(asked)]


def first_that_loads(preferred: str, factories: dict[str, Callable[[], object]]) -> object:
    """The preferred provider, or the first other one that can be made; an error that names all failures if none can."""
    failures = []
    for key in dict.fromkeys([preferred.lower(), *factories]):
        if key in factories:
            try:
                return factories[key]()
            except Exception as e:  # a provider may fail in any way; the next is tried
                failures.append(f"{key}: {e}")
    raise RuntimeError("no embedding provider could be made: " + "; ".join(failures))


def encoder_of(preferred: str, factories: dict[str, Callable[[], object]]) -> Callable[[list[str], str], list[list[float]]]:
    """An encode function for calls.embed() that makes its provider in the task, at the first text."""
    made: list = []

    def encode(texts: list[str], role: str) -> list[list[float]]:
        if not made:
            made.append(first_that_loads(preferred, factories))
        return made[0].encode(texts, role)

    return encode


# --- completions ----------------------------------------------------------------------------------------------------

# What makes an error worth another try, or its model useless.
AGAIN_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
AGAIN_WORDS = ("rate limit", "rate_limit", "429", "timeout", "timed out", "temporarily", "503", "502", "500", "overloaded", "connection", "unavailable")
FATAL_STATUS = (400, 404, 413, 422)
WAIT_HEADERS = ("retry-after", "retry-after-ms", "x-ratelimit-reset-tokens")
WAIT_TEXT = re.compile(r"try again in ([\d.]+)\s*(ms|s)\b", re.I)


class CallError(RuntimeError):
    def __init__(self, message: str, status: int | None = None, headers: dict[str, str] | None = None):
        super().__init__(message)
        self.status, self.headers = status, headers or {}


class Unavailable(RuntimeError):
    """No model answered, or the breaker is open."""


def is_transient(e: CallError) -> bool:
    return e.status in AGAIN_STATUS or any(w in f"{type(e).__name__} {e}".lower() for w in AGAIN_WORDS)


def is_fatal(e: CallError) -> bool:
    """Whether more tries of the same model are pointless."""
    said = str(e).lower()
    return e.status in FATAL_STATUS or "does not exist" in said or "decommissioned" in said or ("context" in said and "length" in said)


def wait_asked(e: CallError) -> float | None:
    """The seconds that the server asks to wait: of its headers, or else of the message."""
    for key in WAIT_HEADERS:
        try:
            value = float(str(e.headers.get(key) or "").rstrip("smh"))
        except ValueError:
            continue
        return value / 1000 if key.endswith("-ms") else value
    m = WAIT_TEXT.search(str(e))
    return None if m is None else float(m[1]) / (1000 if m[2].lower() == "ms" else 1)


@dataclass
class Breaker:
    threshold: int = SETTINGS.breaker_threshold
    cooldown: float = SETTINGS.breaker_cooldown
    now: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float = 0.0

    @property
    def state(self) -> str:
        if self.failures < self.threshold:
            return "closed"
        return "half_open" if self.now() - self.opened >= self.cooldown else "open"

    def told(self, good: bool) -> None:
        self.failures = 0 if good else self.failures + 1
        if self.failures >= self.threshold:
            self.opened = self.now()


@dataclass
class Client:
    """Asks a chain of models, the first best, each up to tries times."""

    call: Callable[[str, str], str]
    models: tuple[str, ...]
    tries: int = SETTINGS.call_tries
    base: float = SETTINGS.call_backoff
    longest: float = SETTINGS.call_timeout / 2
    breaker: Breaker = field(default_factory=Breaker)
    sleep: Callable[[float], None] = time.sleep

    def complete(self, prompt: str) -> dict:
        """text, model, attempts and degraded (another model than the first answered)."""
        if self.breaker.state == "open":
            raise Unavailable("the breaker is open")
        attempts, last = 0, None
        for place, model in enumerate(self.models):
            for n in range(self.tries):
                attempts += 1
                try:
                    text = (self.call(model, prompt) or "").strip()
                    if not text:
                        raise CallError("the model returned an empty completion")
                    self.breaker.told(True)
                    return {"text": text, "model": model, "attempts": attempts, "degraded": place > 0}
                except CallError as e:
                    last = e
                    if is_fatal(e) or n + 1 == self.tries or not is_transient(e):
                        break
                    asked, wait = wait_asked(e), backoff(n, self.base, 0.3)
                    self.sleep(wait if asked is None else min(max(wait, asked + 0.25), self.longest))
        self.breaker.told(False)
        raise Unavailable(f"all models failed after {attempts} attempts: {last}")


def completions(rows: DataFrame, key: str, prompt: str, client: Callable[[], Client]) -> DataFrame:
    """(key, text, model, attempts, degraded, error) of each row; a call that fails is a row with an error, not a failed job.

    Each task makes its client, with a breaker of its own. Rows are asked once, unless Spark has to run a task again.
    """
    kind = dict(rows.dtypes)[key]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()
        for f in frames:
            out = []
            for k, p in zip(f[key], f[prompt], strict=True):
                try:
                    out.append({key: k, "error": None} | own.complete(p))
                except Unavailable as e:
                    out.append({key: k, "error": str(e)[:1000], "text": None, "model": None, "attempts": None, "degraded": None})
            yield pd.DataFrame(out, columns=[key, "text", "model", "attempts", "degraded", "error"]).astype({"attempts": "Int64", "degraded": "boolean"})

    return rows.select(key, prompt).mapInPandas(each, f"{key} {kind}, text string, model string, attempts long, degraded boolean, error string")
