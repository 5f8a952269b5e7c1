"""Embedding providers and their use inside Spark tasks."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from notegrove.config import EmbeddingConfig, EmbeddingError, FlushConfig

RETRIED = {429, 500, 502, 503, 504}
PAUSES = (0.5, 2.0, 8.0)


@runtime_checkable
class EmbeddingProvider(Protocol):
    """name and model identify a provider in cache keys; vectors have length 1."""

    name: str
    model: str
    api_base: str | None

    def embed_query(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def batched(items: list, size: int) -> Iterator[list]:
    """Runs of `size` items, the last one shorter."""
    if size < 1:
        raise ValueError("a batch has at least one item")
    for at in range(0, len(items), size):
        yield items[at : at + size]


def gathered(calls: list[Callable[[], object]], most: int = 1) -> list:
    """Results in order of calls, at most `most` of them under way at a time; the first error in that order is raised."""
    if most < 2 or len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(most, len(calls))) as pool:
        return [f.result() for f in [pool.submit(call) for call in calls]]


def at_length_one(vector: list[float]) -> list[float]:
    array = np.asarray(vector, float)
    length = float(np.linalg.norm(array))
    return (array / length if length else array).tolist()


class HashEmbedder:
    """Words hashed into signed buckets: no network, the same everywhere."""

    def __init__(self, dims: int = 64) -> None:
        self.name, self.model, self.api_base, self.dims = "hash", f"hash-{dims}", None, dims

    def embed_query(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(self.dims)
            for word in re.findall(r"\w+", text.lower()):
                code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                vector[code % self.dims] += 1 if code >> 31 else -1
            out.append(at_length_one(vector))
        return out


class CodePointEmbedder:
    """Eight numbers from the sum of code points, so that SQL can say the same."""

    name, model, api_base = "codepoint", "codepoint-8", None

    def embed_query(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [at_length_one([((sum(map(ord, t)) % 100 + i) % 10) / 10 for i in range(8)]) for t in texts]


def status_of(error: Exception) -> int | None:
    """HTTP status of an error: in its message, else an attribute."""
    found = re.search(r"\b([45]\d\d)\b", str(error))
    if found:
        return int(found[1])
    for name in ("status_code", "code", "http_status"):
        if isinstance(value := getattr(error, name, None), int):
            return value
    return None


def with_retries(call: Callable[[], list], pauses: tuple[float, ...] = PAUSES, sleep: Callable[[float], None] = time.sleep) -> list:
    """As many attempts as pauses; statuses that say the request itself is wrong fail at once."""
    for attempt, pause in enumerate(pauses, 1):
        try:
            return call()
        except Exception as error:
            status = status_of(error)
            if status is not None and status not in RETRIED or attempt == len(pauses):
                raise EmbeddingError(str(error)) from error
            sleep(pause)
    return []


class HttpEmbedder:
    """A service that takes {"model", "input"} and gives {"data": [{"embedding"}]}."""

    name = "http"

    def __init__(self, config: EmbeddingConfig) -> None:
        self.config, self.model, self.api_base = config, config.model, config.api_base

    def embed_query(self, text: str) -> list[float]:
        if not text.strip():
            raise EmbeddingError("an empty query can't be embedded")
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        calls = [lambda part=part: with_retries(lambda: self._post(part)) for part in batched(texts, self.config.batch_size)]
        return [vector for part in gathered(calls, self.config.concurrency) for vector in part]

    def _post(self, texts: list[str]) -> list[list[float]]:
        answer = posted(f"{(self.config.api_base or '').rstrip('/')}/embeddings", {"model": self.model, "input": texts}, self.config.api_key, self.config.timeout)
        return [at_length_one(x["embedding"]) for x in answer["data"]]


def posted(url: str, body: dict, api_key: str | None = None, timeout: float = 60.0) -> dict:
    """The JSON that a service answers."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
        return json.load(answer)


class HttpExtractor:
    """What a chat service makes of messages: takes {"model", "messages", "max_tokens", "temperature"}, gives {"choices": [{"message": {"content"}}]}."""

    def __init__(self, config: FlushConfig) -> None:
        self.config = config

    def __call__(self, messages: list[dict]) -> str | None:
        c = self.config
        body = {"model": c.model, "messages": messages, "max_tokens": c.max_tokens, "temperature": c.temperature}
        answer = with_retries(lambda: [posted(f"{(c.api_base or '').rstrip('/')}/chat/completions", body, c.api_key)])[0]
        return answer["choices"][0]["message"]["content"]


def with_halving(provider: EmbeddingProvider, text: str, least: int = 100) -> list[float] | None:
    """A text that fails whole is cut at the last space of its middle half, and the halves' vectors are averaged."""
    try:
        return provider.embed_batch([text])[0]
    except Exception:
        if len(text) < least:
            return None
    cut = text.rfind(" ", len(text) // 4, 3 * len(text) // 4)
    cut = len(text) // 2 if cut < 0 else cut
    halves = [v for v in (with_halving(provider, text[:cut], least), with_halving(provider, text[cut:], least)) if v]
    if len(halves) < 2:
        return halves[0] if halves else None
    return at_length_one(np.mean(halves, axis=0).tolist())


def embed(texts: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """(hash, embedding) of (hash, text): one provider call for each Arrow batch; null where even halving fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wanted = frame["text"].tolist()
            try:
                vectors = provider.embed_batch(wanted) if wanted else []
            except Exception:
                vectors = [with_halving(provider, t) for t in wanted]
            yield pd.DataFrame({"hash": frame["hash"], "embedding": vectors})

    return texts.select("hash", "text").mapInPandas(run, "hash string, embedding array<double>")
