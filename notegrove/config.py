"""Settings, errors and row types of the retrieval engine."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import types as T


class GroveError(Exception):
    """Whatever this engine raises on purpose."""


class ConfigError(GroveError, ValueError):
    """A setting outside its range."""


class StorageError(GroveError):
    """A snapshot that can't be read or written."""


class IndexError_(GroveError):
    """An index run that failed."""


class EmbeddingError(IndexError_):
    """A provider that failed for good."""


class SearchError(GroveError):
    """A search that failed."""


class StrategyError(SearchError):
    """A strategy that isn't known or can't run."""


class VectorsUnavailable(StrategyError):
    """Vector search without a provider or with vectors switched off."""


class FlushError(GroveError):
    """An extraction that failed."""


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class EmbeddingConfig:
    model: str = "text-embedding-3-small"
    api_base: str | None = None
    api_key: str | None = None
    timeout: float = 60.0
    batch_size: int = 64
    #: Requests that one task has under way at a time.
    concurrency: int = 1

    def __post_init__(self) -> None:
        _require(self.timeout > 0 and self.batch_size > 0 and self.concurrency > 0, "timeout, batch_size and concurrency must be above 0")


@dataclass(frozen=True)
class ChunkingConfig:
    tokens: int = 400
    overlap: int = 80

    def __post_init__(self) -> None:
        _require(self.tokens > 0 and 0 <= self.overlap < self.tokens, "0 <= overlap < tokens must hold")

    @property
    def max_chars(self) -> int:
        return max(32, 4 * self.tokens)

    @property
    def overlap_chars(self) -> int:
        return max(0, 4 * self.overlap)


@dataclass(frozen=True)
class HybridConfig:
    vector_weight: float = 0.7
    text_weight: float = 0.3
    candidate_multiplier: int = 4

    def __post_init__(self) -> None:
        _require(0 <= self.vector_weight <= 1 and 0 <= self.text_weight <= 1, "weights must lie in [0, 1]")
        _require(abs(self.vector_weight + self.text_weight - 1) <= 1e-6, "weights must sum to 1")
        _require(self.candidate_multiplier > 0, "candidate_multiplier must be above 0")


@dataclass(frozen=True)
class MMRConfig:
    enabled: bool = False
    lambda_param: float = 0.7

    def __post_init__(self) -> None:
        _require(0 <= self.lambda_param <= 1, "lambda_param must lie in [0, 1]")


@dataclass(frozen=True)
class DecayConfig:
    enabled: bool = False
    half_life_days: float = 30.0

    def __post_init__(self) -> None:
        _require(self.half_life_days > 0, "half_life_days must be above 0")


@dataclass(frozen=True)
class QueryConfig:
    strategy: str = "hybrid"
    max_results: int = 6
    min_score: float = 0.35
    snippet_max_chars: int = 700
    hybrid: HybridConfig = field(default_factory=HybridConfig)
    mmr: MMRConfig = field(default_factory=MMRConfig)
    temporal_decay: DecayConfig = field(default_factory=DecayConfig)

    def __post_init__(self) -> None:
        _require(self.max_results > 0 and self.snippet_max_chars > 0 and 0 <= self.min_score <= 1, "max_results, snippet_max_chars or min_score out of range")


@dataclass(frozen=True)
class CacheConfig:
    enabled: bool = True
    max_entries: int | None = None

    def __post_init__(self) -> None:
        _require(self.max_entries is None or self.max_entries > 0, "max_entries must be None or above 0")


@dataclass(frozen=True)
class SyncConfig:
    on_search: bool = True
    watch_debounce_ms: int = 1500

    def __post_init__(self) -> None:
        _require(self.watch_debounce_ms >= 0, "watch_debounce_ms must not be negative")


@dataclass(frozen=True)
class FlushConfig:
    enabled: bool = True
    model: str = "gpt-4o-mini"
    max_tokens: int = 1024
    temperature: float = 0.0
    system_prompt: str | None = None
    api_base: str | None = None
    api_key: str | None = None

    def __post_init__(self) -> None:
        _require(self.max_tokens > 0 and 0 <= self.temperature <= 2, "max_tokens or temperature out of range")


@dataclass(frozen=True)
class EngineConfig:
    workspace_dir: str = "."
    snapshot_dir: str | None = None
    timezone: str = "UTC"
    extra_paths: tuple[str, ...] = ()
    evergreen_patterns: tuple[str, ...] = ("MEMORY.md",)
    vectors: bool = True
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    query: QueryConfig = field(default_factory=QueryConfig)
    cache: CacheConfig = field(default_factory=CacheConfig)
    sync: SyncConfig = field(default_factory=SyncConfig)
    flush: FlushConfig = field(default_factory=FlushConfig)

    def __post_init__(self) -> None:
        try:
            ZoneInfo(self.timezone)
        except (KeyError, ValueError, OSError) as e:
            raise ConfigError(f"no such time zone: {self.timezone}") from e

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> EngineConfig:
        return _build(cls, values)


_PARTS = {"embedding": EmbeddingConfig, "chunking": ChunkingConfig, "query": QueryConfig, "cache": CacheConfig, "sync": SyncConfig, "flush": FlushConfig, "hybrid": HybridConfig, "mmr": MMRConfig, "temporal_decay": DecayConfig}


def _build(cls: type, values: dict):
    known = {f.name for f in dataclasses.fields(cls)}
    unknown = values.keys() - known
    _require(not unknown, f"unknown settings: {sorted(unknown)}")
    made = {k: _build(_PARTS[k], v) if k in _PARTS and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return cls(**made)


def finite(value: float) -> bool:
    return isinstance(value, (int, float)) and math.isfinite(value)


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "array<double>": T.ArrayType(T.DoubleType()), "array<float>": T.ArrayType(T.FloatType())}


def _struct(fields: str) -> T.StructType:
    """A row type from 'name type, …', which needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


FILES = _struct("path string, source string, hash string, mtime double, size long")
CHUNKS = _struct("chunk_id string, path string, source string, start_line int, end_line int, hash string, model string, text string, embedding array<float>, updated_at long")
POSTINGS = _struct("path string, term string, chunk_id string, dl int, pos int")
GONE = _struct("path string")
CACHE = _struct("provider string, model string, provider_key string, hash string, embedding array<double>, dims int, updated_at long")
META = _struct("key string, value string")
CANDIDATES = _struct("query_id string, chunk_id string, path string, source string, start_line int, end_line int, text string, score double, vector_score double, text_score double")
RESULTS = _struct("query_id string, rank int, path string, start_line int, end_line int, score double, snippet string, source string, vector_score double, text_score double")
