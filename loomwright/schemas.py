"""Schemas of the engine's tables, and settings with their checks."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field, replace
from typing import Any

META = "map<string,string>"
DOCUMENTS = f"path string, metadata {META}, content string"
CHUNKS = f"doc_id string, chunk_no int, chunk_id string, content string, chunk_type string, heading string, start_index int, end_index int, metadata {META}"
#: Hot metadata keys are columns, so that filters on them reach the Parquet scan.
HOT_KEYS = ("title", "url", "domain", "heading", "chunk_type", "component")
INDEX = "id string, content string, embedding array<float>, " + ", ".join(f"{k} string" for k in HOT_KEYS) + f", meta {META}"
QUERIES = "query_id long, question string, top_k int, domain string"
CRAWL_STATE = f"url string, content_hash string, last_crawled timestamp, output_file string, metadata {META}"
CRAWL_SOURCES = "name string, start_url string, allowed_domains array<string>, url_patterns array<string>, exclude_patterns array<string>, max_depth int"
CHAT = "conv_id long, turn long, role string, content string"


def _between(name: str, value: float | None, low: float, high: float) -> None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be from {low:g} to {high:g}")


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 5
    score_threshold: float | None = None
    rerank: bool = False
    diversity_factor: float = 0.0
    filters: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.top_k <= 0:
            raise ValueError("top_k must be above 0")
        _between("score_threshold", self.score_threshold, 0, 1)
        _between("diversity_factor", self.diversity_factor, 0, 1)

    def with_call(self, top_k: int | None = None, filters: dict | None = None) -> RetrievalSettings:
        """Settings of one call: its top_k, and its filters over the configured ones."""
        return replace(self, top_k=top_k or self.top_k, filters={**self.filters, **(filters or {})})


@dataclass(frozen=True)
class EmbeddingSettings:
    model_name: str = "hashed-words"
    dimensions: int = 64
    max_tokens: int = 512
    batch_size: int = 32
    normalize: bool = True

    def __post_init__(self):
        if self.dimensions <= 0 or self.batch_size <= 0:
            raise ValueError("dimensions and batch_size must be above 0")


@dataclass(frozen=True)
class LLMSettings:
    model_name: str = "extractive"
    temperature: float = 0.7
    max_tokens: int = 2048
    top_p: float = 1.0
    top_k: int | None = None
    stop_sequences: tuple[str, ...] = ()

    def __post_init__(self):
        _between("temperature", self.temperature, 0, 1)
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be above 0")

    def request(self) -> dict[str, Any]:
        """Parameters of a request; those at their neutral value are left out."""
        out = {"model": self.model_name, "max_tokens": self.max_tokens, "temperature": self.temperature}
        return out | ({"top_p": self.top_p} if self.top_p != 1.0 else {}) | ({"top_k": self.top_k} if self.top_k else {}) | ({"stop_sequences": list(self.stop_sequences)} if self.stop_sequences else {})


def resolve(settings: dict[str, Any]) -> dict[str, Any]:
    """Values that are `${NAME}` as a whole become that environment variable, or None."""
    out = {}
    for key, value in settings.items():
        if isinstance(value, dict):
            value = resolve(value)
        elif isinstance(value, str) and (m := re.fullmatch(r"\$\{([^}]+)\}", value)):
            value = os.environ.get(m[1])
        out[key] = value
    return out


def merged(kind: type, *layers: dict[str, Any] | None, **last: Any):
    """Settings of a kind: its defaults, then each layer, then keywords; unknown names fail."""
    values: dict[str, Any] = {}
    for layer in (*layers, last):
        values |= {k: v for k, v in resolve(layer or {}).items() if v is not None}
    return kind(**values)


def echo(settings: Any) -> dict[str, Any]:
    return asdict(settings)
