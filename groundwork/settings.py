"""Configuration: immutable records with bounds, YAML files with one level of ``extends``."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any, get_type_hints

#: Kept for reference runs; nothing here draws from a global generator.
DEFAULT_SEED = 42


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _one_of(value: str, name: str, *allowed: str) -> None:
    _need(value in allowed, f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class Corpus:
    name: str
    path: str


@dataclass(frozen=True)
class Chunking:
    strategy: str
    chunk_size: int
    chunk_overlap: int

    def __post_init__(self):
        _one_of(self.strategy, "strategy", "fixed", "recursive", "semantic")
        _need(self.chunk_size > 0 and self.chunk_overlap >= 0, "chunk_size must be positive and chunk_overlap not negative")
        _need(self.chunk_overlap < self.chunk_size, "chunk_overlap must be smaller than chunk_size")


@dataclass(frozen=True)
class Embedder:
    backend: str
    model: str
    dim: int

    def __post_init__(self):
        _one_of(self.backend, "embedder.backend", "hashing", "sentence-transformers")
        _need(self.dim > 0, "dim must be positive")


@dataclass(frozen=True)
class VectorStore:
    backend: str

    def __post_init__(self):
        _one_of(self.backend, "vector_store.backend", "memory", "qdrant")


@dataclass(frozen=True)
class Toggle:
    enabled: bool


@dataclass(frozen=True)
class Fusion:
    method: str
    rrf_k: int

    def __post_init__(self):
        _one_of(self.method, "fusion.method", "rrf")
        _need(self.rrf_k > 0, "rrf_k must be positive")


@dataclass(frozen=True)
class Rerank:
    enabled: bool
    backend: str
    model: str

    def __post_init__(self):
        _one_of(self.backend, "rerank.backend", "lexical", "cross-encoder")


@dataclass(frozen=True)
class Retrieval:
    candidate_k: int
    top_k: int
    bm25: Toggle
    dense: Toggle
    fusion: Fusion
    rerank: Rerank
    mode: str = "standard"

    def __post_init__(self):
        _one_of(self.mode, "retrieval.mode", "standard", "oracle")
        _need(self.candidate_k > 0 and self.top_k > 0, "candidate_k and top_k must be positive")


@dataclass(frozen=True)
class Generation:
    provider: str
    model: str
    max_context_chunks: int
    abstain_threshold: float

    def __post_init__(self):
        _one_of(self.provider, "generation.provider", "offline", "anthropic", "openai")
        _need(self.max_context_chunks > 0 and self.abstain_threshold >= 0, "max_context_chunks must be positive and abstain_threshold not negative")


@dataclass(frozen=True)
class Metrics:
    k_values: tuple[int, ...]


@dataclass(frozen=True)
class Judge:
    provider: str
    model: str

    def __post_init__(self):
        _one_of(self.provider, "judge.provider", "offline", "anthropic", "openai")


@dataclass(frozen=True)
class Bootstrap:
    iterations: int
    confidence: float

    def __post_init__(self):
        _need(self.iterations > 0 and 0 < self.confidence < 1, "iterations must be positive and confidence between 0 and 1")


@dataclass(frozen=True)
class Smoke:
    max_questions: int

    def __post_init__(self):
        _need(self.max_questions > 0, "max_questions must be positive")


@dataclass(frozen=True)
class Latency:
    """So many questions of a variant are asked one by one, to time them."""

    max_questions: int = 20

    def __post_init__(self):
        _need(self.max_questions >= 0, "latency.max_questions must not be negative")


@dataclass(frozen=True)
class Eval:
    metrics: Metrics
    judge: Judge
    bootstrap: Bootstrap
    smoke: Smoke
    latency: Latency = Latency()


@dataclass(frozen=True)
class Settings:
    name: str
    seed: int
    corpus: Corpus
    chunking: Chunking
    embedder: Embedder
    vector_store: VectorStore
    retrieval: Retrieval
    generation: Generation
    eval: Eval

    def __post_init__(self):
        same = self.generation.provider == self.eval.judge.provider and self.generation.model == self.eval.judge.model
        _need(self.generation.provider == "offline" or not same, "the judge's model must differ from the generator's, or it would prefer its own answers")

    def signature(self) -> str:
        """Names an index: what determines its contents, not the store or how it is searched."""
        parts = {k: dataclasses.asdict(getattr(self, k)) for k in ("corpus", "chunking", "embedder")}
        return hashlib.blake2b(json.dumps(parts, sort_keys=True).encode(), digest_size=8).hexdigest()


def _build(kind: type, raw: dict[str, Any], where: str = "") -> Any:
    hints = get_type_hints(kind)
    values: dict[str, Any] = {}
    for f in dataclasses.fields(kind):
        name = f"{where}{f.name}"
        if f.name not in raw:
            if f.default is dataclasses.MISSING:
                raise ValueError(f"{name} is missing")
            continue
        value, hint = raw[f.name], hints[f.name]
        if dataclasses.is_dataclass(hint):
            _need(isinstance(value, dict), f"{name} must be a mapping")
            value = _build(hint, value, f"{name}.")
        elif hint is bool:
            _need(isinstance(value, bool), f"{name} must be true or false")
        elif hint in (int, float, str):
            _need(not isinstance(value, (bool, dict, list)) and value is not None, f"{name} must be of type {hint.__name__}")
            value = hint(value)
        else:
            value = tuple(int(x) for x in value)
        values[f.name] = value
    return kind(**values)


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``over`` laid on ``base``, mapping by mapping; neither changes."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return base | both


def from_dict(raw: dict[str, Any]) -> Settings:
    return _build(Settings, raw)


def load(path: str | Path) -> Settings:
    """Read a YAML file; its ``extends`` names a file of the same folder or the one above, whose own ``extends`` is ignored."""
    import yaml

    path = Path(path)
    raw = yaml.safe_load(path.read_text())
    if (parent := raw.pop("extends", None)) is not None:
        places = [folder / f"{parent}.yaml" for folder in (path.parent, path.parent.parent)]
        found = next((p for p in places if p.exists()), None)
        if found is None:
            raise FileNotFoundError(f"{parent}.yaml, which {path} extends, isn't near it")
        base = yaml.safe_load(found.read_text())
        base.pop("extends", None)
        raw = merged(base, raw)
    return from_dict(raw)


#: What a file need not repeat.
BASE: dict[str, Any] = {
    "name": "base",
    "seed": DEFAULT_SEED,
    "corpus": {"name": "sample", "path": "data/sample"},
    "chunking": {"strategy": "recursive", "chunk_size": 256, "chunk_overlap": 32},
    "embedder": {"backend": "hashing", "model": "BAAI/bge-base-en-v1.5", "dim": 256},
    "vector_store": {"backend": "memory"},
    "retrieval": {
        "candidate_k": 20,
        "top_k": 5,
        "bm25": {"enabled": True},
        "dense": {"enabled": True},
        "fusion": {"method": "rrf", "rrf_k": 60},
        "rerank": {"enabled": True, "backend": "lexical", "model": "cross-encoder/ms-marco-MiniLM-L-6-v2"},
    },
    "generation": {"provider": "offline", "model": "none", "max_context_chunks": 5, "abstain_threshold": 0.15},
    "eval": {
        "metrics": {"k_values": [1, 3, 5, 10]},
        "judge": {"provider": "offline", "model": "none"},
        "bootstrap": {"iterations": 1000, "confidence": 0.95},
        "smoke": {"max_questions": 20},
        "latency": {"max_questions": 20},
    },
}


def _variant(name: str, bm25: bool, dense: bool, rerank: bool, mode: str = "standard") -> Settings:
    over = {"name": name, "retrieval": {"bm25": {"enabled": bm25}, "dense": {"enabled": dense}, "rerank": {"enabled": rerank}, "mode": mode}}
    return from_dict(merged(BASE, over))


#: The five pipelines that an ablation compares, in the order of its tables.
VARIANTS = (
    _variant("closed_book", False, False, False),
    _variant("dense_only", False, True, False),
    _variant("hybrid", True, True, False),
    _variant("hybrid_rerank", True, True, True),
    _variant("oracle", True, True, False, "oracle"),
)
