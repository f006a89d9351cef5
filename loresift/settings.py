"""Settings from TOML: every part of the engine's configuration as checked dataclasses."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .operators.chunk import Chunking
from .operators.clean import PageCleaning
from .operators.context import Budget
from .operators.generate import Endpoint
from .operators.retrieve import BM25, TOKENIZERS, Fusion, ResultStages
from .sources.files import Scan
from .sources.stores import REPOSITORIES


class SettingsError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class Index:
    path: str = "data/indexes"
    chunker: str = "section_aware"
    provider: str = "mock"
    model: str = "mock-hash-embedding"
    dimension: int = 16
    skip_existing: bool = True
    fail_on_blank: bool = True
    document_store: str = "parquet"
    chunk_store: str = "parquet"
    vector_store: str = "parquet"

    def stores(self) -> dict[str, str]:
        return {"documents": self.document_store, "chunks": self.chunk_store, "vectors": self.vector_store}

    def __post_init__(self):
        for name, kind in self.stores().items():
            if kind not in REPOSITORIES[name]:
                raise ValueError(f"no store {kind!r} for {name}; there are {', '.join(REPOSITORIES[name])}")


@dataclass(frozen=True)
class Reports:
    """Where reports of builds, searches and comparisons go (nowhere if blank), and what they show of texts."""

    path: str = ""
    text: bool = False
    preview: int = 160

    def __post_init__(self):
        if self.preview <= 0:
            raise ValueError("a preview needs a positive length")


@dataclass(frozen=True)
class Answering:
    client: str = "mock"
    planner: str = "rule_based"
    max_additional: int = 0
    invalid: str = "fail_closed"
    language: str = "English"

    def __post_init__(self):
        if self.invalid not in ("fail_closed", "abstain"):
            raise ValueError(f"invalid must be fail_closed or abstain, not {self.invalid}")


@dataclass(frozen=True)
class Experiment:
    retriever: str = "vector"
    top_k: int = 5
    reranking: bool = False


@dataclass(frozen=True)
class Settings:
    """One section per part; missing sections and fields take their defaults, unknown ones are refused."""

    allowed: tuple[str, ...] = ("data/raw",)
    retriever: str = "vector"
    tokenizer: str = "regex"
    scan: Scan = field(default_factory=Scan)
    pages: PageCleaning = field(default_factory=PageCleaning)
    chunking: Chunking = field(default_factory=Chunking)
    index: Index = field(default_factory=Index)
    bm25: BM25 = field(default_factory=BM25)
    hybrid: Fusion = field(default_factory=Fusion)
    results: ResultStages = field(default_factory=ResultStages)
    context: Budget = field(default_factory=Budget)
    answering: Answering = field(default_factory=Answering)
    model: Endpoint = field(default_factory=Endpoint)
    reports: Reports = field(default_factory=Reports)
    experiments: dict[str, Experiment] = field(default_factory=dict)

    def __post_init__(self):
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"no tokenizer {self.tokenizer!r}; there are {', '.join(TOKENIZERS)}")

    @classmethod
    def load(cls, path: str | Path | None) -> Settings:
        """Settings of a file; without one, the defaults."""
        if path is None or not Path(path).exists():
            return cls()
        try:
            return cls.of(tomllib.loads(Path(path).read_text()))
        except (tomllib.TOMLDecodeError, TypeError, ValueError) as e:
            raise SettingsError(f"INVALID_CONFIG: {path}: {e}") from e

    @classmethod
    def of(cls, data: dict) -> Settings:
        kinds = {f.name: f.default_factory for f in fields(cls) if isinstance(f.default_factory, type) and f.default_factory is not dict}
        values = {}
        for key, value in data.items():
            if key == "experiments":
                values[key] = {n: Experiment(**v) for n, v in value.items()}
            elif key in kinds:
                values[key] = kinds[key](**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
            else:
                values[key] = tuple(value) if isinstance(value, list) else value
        return cls(**values)
