"""Configurations of an index and a retrieval, their checks and fingerprints."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

from .split_plan import parse

EMBEDDERS = ("ascii-hash", "token-hash", "char-hash")
GROUPINGS = ("", "label-prop", "kmeans", "raptor", "metadata")
GRAPHS = ("hybrid", "knn", "lexical")
RETRIEVERS = ("hybrid-rrf", "dense", "bm25")
RERANKERS = ("none", "lexical", "recency", "agentic", "cross-encoder", "llm")
SCOPES = ("mixed", "leaves", "summaries", "drill-down")
SUMMARISERS = ("centroid", "lead-idf", "mmr", "card")


def canonical(value) -> str:
    """JSON with sorted keys and no white space; numbers that are not finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value, digits: int = 16) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:digits]


@dataclass(frozen=True)
class IndexConfig:
    dataset: str = ""
    split_plan: str = "document"
    chunk_chars: int = 500
    overlap: int = 0
    part_join: str = "\n"
    part_prefix: str = ""
    contextual: bool = True
    embedder: str = "ascii-hash"
    hierarchy: str = ""
    graph_source: str = "hybrid"
    graph_knn: int = 8
    granularity: float = 1.0
    hierarchy_levels: int = 1
    min_group: int = 3
    summarizer: str = "centroid"

    def problems(self) -> list[str]:
        out = []
        try:
            parse(self.split_plan)
        except ValueError as e:
            out.append(str(e))
        if self.chunk_chars < 1:
            out.append("chunk_chars must be positive")
        if self.overlap < 0:
            out.append("overlap must not be negative")
        for name, allowed in (("embedder", EMBEDDERS), ("hierarchy", GROUPINGS), ("graph_source", GRAPHS), ("summarizer", SUMMARISERS)):
            if getattr(self, name) not in allowed:
                out.append(f"{name} is unknown or not available here: {getattr(self, name)!r}")
        if self.hierarchy_levels < 1 or self.min_group < 1 or self.graph_knn < 1:
            out.append("hierarchy_levels, min_group and graph_knn must be positive")
        if self.hierarchy == "metadata" and self.hierarchy_levels > 1:
            out.append("metadata groups have one level")
        if self.granularity <= 0:
            out.append("granularity must be positive")
        return out

    def effective(self) -> dict:
        """The fields that the index depends on: those that the others leave without effect are gone."""
        kept = dataclasses.asdict(self)
        default = dataclasses.asdict(IndexConfig())
        for name in ("part_join", "part_prefix", "dataset"):
            if kept[name] == default[name]:
                del kept[name]
        gone = set()
        if not self.hierarchy:
            gone |= {"graph_source", "graph_knn", "granularity", "hierarchy_levels", "min_group", "summarizer"}
        elif self.hierarchy != "label-prop":
            gone |= {"graph_source", "graph_knn"}
        if self.graph_source == "lexical":
            gone.add("graph_knn")
        if self.hierarchy in ("label-prop", "metadata"):
            gone.add("granularity")
        return {k: v for k, v in kept.items() if k not in gone}

    def fingerprint(self) -> str:
        return fingerprint(self.effective(), 12)


@dataclass(frozen=True)
class RetrievalConfig:
    retriever: str = "hybrid-rrf"
    k: int = 8
    candidates: int = 40
    rrf_k: int = 60
    multi_query: bool = True
    mmr_lambda: float = 1.0
    reranker: str = "lexical"
    rerank_depth: int = 20
    recency_half_life_days: float = 180
    agentic_weights: tuple[float, float, float] = (1.0, 0.3, 0.2)
    grade_threshold: float = 0.0
    max_context_chars: int = 6000
    time_filter: bool = False
    summary_scope: str = "mixed"
    summary_boost: float = 1.0
    summary_levels: tuple[int, ...] = field(default=())

    def problems(self) -> list[str]:
        out = []
        for name, allowed in (("retriever", RETRIEVERS), ("reranker", RERANKERS), ("summary_scope", SCOPES)):
            if getattr(self, name) not in allowed:
                out.append(f"{name} is unknown: {getattr(self, name)!r}")
        for name in ("k", "candidates", "rrf_k", "rerank_depth", "max_context_chars"):
            if getattr(self, name) < 1:
                out.append(f"{name} must be positive")
        if not 0 <= self.mmr_lambda <= 1:
            out.append("mmr_lambda must be from 0 to 1")
        if self.summary_boost <= 0 or any(x < 1 for x in self.summary_levels):
            out.append("summary_boost and summary_levels must be positive")
        return out


#: A configuration for daily use.
PRODUCTION = (IndexConfig(split_plan="document / part over-budget"), RetrievalConfig(grade_threshold=0.4))
