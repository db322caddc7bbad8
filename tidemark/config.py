"""Policies as frozen dataclasses; they become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field

NOW = "2024-02-01 00:00:00"
KINDS = ("fact", "decision", "episode", "code")
AUTHORITY = {"fact": 0.8, "decision": 0.9, "episode": 0.6, "code": 0.7}
HALF_LIFE_DAYS = {"fact": 180.0, "decision": 365.0, "episode": 30.0, "code": 21.0}
UNKNOWN_HALF_LIFE = 90.0
MODES = tuple("direct cautious ask_clarification search_more refuse_guess".split())
SUGGESTIONS = {
    "direct": "The evidence is strong: answer from it as it stands.",
    "cautious": "The evidence is partial: answer with caveats and name the entry behind each claim.",
    "ask_clarification": "Entries contradict each other: ask one clarifying question first.",
    "search_more": "The evidence is thin: look further before answering.",
    "refuse_guess": "Nothing reliable is stored: say that it isn't known.",
}


@dataclass(frozen=True)
class ConfidencePolicy:
    direct: float = 0.70
    cautious: float = 0.50
    search: float = 0.20
    strong: float = 0.35
    max_sources: int = 3
    #: of similarity, sources, agreement, recency, authority and the absence of conflict
    weights: tuple[float, ...] = (0.30, 0.15, 0.15, 0.10, 0.15, 0.15)
    half_life: dict[str, float] = field(default_factory=lambda: dict(HALF_LIFE_DAYS))


@dataclass(frozen=True)
class RetrievalConfig:
    rrf_k: int = 60
    w_bm25: float = 1.0
    w_dense: float = 1.0
    rerank: int = 24
    k_bm25: int = 24
    k_dense: int = 24
    top_k: int = 6


@dataclass(frozen=True)
class PackPolicy:
    budget: int = 2000
    floor: float = 0.30
    same: float = 0.85


@dataclass(frozen=True)
class CachePolicy:
    threshold: float = 0.90
    ttl_days: int = 7


VERDICTS = CachePolicy()
ANSWERS = CachePolicy(0.93, 3)
BM25_K1, BM25_B, SQUASH = 1.5, 0.75, 4.0
CHUNK_SIZE, CHUNK_OVERLAP = 1600, 200
