"""Settings of the engine; every field is honoured somewhere."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # retrieval
    distance_threshold: float = 1.3  # squared Euclidean distance
    hard_cutoff: float = 1.55
    min_results: int = 1
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    bm25_top: int = 50
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    rrf_k: int = 60
    missing_rank: int = 1000
    candidate_factor: int = 10
    # chunking, in estimated tokens
    target_min_tokens: int = 400
    target_max_tokens: int = 600
    hard_max_tokens: int = 800
    hard_min_tokens: int = 150
    overlap_tokens: int = 100
    min_topic_similarity: float = 0.1
    preserve_blocks: bool = False
    block_separator: str = r"\n\s*\n"
    # conversations
    insight_rows: int = 5000
    gap_similarity: float = 0.75
    session_minutes: int = 30
    history_kept: int = 20
    # a table that is broadcast may have so many rows
    broadcast_rows: int = 10_000


DEFAULT = EngineConfig()
