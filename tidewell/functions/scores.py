"""Scores, labels and gates on retrieval results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.config import DEFAULT

# fixed values: upper bounds (exclusive) and what they stand for
CONFIDENCE = [(0.3, 0.95), (0.5, 0.85), (0.8, 0.70), (1.2, 0.50)]
CONFIDENCE_BEYOND, CONFIDENCE_NONE = 0.30, 0.0
RELEVANCE = [(0.3, "Highly Relevant"), (0.6, "Relevant"), (1.0, "Moderately Relevant")]
RELEVANCE_BEYOND = "Less Relevant"


def _steps(x: Column, steps: list, beyond) -> Column:
    out = F.lit(beyond)
    for bound, value in reversed(steps):
        out = F.when(x < bound, F.lit(value)).otherwise(out)
    return out


def confidence(mean_distance: Column) -> Column:
    """Of the mean distance of the best three hits (a missing distance counts 1); null mean: no hits."""
    return F.when(mean_distance.isNull(), F.lit(CONFIDENCE_NONE)).otherwise(_steps(mean_distance, CONFIDENCE, CONFIDENCE_BEYOND))


def relevance(distance: Column) -> Column:
    return _steps(F.coalesce(distance, F.lit(1.0)), RELEVANCE, RELEVANCE_BEYOND)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """1 where all values are equal (one value included)."""
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low))


def rrf(rank: Column, k: int = DEFAULT.rrf_k, missing: int = DEFAULT.missing_rank) -> Column:
    return F.lit(1.0) / (F.lit(k) + F.coalesce(rank, F.lit(missing)))
