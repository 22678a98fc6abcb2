"""Ranking configuration: weights, strategies and what interactions are worth."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields
from enum import Enum


class Policy(str, Enum):
    """Where a strategy takes its candidates from."""

    AFFINITY = "affinity_first"
    POPULARITY = "popularity"
    FRESHNESS = "freshness"
    VECTOR = "vector_similarity"
    TOGETHER = "co_occurrence"


@dataclass(frozen=True)
class Weights:
    popularity: float
    category: float
    tag: float
    brand: float
    freshness: float
    repetition_penalty: float
    similarity: float = 0.0
    cooccurrence: float = 0.0

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if not (isinstance(v, (int, float)) and math.isfinite(v) and v >= 0):
                raise ValueError(f"weight {f.name} must be a finite number of at least 0")


@dataclass(frozen=True)
class Strategy:
    label: str
    policy: Policy
    weights: Weights
    top_k: int | None = None

    @property
    def needs_seed(self) -> bool:
        return self.policy in (Policy.VECTOR, Policy.TOGETHER)


@dataclass(frozen=True)
class Bump:
    """What one interaction adds to the affinity for a category, a tag and a brand."""

    category: float
    tag: float
    brand: float


# The default weights, bumps and constants that define the results.
DEFAULT_WEIGHTS = Weights(0.40, 0.20, 0.15, 0.10, 0.10, 0.25)
STRATEGIES = {
    "for_you": Strategy("Recommended for you", Policy.AFFINITY, DEFAULT_WEIGHTS),
    "trending": Strategy("Trending now", Policy.POPULARITY, Weights(0.80, 0.05, 0.04, 0.03, 0.08, 0.25)),
    "new_arrivals": Strategy("New arrivals", Policy.FRESHNESS, Weights(0.15, 0.05, 0.04, 0.03, 0.70, 0.25)),
    "similar_items": Strategy("Similar items", Policy.VECTOR, Weights(0.20, 0.05, 0.04, 0.03, 0.05, 0.25, similarity=0.60)),
    "because_viewed": Strategy("Because you viewed this", Policy.VECTOR, Weights(0.10, 0.12, 0.08, 0.06, 0.04, 0.25, similarity=0.55)),
    "also_bought": Strategy("Also bought", Policy.TOGETHER, Weights(0.15, 0.05, 0.04, 0.03, 0.03, 0.25, cooccurrence=0.70)),
    "frequently_bought_together": Strategy(
        "Frequently bought together", Policy.TOGETHER, Weights(0.08, 0.04, 0.03, 0.02, 0.02, 0.25, cooccurrence=0.80), top_k=3
    ),
}
BUMPS = {
    "click": Bump(0.10, 0.05, 0.08),
    "view": Bump(0.02, 0.01, 0.02),
    "favorite": Bump(0.20, 0.10, 0.15),
    "cart": Bump(0.25, 0.12, 0.20),
}
EVENT_WEIGHTS = {"click": 1.0, "view": 0.2, "favorite": 3.0, "cart": 4.0}
#: Words of a query that say nothing about what is sought (fixed values).
STOP_WORDS = ("a", "an", "and", "at", "for", "from", "in", "is", "it", "my", "of", "on", "that", "the", "to", "up", "with")
RRF_K = 60
COSINE_FLOOR = 0.4
RETRIEVAL_WEIGHT = 0.2
RECENT_CAP = 50
NEIGHBOURS = 10
SCHEMA_VERSION = 3


@dataclass(frozen=True)
class RankingConfig:
    schema_version: int = SCHEMA_VERSION
    weights: Weights = DEFAULT_WEIGHTS
    bumps: dict[str, Bump] = field(default_factory=lambda: dict(BUMPS))
    strategies: dict[str, Strategy] = field(default_factory=lambda: dict(STRATEGIES))

    def strategy(self, name: str) -> Strategy:
        if name not in self.strategies:
            raise KeyError(f"no strategy {name!r}; there are {', '.join(sorted(self.strategies))}")
        return self.strategies[name]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "RankingConfig":
        """Absent optional parts take their defaults; a malformed part raises ``ValueError``."""
        try:
            raw = json.loads(text)
            base = RankingConfig()
            return RankingConfig(
                schema_version=int(raw.get("schema_version", 1)),
                weights=Weights(**raw["weights"]) if "weights" in raw else base.weights,
                bumps=base.bumps | {k: Bump(**v) for k, v in raw.get("bumps", {}).items()},
                strategies=base.strategies
                | {
                    k: Strategy(v["label"], Policy(v["policy"]), Weights(**v["weights"]), v.get("top_k"))
                    for k, v in raw.get("strategies", {}).items()
                },
            )
        except (TypeError, KeyError, AttributeError, json.JSONDecodeError) as error:
            raise ValueError(f"malformed ranking configuration: {error}") from error
