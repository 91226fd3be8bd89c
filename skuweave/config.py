"""Parameters of a matching run, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MatchConfig:
    """threshold and limit (0: all) hold for each query. min_threshold is the floor of visual and hybrid scores. overfetch:
    how many times the limit each arm of a hybrid match gets; None merges all pairs. score_scale: see functions.vectors."""

    threshold: float = 0.0
    limit: int = 10
    match_against_all: bool = False
    include_uncategorized: bool = True
    min_threshold: float = 30.0
    feature_weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    metadata_weights: dict[str, float] = field(default_factory=lambda: {"sku": 0.30, "name": 0.30, "category": 0.25, "price": 0.10, "performance": 0.05})
    visual_weight: float = 0.5
    metadata_weight: float = 0.5
    overfetch: int | None = 10
    score_scale: str = "shifted"
    uncategorized_factor: float = 0.90
    distinct_names: bool | None = None

    def __post_init__(self):
        if not 0 <= self.threshold <= 100:
            raise ValueError("threshold must be from 0 to 100")
        if self.limit < 0:
            raise ValueError("limit must be 0 (all) or more")
        for weights in (self.metadata_weights.values(), self.feature_weights, (self.visual_weight, self.metadata_weight)):
            if min(weights) < 0 or not 0.99 <= sum(weights) <= 1.01:
                raise ValueError("weights must be 0 at least and add up to 1")

    @property
    def floor(self) -> float:
        return max(self.threshold, self.min_threshold)
