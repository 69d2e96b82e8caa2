"""Settings of an index and its search."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class SearchConfig:
    """entry: "box" starts from the members of the query's box, "random" from random rows. projected: search in principal components. graph: "exact" compares all pairs, "descent" doesn't.

    topk 0 stands for n_candidates, the beam's length.
    """

    entry: str = "box"
    projected: bool = True
    dims: int = 64
    degree: int = 64
    n_candidates: int = 128
    topk: int = 0
    search_width: int = 1
    max_iter: int = 100
    point_ratio: float = 0.000128
    expand_ratio: float = 0.2
    rerank: bool = False
    graph: str = "exact"

    def __post_init__(self) -> None:
        if self.entry not in ("box", "random"):
            raise ValueError("entry is box or random")
        if self.graph not in ("exact", "descent"):
            raise ValueError("graph is exact or descent")
        if self.entry == "box" and not self.projected:
            raise ValueError("boxes are made of principal components")
        if min(self.dims, self.degree, self.n_candidates, self.search_width) < 1 or self.max_iter < 0 or self.topk < 0:
            raise ValueError("sizes must be positive")

    @property
    def k(self) -> int:
        return self.topk or self.n_candidates

    @classmethod
    def algorithm(cls, number: int, **settings) -> SearchConfig:
        """By number: 0 random entries in the vectors themselves, 1 box entries in components, 2 random entries in components."""
        entry, projected = {0: ("random", False), 1: ("box", True), 2: ("random", True)}[number]
        return cls(entry=entry, projected=projected, **settings)

    def key(self, *more: str) -> str:
        """A name for what is built from these settings and inputs."""
        return hashlib.sha256(json.dumps([asdict(self), *more], sort_keys=True).encode()).hexdigest()[:16]
