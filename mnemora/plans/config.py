"""Engine parameters: defaults, TOML loading, path anchoring and range checks."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

DAY = 86_400


@dataclass(frozen=True)
class Weights:
    """Weights of the retrieval score."""

    relevance: float = 0.60
    importance: float = 0.10
    recurrence: float = 0.10
    recency: float = 0.15
    graph: float = 0.05
    pin: float = 0.05
    stale: float = 0.20


@dataclass(frozen=True)
class Spreading:
    enabled: bool = False
    factor: float = 0.15
    max_hops: int = 1
    hop_decay: float = 0.5
    floor: float = 0.01
    seeds: int = 10
    co_occurred: float = 0.8
    semantic_similar: float = 0.6
    sequence: float = 1.0
    inject: bool = False
    max_nodes: int = 12


@dataclass(frozen=True)
class Segment:
    window: int = 8
    predictor: str | Callable[[Any], Any] = "weighted"
    decay: float = 0.5
    tau: int = 16
    gamma: float = 1.0
    radius: int = 3
    min_len: int = 2


@dataclass(frozen=True)
class Neighbors:
    similarity: float = 0.60
    surprise_max: float = 0.45
    saturation: float = 8.0
    tight: float = 0.15
    wide: float = 0.40
    habit_density: float = 0.35


@dataclass(frozen=True)
class Consolidation:
    duplicate: float = 0.92
    cluster_min: int = 3
    promote_access: int = 3
    archive_max_decay: float = 0.05
    sample: int = 5
    foundation_spread: float = 0.5
    foundation_neighbors: int = 4
    burst: bool = True
    burst_min: int = 4
    topics: bool = True
    topic_similarity: float = 0.6
    epoch_min: int = 4
    epoch_min_days: float = 5.0
    archive_after_days: int = 14
    delete_after_days: int = 90


@dataclass(frozen=True)
class Contradiction:
    enabled: bool = False
    min_similarity: float = 0.80
    confidence: float = 0.7


@dataclass(frozen=True)
class Chat:
    top_k: int = 6
    history: int = 8
    context_turns: int = 2
    gate: float = 0.25
    damping: float = 0.6


@dataclass(frozen=True)
class Config:
    root: str = "memory"
    dim: int = 256
    weights: Weights = field(default_factory=Weights)
    spreading: Spreading = field(default_factory=Spreading)
    segment: Segment = field(default_factory=Segment)
    neighbors: Neighbors = field(default_factory=Neighbors)
    consolidation: Consolidation = field(default_factory=Consolidation)
    contradiction: Contradiction = field(default_factory=Contradiction)
    chat: Chat = field(default_factory=Chat)
    decay: dict[str, float] = field(default_factory=lambda: dict(LAMBDA))
    edge_decay: float = 0.02
    edge_min_weight: float = 0.1
    salience_resist: float = 0.7
    salience_keep: float = 0.6
    semantic_min: float = 0.55
    semantic_top: int = 5

    def check(self) -> Config:
        """Raise ValueError for a value out of its range."""
        shares = {"hop_decay": self.spreading.hop_decay, "semantic_min": self.semantic_min, "duplicate": self.consolidation.duplicate, "salience_resist": self.salience_resist, "damping": self.chat.damping, "segment decay": self.segment.decay}
        for name, v in shares.items():
            if not 0 <= v <= 1:
                raise ValueError(f"{name} must lie between 0 and 1, not {v}")
        if self.segment.window < 1 or self.segment.tau < 2 or self.segment.min_len < 1:
            raise ValueError("segment: window and min_len must be 1 at least, tau 2")
        if not callable(self.segment.predictor) and self.segment.predictor not in ("centroid", "weighted", "extrapolate"):
            raise ValueError(f"unknown predictor {self.segment.predictor}")
        if self.dim < 16 or self.semantic_top < 1 or self.spreading.max_hops < 0:
            raise ValueError("dim must be 16 at least, semantic_top 1, max_hops 0")
        return self


#: Decay a day of each type; the archive fades as raw events do.
LAMBDA = {"raw_event": 0.35, "episodic": 0.08, "semantic": 0.01, "procedural": 0.01, "preference": 0.02, "foundation": 0.0, "archive": 0.35}


def _merge(base: Any, new: dict[str, Any]) -> Any:
    known = {f.name for f in fields(base)}
    if extra := set(new) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    values = {f.name: getattr(base, f.name) for f in fields(base)}
    for k, v in new.items():
        values[k] = _merge(values[k], v) if is_dataclass(values[k]) else {**values[k], **v} if isinstance(values[k], dict) else type(values[k])(v)
    return type(base)(**values)


def load(text: str) -> Config:
    return _merge(Config(), tomllib.loads(text)).check()


def resolve(explicit: str | None = None, local: str = "mnemora.toml", home: str | None = None) -> Config:
    """The explicit file, else the local one, else the home one, else defaults. A relative root is anchored at its file."""
    for p in (explicit, local, home):
        if p and Path(p).is_file():
            c = load(Path(p).read_text())
            return c if Path(c.root).is_absolute() or "://" in c.root else _merge(c, {"root": str(Path(p).resolve().parent / c.root)})
        if p and p == explicit:
            raise FileNotFoundError(p)
    return Config()
