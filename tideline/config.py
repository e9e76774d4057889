"""Typed parameters of the analytics, with the workload's public defaults."""

from dataclasses import dataclass

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR


@dataclass(frozen=True)
class Windows:
    size_us: int = 5 * SECOND
    slide_us: int = SECOND // 2


@dataclass(frozen=True)
class Segments:
    window_us: int = 5 * SECOND
    min_confidence: float = 0.9
    max_cluster_size: int = 250
    max_samples: int = 10


@dataclass(frozen=True)
class Density:
    components: int = 2
    block: int = 10
    skip_blocks: int = 2
    decay: float = 0.9
    epsilon: float = 0.01
    most: int = 20
    spacing_us: int = 4 * SECOND


@dataclass(frozen=True)
class Sampling:
    per_stage: tuple = (("early", 1, 2, 60), ("middle", 3, 5, 60), ("late", 6, 10, 130))
    seed: str = "42"
