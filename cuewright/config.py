"""Default parameters of the operators; times in milliseconds. Fixed values throughout: results must be those of these numbers."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Chunking:
    silence_ms: int = 1200
    look_ahead: int = 20
    max_tokens: int = 1000
    overlap_ms: int = 25_000
    min_ms: int = 15_000


@dataclass(frozen=True)
class Sentences:
    pause_ms: int = 1000
    min_words: int = 3


@dataclass(frozen=True)
class Captions:
    max_words: int = 8
    max_chars: int = 42
    max_ms: int = 4000


@dataclass(frozen=True)
class Refine:
    context_ms: int = 20_000
    extension_ms: int = 15_000
    max_ms: int = 90_000
    pad_before_ms: int = 150
    pad_after_ms: int = 300


@dataclass(frozen=True)
class Spikes:
    radius: int = 50
    frame_ms: int = 200
    threshold_db: float = 8.0
    floor: float = 1e-4
    min_ms: int = 400
    max_ms: int = 8000
    merge_ms: int = 1000
    pre_ms: int = 25_000
    post_ms: int = 10_000
    coverage: float = 0.3
    min_span_ms: int = 15_000
    max_span_ms: int = 90_000


@dataclass(frozen=True)
class Fusion:
    merge_iou: float = 0.7
    diversity_iou: float = 0.5
    near_iou: float = 0.3
    near_similarity: float = 0.92
    coverage: float = 0.6
    min_score: float = 0.45
    target: int = 8
    #: Weights of the score components.
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "opening": 0.22, "standalone": 0.24, "payoff": 0.16, "completeness": 0.16,
            "relevance": 0.08, "editability": 0.09, "audio_support": 0.05,
        }
    )


@dataclass(frozen=True)
class Framing:
    width: int = 1280
    height: int = 720
    interval_ms: int = 250
    deadzone: float = 0.15
    smooth: float = 0.3
    jitter: float = 5.0
    snap: float = 0.25
    hold_samples: int = 4
    stability: int = 6
    min_face_fraction: float = 0.5


@dataclass(frozen=True)
class Speakers:
    join_ms: int = 500
    min_turn_ms: int = 1500
    hold_ms: int = 2000
