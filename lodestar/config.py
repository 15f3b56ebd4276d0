"""Production defaults. Each must equal the engine it is compatible with."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Cooccurrence:
    phi_first: float = 0.9
    phi_span: float = 0.4
    forward: float = 1.0
    reverse: float = 0.35
    reverse_min: float = 0.25
    reverse_max: float = 0.6
    distance_decay: float = 0.08
    inversion_guard: float = 0.9
    peak: float = 0.65
    sigma: float = 0.25
    low_similarity: float = 0.1


@dataclass(frozen=True)
class Kernel:
    outbound: float = 0.95
    reserve: float = 0.05
    compression: float = 1.0
    wormhole_gain: float = 1.35
    tension: float = 1.0
    hub_exponent: float = 0.3
    hub_floor: float = 0.55
    hub_ceiling: float = 1.8
    hub_smoothing: float = 0.1

    def clamped(self) -> Kernel:
        """The same with every value in its range."""
        bound = lambda x, lo, hi: max(lo, min(hi, float(x)))
        outbound = bound(self.outbound, 0.01, 1)
        return Kernel(outbound, min(max(0.0, self.reserve), outbound), max(0.01, self.compression), max(1.0, self.wormhole_gain), max(0.0, self.tension), bound(self.hub_exponent, 0, 1), bound(self.hub_floor, 0.05, 1), bound(self.hub_ceiling, 1, 4), bound(self.hub_smoothing, 0.01, 2))


@dataclass(frozen=True)
class Spread:
    hops: int = 4
    momentum: int = 2
    firing: float = 0.1
    least: float = 0.01
    decay: float = 0.25
    wormhole_decay: float = 0.7
    fan_out: int = 20
    return_flow: float = 0.15
    gamma: float = 0.6
    max_states: int = 2000
    max_emergent: int = 50


@dataclass(frozen=True)
class Fusion:
    base_boost: float = 0.15
    boost_min: float = 0.3
    boost_max: float = 2.0
    activation_min: float = 0.5
    activation_max: float = 1.5
    core_min: float = 1.2
    core_max: float = 1.4
    core_factor: float = 1.33
    tag_dedup: float = 0.88
    technical: float = 0.08
    normal: float = 0.015
    matched_tags: int = 8


@dataclass(frozen=True)
class Axes:
    min_tags: int = 8
    clusters: int = 12
    max_basis: int = 32
    min_basis: int = 8
    cumulative: float = 0.95
    dominant: float = 0.05
    bridge: float = 0.15
    seed: int = 7


@dataclass(frozen=True)
class Residual:
    levels: int = 3
    top_k: int = 10
    min_energy: float = 0.1


@dataclass(frozen=True)
class Recall:
    k: int = 6
    floor: float = 0.4
    supplement: int = 2
    dedup: float = 0.92
    max_results: int = 1000
    enabled: bool = True


@dataclass(frozen=True)
class Injection:
    k: int = 4
    floor: float = 0.55
    max_chars: int = 2000
    user_weight: float = 0.7
    assistant_weight: float = 0.3

    def clamped(self) -> Injection:
        """The same with whole numbers of blocks and characters, 1 at least; what is no number gets its default."""
        d = Injection()
        return Injection(clamp_int(self.k, 1, 20, d.k), clamp_float(self.floor, 0.0, 1.0, d.floor), clamp_int(self.max_chars, 1, (1 << 31) - 1, d.max_chars), clamp_float(self.user_weight, 0.0, 1.0, d.user_weight), clamp_float(self.assistant_weight, 0.0, 1.0, d.assistant_weight))


@dataclass(frozen=True)
class Config:
    cooccurrence: Cooccurrence = field(default_factory=Cooccurrence)
    kernel: Kernel = field(default_factory=Kernel)
    spread: Spread = field(default_factory=Spread)
    fusion: Fusion = field(default_factory=Fusion)
    axes: Axes = field(default_factory=Axes)
    residual: Residual = field(default_factory=Residual)
    recall: Recall = field(default_factory=Recall)
    injection: Injection = field(default_factory=Injection)


def merged(overrides: dict[str, dict] | None = None) -> Config:
    """Defaults overlaid section by section; unknown names raise."""
    base = Config()
    sections = {f.name for f in fields(Config)}
    for name in overrides or {}:
        if name not in sections:
            raise ValueError(f"no section {name}")
    return replace(base, **{n: replace(getattr(base, n), **v) for n, v in (overrides or {}).items()})


def clamp_int(value: object, low: int, high: int, default: int) -> int:
    """value rounded into low..high, default where it is no finite number."""
    try:
        number = float(value)  # type: ignore[arg-type]
        return max(low, min(high, round(number)))
    except (TypeError, ValueError, OverflowError):
        return default


def clamp_float(value: object, low: float, high: float, default: float) -> float:
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return default if number != number else max(low, min(high, number))
