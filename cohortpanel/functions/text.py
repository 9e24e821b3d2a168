"""Labels and texts on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def weight_label(weights: Iterable[float]) -> str:
    return "[" + " ".join(f"{w:.2f}" for w in weights) + "]"


def duration(seconds: float) -> str:
    """Hours, minutes and seconds, without leading parts that are zero."""
    whole = int(round(seconds))
    hours, rest = divmod(whole, 3600)
    minutes, left = divmod(rest, 60)
    if hours:
        return f"{hours} h {minutes} min {left} s"
    return f"{minutes} min {left} s" if minutes else f"{seconds:.1f} s"


def clip(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def normalised(weights: Sequence[float]) -> tuple[float, ...]:
    """Negative weights count 0; the rest sum to 1."""
    kept = [max(0.0, w) for w in weights]
    total = sum(kept)
    if total <= 0:
        raise ValueError("all weights are zero")
    return tuple(w / total for w in kept)
