"""Stream modes: a window that is emptied by count or age, or counts that decay with each evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import DeserializationError, UnsupportedOperation


@dataclass(frozen=True)
class Flush:
    """Empty the window before `size` values are reached or `cadence` seconds have passed."""

    size: int = 1_000_000
    cadence: int = 86_400

    def to_export(self) -> dict:
        return {"Flush": {"size": self.size, "cadence": self.cadence}}


@dataclass(frozen=True)
class ExponentialDecay:
    """Counts are multiplied by alpha at each evaluation."""

    alpha: float

    @classmethod
    def of_half_life(cls, half_life: float = 86_400) -> ExponentialDecay:
        return cls(0.5 ** (1 / half_life))

    def to_export(self) -> dict:
        return {"ExponentialDecay": self.alpha}


StreamMode = Flush | ExponentialDecay


def mode_from_export(data: dict) -> StreamMode:
    try:
        if "Flush" in data:
            return Flush(int(data["Flush"]["size"]), int(data["Flush"]["cadence"]))
        return ExponentialDecay(float(data["ExponentialDecay"]))
    except (KeyError, TypeError, ValueError) as e:
        raise DeserializationError(f"no stream mode: {data!r}") from e


def require_flush(mode: StreamMode) -> Flush:
    if not isinstance(mode, Flush):
        raise UnsupportedOperation("only streams in flush mode are flushed")
    return mode
