"""Options of a reduction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars4(text: Column) -> Column:
    """The default token count: characters over four, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


@dataclass(frozen=True)
class ReduceConfig:
    budget: int = 8000
    max_lines: int | None = None
    context: int = 2
    weights: tuple[float, float, float] = (0.4, 0.5, 0.1)  # rarity, severity, burst
    redact: bool = True
    format: str = "auto"
    tokens: Callable[[Column], Column] = chars4

    def __post_init__(self):
        if self.budget < 1 or self.context < 0 or self.context > 255 or len(self.weights) != 3 or not all(0 <= w < float("inf") for w in self.weights):
            raise ValueError("budget >= 1, context 0 to 255 and three finite weights >= 0 are needed")
        if self.format not in ("auto", "json", "logfmt", "syslog", "klog", "plain"):
            raise ValueError(f"unknown format {self.format}")


FORMATS = {"json": "json", "logfmt": "logfmt", "syslog": "syslog", "klog": "klog", "glog": "klog", "plain": "plain"}


def format_of(name: str) -> str:
    """A format by its name in any case; unknown names are detected per log."""
    return FORMATS.get(name.lower(), "auto")


def weights_of(text: str) -> tuple[float, float, float]:
    """Three numbers, by commas: rarity, severity, burst."""
    parts = text.split(",")
    if len(parts) != 3:
        raise ValueError("weights are three numbers: rarity,severity,burst")
    r, s, b = (float(x.strip()) for x in parts)
    return r, s, b
