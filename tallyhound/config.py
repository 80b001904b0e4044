"""Settings of a run: defaults, overlaid by a file; unknown keys and impossible values are errors."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from datetime import timedelta

from tallyhound.functions.cron import parse as parse_cron
from tallyhound.sources.delivery import receivers

_UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400}


def duration(text: str | int | float) -> timedelta:
    """7d, 1d12h, 90m, 250ms; a bare number is seconds."""
    if isinstance(text, (int, float)) or re.fullmatch(r"\d+", text):
        return timedelta(seconds=float(text))
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in parts))


@dataclass(frozen=True)
class Freeze:
    name: str
    cron: str
    duration: str
    exempt_declared: bool = False


@dataclass(frozen=True)
class Config:
    window: str = "15m"
    cadence: str = "30m"
    info: int = 40
    alert: int = 70
    high: int = 90
    command_text: str = "argv0"
    salt: str = ""
    profiles: list[str] = field(default_factory=list)
    freeze: list[Freeze] = field(default_factory=list)
    min_level: str = "info"
    sinks: list[dict] = field(default_factory=list)  # see sources.delivery.receivers()

    def problems(self) -> list[str]:
        out = []
        if not 0 < self.info < self.alert < self.high <= 100:
            out.append("thresholds must rise from info to high within 1 to 100")
        if self.command_text not in ("full", "argv0", "none"):
            out.append(f"command_text: {self.command_text!r}")
        if self.min_level not in ("none", "info", "alert", "high"):
            out.append(f"min_level: {self.min_level!r}")
        for name, text in [("window", self.window), ("cadence", self.cadence), *[(f"freeze {f.name}", f.duration) for f in self.freeze]]:
            try:
                if duration(text) <= timedelta(0):
                    out.append(f"{name} must be positive")
            except ValueError as e:
                out.append(f"{name}: {e}")
        try:
            receivers(self.sinks)
        except ValueError as e:
            out.append(str(e))
        for f in self.freeze:
            try:
                parse_cron(f.cron)
            except ValueError as e:
                out.append(f"freeze {f.name}: {e}")
        return out


def load(text: str) -> Config:
    data = json.loads(text)
    if extra := set(data) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    config = Config(**{k: [Freeze(**f) for f in v] if k == "freeze" else v for k, v in data.items()})
    if problems := config.problems():
        raise ValueError("; ".join(problems))
    return config


def shown(config: Config) -> str:
    return json.dumps(asdict(config), indent=2)
