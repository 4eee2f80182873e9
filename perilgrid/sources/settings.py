"""Settings from the environment: blanks and unreadable numbers give the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

#: What counts as true.
TRUE = {"1", "true", "yes", "y", "on"}


def flag(environ: Mapping[str, str], name: str, default: bool) -> bool:
    text = environ.get(name, "").strip().lower()
    return text in TRUE if text else default


def number(environ: Mapping[str, str], name: str, default: float) -> float:
    try:
        return float(environ.get(name, "").strip())
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    weather_key: str | None = None
    weather_nx: int = 60
    weather_ny: int = 121
    confidence: float = 0.25
    keep_originals: bool = False

    @property
    def weather_enabled(self) -> bool:
        return bool(self.weather_key)


def load(environ: Mapping[str, str] | None = None) -> Settings:
    e = os.environ if environ is None else environ
    return Settings(
        e.get("KMA_SERVICE_KEY", "").strip() or None,
        int(number(e, "KMA_NX", 60)),
        int(number(e, "KMA_NY", 121)),
        number(e, "CONF_THRESHOLD", 0.25),
        flag(e, "STORE_ORIGINAL_IMAGE", False),
    )
