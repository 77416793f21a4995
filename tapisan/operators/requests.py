"""Parameters of runs and schedules, checked and brought to one form."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, replace

TOPICS = ("", "all", "all topics", "general", "umum")


@dataclass(frozen=True)
class Request:
    topic: str = "All Topics"
    source: str = "all"
    limit: int = 20


def request(topic: str | None = None, source: str | None = None, limit: int | None = None, most: int = 100) -> Request:
    """General topics are one, no source is all, no limit is 20 and none is over `most`."""
    t = (topic or "").strip()
    n = limit if limit and limit > 0 else 20
    return Request("All Topics" if t.lower() in TOPICS else t, (source or "").strip() or "all", min(n, most))


@dataclass(frozen=True)
class Schedule:
    hour: int = 1
    minute: int = 0
    per_source: int = 100
    enabled: bool = True

    def __post_init__(self):
        if not 0 <= self.hour <= 23:
            raise ValueError("the hour must be 0 to 23")
        if not 0 <= self.minute <= 59:
            raise ValueError("the minute must be 0 to 59")
        if self.per_source <= 0:
            raise ValueError("the number of articles must be positive")

    def at(self, text: str) -> Schedule:
        """With the time of day 'HH:mm'."""
        m = re.fullmatch(r"(\d{1,2}):(\d{2})", text.strip())
        if not m:
            raise ValueError("the time must be HH:mm")
        return replace(self, hour=int(m[1]), minute=int(m[2]))


def schedule(saved: dict | None = None, env: dict | None = None, **given) -> Schedule:
    """Arguments, over which a saved file goes, over which the environment goes."""
    env = os.environ if env is None else env
    names = {"hour": "DAILY_AT_HOUR", "minute": "DAILY_AT_MINUTE", "per_source": "ARTICLES_PER_SOURCE"}
    values = {**given, **{k: v for k, v in (saved or {}).items() if k in ("hour", "minute", "per_source", "enabled")}}
    values |= {k: int(env[n]) for k, n in names.items() if str(env.get(n, "")).strip().lstrip("-").isdigit()}
    return Schedule(**values)


def to_fetch(needed: int, duplicates: int, target: int) -> int:
    """How many articles to ask for so that enough are new."""
    return max(20, min(needed + duplicates + 25, 3 * target + 50))
