"""Crawl settings in a JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class CrawlSettings:
    max_concurrent_requests: int = 10
    request_delay_ms: int = 100

    def __post_init__(self) -> None:
        if self.max_concurrent_requests < 1 or not 0 <= self.request_delay_ms <= 1000:
            raise ValueError("at least one request at a time, and a delay of 0 to 1000 ms")


class SettingsStore:
    """Driver-side; a missing file means defaults."""

    def __init__(self, path: str) -> None:
        self.path = path

    def get(self) -> CrawlSettings | None:
        if not os.path.exists(self.path):
            return None
        with open(self.path, encoding="utf-8") as f:
            return CrawlSettings(**json.load(f))

    def get_or_default(self) -> CrawlSettings:
        return self.get() or CrawlSettings()

    def save(self, settings: CrawlSettings) -> None:
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(asdict(settings), f)
        os.replace(f"{self.path}.new", self.path)

    def update(self, **changes: int) -> CrawlSettings:
        made = replace(self.get_or_default(), **changes)
        self.save(made)
        return made
