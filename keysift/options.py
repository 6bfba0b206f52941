"""Typed job options.  Out-of-range or unparsable values fall back to the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Option name -> (default, lowest, highest).
INT_BOUNDS = {
    "MAX_FILE_SIZE_MB": (10, 1, 1000),
    "LOCAL_SCAN_MAX_DEPTH": (10, 1, 100),
}

# Score points and limits.
BASE_SCORES = {"CRITICAL": 90, "HIGH": 80, "MEDIUM": 60, "LOW": 40}
HIGH_ENTROPY = 4.5
LOW_ENTROPY = 3.0
HIGH_ENTROPY_BONUS = 10
LOW_ENTROPY_PENALTY = 30
TEST_PATH_PENALTY = 30
DENYLIST_PENALTY = 60

DEFAULT_SKIP_FRAGMENTS = ("/node_modules/", "/.git/", "/vendor/", "/dist/", "/build/")
DEFAULT_DENYLIST = ("example", "placeholder", "changeme", "dummy", "sample", "your_", "xxxx")
DEFAULT_CONTEXT_DIRS = (
    "test", "tests", "doc", "docs", "example", "examples", "fixture", "fixtures", "__tests__",
)


def bounded_int(raw: object, default: int, lowest: int, highest: int) -> int:
    """``raw`` as an int when it parses and lies in [lowest, highest], else ``default``."""
    try:
        value = int(str(raw))
    except ValueError:
        return default
    return value if lowest <= value <= highest else default


def bounded_float(raw: object, default: float, lowest: float, highest: float) -> float:
    """``raw`` as a float when it parses and lies in [lowest, highest], else ``default``."""
    try:
        value = float(str(raw))
    except ValueError:
        return default
    return value if lowest <= value <= highest else default


@dataclass(frozen=True)
class ScanOptions:
    """Everything a scan can be told.  Thresholds are options, not constants."""

    max_depth: int | None = None
    max_file_size_mb: int = 10
    skip_fragments: tuple[str, ...] = DEFAULT_SKIP_FRAGMENTS
    deduplicate: bool = True
    incremental: bool = False
    baseline_path: str | None = None
    attach_blame: bool = False
    organization: str = "local"
    scanner_version: str = "1.0.0"
    denylist: tuple[str, ...] = DEFAULT_DENYLIST
    context_dirs: tuple[str, ...] = DEFAULT_CONTEXT_DIRS
    base_scores: Mapping[str, int] = field(default_factory=lambda: dict(BASE_SCORES))
    high_entropy: float = HIGH_ENTROPY
    low_entropy: float = LOW_ENTROPY
    high_entropy_bonus: int = HIGH_ENTROPY_BONUS
    low_entropy_penalty: int = LOW_ENTROPY_PENALTY
    test_path_penalty: int = TEST_PATH_PENALTY
    denylist_penalty: int = DENYLIST_PENALTY
    high_risk_from: int = 80
    medium_risk_from: int = 50

    def with_(self, **changes: object) -> ScanOptions:
        return replace(self, **changes)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **changes: object) -> ScanOptions:
        """Options from environment variables; keyword arguments win."""
        env = os.environ if env is None else env

        def number(name: str) -> int:
            default, lowest, highest = INT_BOUNDS[name]
            return bounded_int(env.get(name, default), default, lowest, highest)

        def switch(name: str, default: bool) -> bool:
            return str(env.get(name, default)).strip().lower() in ("true", "1", "yes")

        values: dict[str, object] = {
            "max_depth": number("LOCAL_SCAN_MAX_DEPTH"),
            "max_file_size_mb": number("MAX_FILE_SIZE_MB"),
            "deduplicate": switch("DEDUPLICATION_ENABLED", True),
            "attach_blame": switch("ENABLE_GIT_BLAME", False),
            "incremental": env.get("SCAN_MODE", "full").lower() == "incremental",
            "baseline_path": env.get("BASELINE_FILE"),
            "organization": env.get("TARGET_ORG", "local"),
        }
        values.update(changes)
        return cls(**values)
