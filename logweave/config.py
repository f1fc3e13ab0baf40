"""Thresholds of the analyses, all in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of every threshold; times in seconds unless the name says otherwise."""

    stall_s: float = 300.0
    session_live_s: float = 600.0
    grace_s: float = 1.0
    handback_slack_s: float = 5.0
    hub_reads: int = 3
    handoff_containment: float = 0.15
    handoff_run: int = 40
    shingle: int = 8
    loop_repeats: int = 6
    loop_cycle: int = 16
    retry_gap: int = 3
    stuck_failures: int = 3
    stuck_recent: int = 10
    rebuild_tokens: int = 10_000
    rebuild_share: float = 0.2
    idle_short_s: float = 300.0
    idle_long_s: float = 3600.0
    big_result_chars: int = 20_000
    chars_per_token: int = 4
    near_limit: float = 0.8
    context_limits: tuple[tuple[str, int], ...] = (("haiku", 200_000),)
    context_limit: int = 1_000_000
    peak_window_s: float = 300.0
    target_chars: int | None = None
    verify_pattern: str | None = None

    def micros(self, name: str) -> int:
        """A time threshold in microseconds."""
        return round(getattr(self, name) * 1_000_000)


DEFAULTS = EngineConfig()
