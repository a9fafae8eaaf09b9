"""Job parameters of the two flows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from dataclasses import dataclass

from siftline import constants as K


@dataclass(frozen=True)
class ScreeningParams:
    watch_csv: str | None = None
    destination: str = "me"
    model: str = K.DEFAULT_MODEL
    rpm: int = K.DEFAULT_RPM
    max_age_s: int = K.DEFAULT_MAX_AGE_S
    since: dt.date | None = None
    rules: str | None = None
    overlap_s: int = 3600
    """Live also takes posts dated up to so long before a sweep's end that the sweep did not see."""

    @classmethod
    def from_settings(cls, settings: Mapping[str, str]) -> ScreeningParams:
        """Parameters from text settings named like the fields.

        ``watch_csv`` and ``destination`` are required, ``since`` is a strict
        date, numbers that are no whole number >= 0 fall back to the default.
        """
        given = {k: v.strip(K.WHITE_SPACE) for k, v in settings.items()}
        for name in ("watch_csv", "destination"):
            if not given.get(name):
                raise ValueError(f"{name} is required")
        since = given.get("since") or None
        if since and not re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", since):
            raise ValueError(f"since must be YYYY-MM-DD: {since}")
        return cls(
            watch_csv=given["watch_csv"],
            destination=given["destination"].removeprefix("@"),
            model=given.get("model") or K.DEFAULT_MODEL,
            rpm=_nonneg_int(given.get("rpm"), K.DEFAULT_RPM),
            max_age_s=_nonneg_int(given.get("max_age_s"), K.DEFAULT_MAX_AGE_S),
            since=dt.date.fromisoformat(since) if since else None,
            rules=settings.get("rules"),
        )


@dataclass(frozen=True)
class SinkPaths:
    """Folders of the outputs. ``match_log=None`` switches the log off."""

    match_log: str | None
    outbox: str
    verdicts: str
    quarantine: str
    state: str


def _nonneg_int(text: str | None, default: int) -> int:
    """The rule of ``nonneg_int_or``: beyond 64 bits is no number either."""
    if text and re.fullmatch("[+-]?[0-9]+", text) and 0 <= int(text) < 1 << 63:
        return int(text)
    return default
