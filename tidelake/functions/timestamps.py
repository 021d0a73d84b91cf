"""Instants: 14 or 17 digits (yyyyMMddHHmmss and milliseconds); other spellings are brought to 17 digits."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from ..errors import TimelineError

EARLIEST = "19700101000000000"


def widen(instant: str) -> str:
    """A 14-digit instant with milliseconds, so that instants compare as strings."""
    return instant + "000" if len(instant) == 14 else instant


def _digits(t: datetime) -> str:
    return t.strftime("%Y%m%d%H%M%S") + f"{t.microsecond // 1000:03d}"


def normalise(text: str, zone: str = "utc") -> str:
    """An instant from itself, from a Unix epoch (unit by its number of digits) or from ISO 8601.

    ``zone`` is the timeline's: in ``local``, points in time become instants of this machine's zone. A time that names
    no zone is the timeline's own.
    """
    text = text.strip()
    if zone.lower() not in ("utc", "local"):
        raise TimelineError(f"timeline zone {zone!r}")
    place = UTC if zone.lower() == "utc" else None
    if re.fullmatch(r"\d{14}|\d{17}", text):
        datetime.strptime(text[:14], "%Y%m%d%H%M%S")
        return widen(text)
    if re.fullmatch(r"\d+", text):
        unit = next((u for most, u in ((10, 1), (13, 10**3), (16, 10**6)) if len(text) <= most), 10**9)
        return _digits((datetime.fromtimestamp(0, UTC) + timedelta(microseconds=int(text) * 10**6 // unit)).astimezone(place))
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise TimelineError(f"not a timestamp: {text!r}") from e
    return _digits(t.astimezone(place) if t.tzinfo else t)
