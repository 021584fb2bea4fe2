"""Periods and numbers of harmonics as users write them."""

from __future__ import annotations


def periods(text: str | None) -> list[float]:
    """"24", "24, 12", or "23-25" in steps of an hour; what can't be read is 24 hours."""
    text = (text or "").strip()
    try:
        if "-" in text and "," not in text:
            first, last = (float(x) for x in text.split("-"))
            found = [first + i for i in range(int(last - first) + 1)] if last >= first else []
        else:
            found = [float(x) for x in text.split(",") if x.strip()]
    except ValueError:
        found = []
    return found if found and all(0 < p < float("inf") for p in found) else [24.0]


def harmonics(text: str | None) -> list[int]:
    """"1" or "1,2,3", each from 1 to 6; anything else is one harmonic."""
    try:
        found = [int(x) for x in (text or "").split(",") if x.strip()]
    except ValueError:
        found = []
    return found if found and all(1 <= n <= 6 for n in found) else [1]
