"""Regular expressions from lists of words."""

from __future__ import annotations

from collections.abc import Iterable


def any_of(words: Iterable[str]) -> str:
    return f"(?:{'|'.join(words)})"


def starts_with(words: Iterable[str]) -> str:
    """A text that begins with one of these words or phrases, in any case of letters."""
    return rf"(?i)^\s*{any_of(words)}\b"
