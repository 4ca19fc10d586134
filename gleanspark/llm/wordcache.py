"""A bounded memory of what has been computed for words, one at a time in a Python worker."""

from __future__ import annotations

from collections.abc import Callable

#: Entries a Python worker holds at most: about 200 bytes each.
LIMIT = 500_000
_HELD: list = [None, {}]


def worker_cache(owner: object, make: Callable[[], dict] = dict) -> dict:
    """The cache of `owner` in this worker. Asking for another owner's drops it, as workers outlive a query's stages."""
    if _HELD[0] is not owner:
        _HELD[1].clear()
        _HELD[:] = [owner, make()]
    return _HELD[1]
