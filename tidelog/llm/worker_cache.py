"""What a Python worker keeps between tasks.

Workers are used again by later tasks, also of other operators. An operator
keeps costly state (a loaded vocabulary, encodings of words) by claiming its
cache; claiming drops the caches of all other operators, so that a worker never
holds more than one operator's, and hands the memory back to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

_CACHES: dict[str, dict] = {}


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def claim(owner: str) -> dict:
    """The cache of ``owner``, empty at first; those of others are dropped."""
    if owner not in _CACHES:
        _CACHES.clear()
        trim()
    return _CACHES.setdefault(owner, {})
