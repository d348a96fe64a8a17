"""Memory that a Python worker has done with, for the tasks after it: workers live on, and what they hold counts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: What operators keep in this worker between tasks: how to let go of it, by operator.
_KEPT: dict[str, Callable[[], None]] = {}


def begin(operator: str, let_go: Callable[[], None] | None = None) -> None:
    """A task of ``operator`` begins: what others keep goes, so that their memory doesn't add up. ``let_go`` is for its own."""
    others = [name for name in _KEPT if name != operator]
    for name in others:
        _KEPT.pop(name)()
    if others:
        give_back()
    if let_go:
        _KEPT[operator] = let_go


def give_back() -> None:
    """Return free memory to the system: unreachable objects, Arrow's pool, and what the C library keeps where it can say."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass
