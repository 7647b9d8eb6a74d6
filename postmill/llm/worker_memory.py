"""What a Python worker remembers between tasks: one object at a time.

Workers are reused by the tasks of later stages.  An encoder with its remembered words is
worth keeping for the next task of the same stage, but not beside another operator's.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import wraps

_held: dict[tuple, object] = {}


def release() -> None:
    """Forget what earlier tasks of this worker have kept."""
    if _held:
        _held.clear()
        gc.collect()


def kept(build: Callable) -> Callable:
    """Build once per worker and arguments, and forget what was kept before."""

    @wraps(build)
    def get(*arguments):
        key = (build.__module__, build.__qualname__, arguments)
        if key not in _held:
            release()
            _held[key] = build(*arguments)
        return _held[key]

    return get
