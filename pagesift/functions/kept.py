"""Objects that a Python worker keeps from task to task.

The package's functions reach workers by value, so a module's own variables
are new in every task; these stay with the process.
"""

from __future__ import annotations

import sys

LIMIT = 4  # objects kept, the ones asked for last


def per_worker(key, make):
    """``make()``, kept under ``key`` until ``LIMIT`` other keys have been asked for."""
    store = sys.__dict__.setdefault("_pagesift_objects", {})
    value = store.pop(key, None)
    if value is None:
        value = make()
        while len(store) >= LIMIT:
            store.pop(next(iter(store)))
    store[key] = value  # last in order
    return value
