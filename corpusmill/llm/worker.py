"""What a Python worker keeps from task to task, and what it gives back.

Spark reuses workers, also for tasks of other operators. A worker keeps one
object at a time (a vocabulary with its cache, an automaton), drops it when a
task of another operator starts, and returns freed memory when a task ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_kept: dict[Hashable, object] = {}


def only(key: Hashable, make: Callable[[], T]) -> T:
    """The worker's object of that key, made if it keeps another or none."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]  # type: ignore[return-value]


def begin(key: Hashable) -> None:
    """Drops what another operator's tasks left."""
    if key not in _kept:
        _kept.clear()


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: Hashable = None, rest: Callable[[], None] | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a step of ``mapInArrow`` that starts without what other
    operators kept (``key`` names its own), and calls ``rest`` and ``release``
    at the end of its task."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(key)  # a function of this module: what is nested travels with copies of its globals
        try:
            yield from run(batches)
        finally:
            if rest:
                rest()
            release()

    return task
