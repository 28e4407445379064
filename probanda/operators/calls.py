"""Calls of a user function on lists, with failures kept to the items that cause them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

BATCH = 64  # items of one call


def answered(run: Callable[[list], list], items: list, batch: int = BATCH) -> Iterator[tuple[Any, str | None]]:
    """(answer, error) of every item, in order.

    Items are passed ``batch`` at a time.  A call that fails, or that answers another number
    of items, is halved until the items that fail alone are found: n of them in a batch cost
    about 2 n log2(batch) calls, the others share theirs.
    """
    for start in range(0, len(items), batch):
        yield from halved(run, items[start : start + batch])


def halved(run: Callable[[list], list], items: list) -> Iterator[tuple[Any, str | None]]:
    try:
        answers = run(items)
        if len(answers) != len(items):
            raise ValueError(f"{len(answers)} answers to {len(items)} items")
    except Exception as exc:
        if len(items) == 1:
            yield None, f"{type(exc).__name__}: {exc}"
        else:
            yield from halved(run, items[: len(items) // 2])
            yield from halved(run, items[len(items) // 2 :])
    else:
        yield from ((answer, None) for answer in answers)
