"""How long the phases of a job take, and their shares."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager


class Timer:
    def __init__(self) -> None:
        self.spent: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spent[name] = self.spent.get(name, 0.0) + time.perf_counter() - began

    def timed(self, name: str) -> Callable:
        def around(f: Callable) -> Callable:
            @functools.wraps(f)
            def inner(*args, **kwargs):  # noqa: ANN002, ANN003, ANN202
                with self.phase(name):
                    return f(*args, **kwargs)

            return inner

        return around

    def report(self) -> list[tuple[str, float, float]]:
        """(phase, seconds, percent of all), longest first, and a total."""
        total = sum(self.spent.values())
        share = lambda s: 100 * s / total if total else 0.0
        return [(n, s, share(s)) for n, s in sorted(self.spent.items(), key=lambda x: -x[1])] + [("total", total, share(total))]
