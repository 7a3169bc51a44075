"""Nested timing of the steps of a command."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager


class Timer:
    """Says when steps begin and how long they took, indented by how deep they are in others; silent without tell."""

    def __init__(self, tell: Callable[[str], None] | None = None):
        self.tell, self.depth, self.seconds = tell, 0, {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        if self.tell:
            self.tell(f"{'  ' * self.depth}{name} ...")
        self.depth += 1
        try:
            yield
        finally:
            self.depth -= 1
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
            if self.tell:
                self.tell(f"{'  ' * self.depth}{name}: {self.seconds[name]:.3f} s")
