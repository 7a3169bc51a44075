"""Text cut at single spaces, for tokenizers whose pieces never reach across one; and a bounded memory of what chunks became."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Between two characters that are no white space, a single space: what follows is encoded on its own, space included.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Memory(dict):
    """chunk -> made(chunk), for chunks of up to longest characters, in two generations of up to most each.

    When the young one is full it becomes the old one, and what is asked for again moves back: frequent chunks stay.
    """

    def __init__(self, made: Callable[[str], object], most: int = 200_000, longest: int = 256):
        super().__init__()
        self.made, self.most, self.longest, self.old = made, most, longest, {}

    def __missing__(self, chunk: str):
        out = self.old.get(chunk)
        if out is None:
            out = self.made(chunk)
            if len(chunk) > self.longest:
                return out
        if len(self) >= self.most:
            self.turn()
        self[chunk] = out
        return out

    def turn(self) -> None:
        """The young generation becomes the old one."""
        self.old = dict(self)
        self.clear()
