"""Texts that remember where each of their characters came from."""

from __future__ import annotations

import re
from array import array


class Tape:
    """A text with, for each character, the span of source characters it stands for."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def replace(self, pattern: re.Pattern, by) -> None:
        """Write by(match) for every match; all its characters stand for the whole matched span."""
        out, starts, ends, at = [], array("l"), array("l"), 0
        if self.starts is None:
            self.starts, self.ends = array("l", range(len(self.text))), array("l", range(1, len(self.text) + 1))
        for m in pattern.finditer(self.text):
            a, b = m.span()
            if a == b:
                continue
            new = by(m)
            out.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            out.append(new)
            starts += array("l", [self.starts[a]] * len(new))
            ends += array("l", [self.ends[b - 1]] * len(new))
            at = b
        out.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return self.starts[a], self.ends[b - 1]
