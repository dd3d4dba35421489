"""A balanced search tree over small integers: every node has 64 children and all leaves lie at one depth."""

from __future__ import annotations


class Successors:
    """A set of integers in [0, size) with insertion, removal and successor search in log64(size) steps."""

    def __init__(self, size: int):
        self.levels: list[list[int]] = []
        n = max(1, size)
        while True:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
            if n == 1:
                break

    def add(self, x: int) -> None:
        for level in self.levels:
            x, bit = x >> 6, x & 63
            before = level[x]
            level[x] = before | (1 << bit)
            if before:
                return

    def discard(self, x: int) -> None:
        for level in self.levels:
            x, bit = x >> 6, x & 63
            level[x] &= ~(1 << bit)
            if level[x]:
                return

    def successor(self, x: int) -> int:
        """The least member >= x, or -1."""
        levels = self.levels
        for h, level in enumerate(levels):
            at, bit = x >> 6, x & 63
            if at >= len(level):
                return -1
            above = level[at] >> bit << bit
            if above:
                at = (at << 6) | ((above & -above).bit_length() - 1)
                for lower in reversed(levels[:h]):
                    word = lower[at]
                    at = (at << 6) | ((word & -word).bit_length() - 1)
                return at
            x = at + 1
        return -1
