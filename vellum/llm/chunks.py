"""What Python workers share when they encode texts chunk by chunk."""

from __future__ import annotations

import os
from collections.abc import Callable

#: Most characters of a chunk that is kept.
LONG = 200


class ChunkCache:
    """Values of chunks, worked out for many new chunks at once. Chunks in use stay: the cache has two generations, and what
    is asked for moves to the younger one; when that is full the older one goes. Long chunks last for one block."""

    def __init__(self, make: Callable[[list[str]], list], kept: int = 200_000):
        self.make, self.kept = make, kept
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def of(self, chunks: set[str]) -> dict[str, object]:
        """A dictionary that has the values of all the chunks."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        old, young = self.old, self.young
        new = []
        for c in chunks.difference(young):
            if c in old:
                young[c] = old[c]
            else:
                new.append(c)
        made = dict(zip(new, self.make(new), strict=True)) if new else {}
        self.young.update((c, v) for c, v in made.items() if len(c) <= LONG)
        rest = {c: v for c, v in made.items() if len(c) > LONG}
        return {**self.young, **rest} if rest else self.young


def tokenizer(blob: str, special: bool = True):
    """A tokenizer of the ``tokenizers`` library on one thread. special: whether special tokens' strings in texts are taken as such."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(blob)
    t.encode_special_tokens = not special
    return t
