"""A minimal acyclic transducer from byte strings to integer lists, in flat arrays that can be memory-mapped.

Words are added in sorted order; states with the same right language are shared as soon as they are complete. Each
transition carries the number of words that sort before those behind it, so the sum along a path is the word's rank, and
the rank leads to its outputs.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

import numpy as np

MAGIC = 0x51524531


def compile_words(items: Sequence[tuple[bytes, Sequence[int]]]) -> bytes:
    """The transducer of items, which must be sorted by word and distinct, as bytes."""
    register: dict[tuple, int] = {}
    keys: list[int] = []
    targets: list[int] = []
    adds: list[int] = []
    finals: list[int] = []
    sizes: list[int] = []

    def freeze(edges: list[tuple[int, int]], final: bool) -> int:
        mark = (final, *edges)
        if (state := register.get(mark)) is None:
            state = register[mark] = len(finals)
            finals.append(final)
            before = int(final)
            for byte, to in edges:
                keys.append(state << 8 | byte)
                targets.append(to)
                adds.append(before)
                before += sizes[to]
            sizes.append(before)
        return state

    # the path of the last word: per depth its edges so far and whether a word ends there
    path: list[tuple[list, list]] = [([], [False])]
    last = b""
    for word, _ in items:
        same = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), same, -1):
            edges, final = path.pop()
            path[-1][0].append((last[depth - 1], freeze(edges, final[0])))
        path.extend(([], [False]) for _ in word[same:])
        path[-1][1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        edges, final = path.pop()
        path[-1][0].append((last[depth - 1], freeze(edges, final[0])))
    root = freeze(path[0][0], path[0][1][0])

    order = np.argsort(np.array(keys, np.int64), kind="stable")
    starts = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(o) for _, o in items], out=starts[1:])
    parts = [
        np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(adds, np.int64)[order],
        np.array(finals, np.int64), starts, np.array([x for _, o in items for x in o], np.int64),
    ]
    return b"".join(x.tobytes() for x in [np.array([MAGIC, root, *map(len, parts)], np.int64), *parts])


class Transducer:
    """Reads what compile_words made, from a file, which is memory-mapped, or from bytes."""

    def __init__(self, source: str | bytes):
        flat = np.memmap(source, np.int64, "r") if isinstance(source, str) else np.frombuffer(source, np.int64)
        if flat[0] != MAGIC:
            raise ValueError("not a transducer")
        self.root, at, parts = int(flat[1]), 8, []
        for n in map(int, flat[2:8]):
            parts.append(flat[at : at + n])
            at += n
        self.keys, self.targets, self.adds, self.finals, self.starts, self.outputs = parts

    def rank(self, words: Iterable[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon; all words take each step together."""
        words = list(words)
        ranks = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            if self.finals[self.root]:
                ranks[[not w for w in words]] = 0
            return ranks
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lens) - lens
        alive, state, total, depth = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        while len(alive):
            done = lens[alive] == depth
            over = done & (self.finals[state] == 1)
            ranks[alive[over]] = total[over]
            alive, state, total = alive[~done], state[~done], total[~done]
            want = state << 8 | text[begins[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            alive, at = alive[hit], at[hit]
            state, total, depth = self.targets[at], total[hit] + self.adds[at], depth + 1
        return ranks

    def output(self, rank: int) -> np.ndarray:
        return self.outputs[self.starts[rank] : self.starts[rank + 1]]
