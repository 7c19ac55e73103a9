"""A minimal acyclic transducer from words to lists of token ids, in one file that is mapped into memory.

States with the same continuations are one state (suffixes are shared), and every arc carries how
many words of its state sort before it. The sum along a word's path is the word's rank in sorted
order, which addresses its ids. Lookup walks many words at once, one byte of each per step.
"""

from __future__ import annotations

import json

import numpy as np

NAMES = ["arc", "target", "before", "final", "offset", "ids"]


def compile_words(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton of ``words`` (sorted, distinct) with their ids.

    ``arc`` (state * 256 + byte, sorted), ``target`` and ``before`` describe arcs, ``final`` states;
    the word of rank r has ``ids[offset[r]:offset[r + 1]]``. State 0 is the start.
    """
    # Incremental construction from sorted words: the path of the last word stays open, all else is minimal.
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # of the last word: [final, [(byte, state)...]]
    last = b""

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        number = known.get(key)
        if number is None:
            number = known[key] = len(states)
            states.append(key)
        return number

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], close(node)))
    root = close(path[0])

    # A state's arcs lead to states closed before it, so counts follow from one pass in order.
    size = [0] * len(states)
    for s, (final, arcs) in enumerate(states):
        size[s] = final + sum(size[t] for _, t in arcs)
    renamed = lambda s: 0 if s == root else s + (s < root)
    rows = []
    for s, (final, arcs) in enumerate(states):
        seen = int(final)
        for byte, t in arcs:
            rows.append((renamed(s) * 256 + byte, renamed(t), seen))
            seen += size[t]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    final = np.zeros(len(states), np.uint8)
    for s, (ends, _) in enumerate(states):
        final[renamed(s)] = ends
    return {
        "arc": table[:, 0].copy(),
        "target": table[:, 1].astype(np.int32),
        "before": table[:, 2].astype(np.int32),
        "final": final,
        "offset": np.cumsum([0, *map(len, ids)]).astype(np.int64),
        "ids": np.array([i for some in ids for i in some], np.int32),
    }


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays as one file's content: a line that describes them, then their bytes, aligned."""
    about, at = {}, 0
    for name in NAMES:
        a = arrays[name]
        about[name] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 16) * 16
    head = json.dumps(about).encode()
    parts = [head + b" " * (-(len(head) + 1) % 16) + b"\n"]
    for name in NAMES:
        data = arrays[name].tobytes()
        parts.append(data + b"\0" * (-len(data) % 16))
    return b"".join(parts)


class Lexicon:
    """A file of :func:`packed` arrays, mapped into memory and shared by all processes of a machine."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        whole = np.memmap(path, np.uint8, "r")
        for name, (kind, n, at) in json.loads(head).items():
            start = len(head) + at
            setattr(self, name, whole[start : start + n * np.dtype(kind).itemsize].view(kind))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that it has not."""
        n = len(words)
        if not n or not len(self.arc):
            return np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        rank, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.arange(n)[lengths > 0]
        rank[lengths == 0] = -1
        step = 0
        while len(alive):
            key = state[alive] * 256 + data[starts[alive] + step]
            at = np.searchsorted(self.arc, key)
            there = at < len(self.arc)
            there[there] = self.arc[at[there]] == key[there]
            rank[alive[~there]] = -1
            alive, at = alive[there], at[there]
            rank[alive] += self.before[at]
            state[alive] = self.target[at]
            step += 1
            ends = lengths[alive] == step
            done = alive[ends]
            rank[done[self.final[state[done]] == 0]] = -1
            alive = alive[~ends]
        return rank
