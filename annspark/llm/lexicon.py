"""A minimal acyclic transducer from words to token ids, as one memory-mapped file.

States are shared by all words with the same rest (suffix), so the automaton is the
smallest deterministic one. Each arc carries the number of words that sort before the
words behind it; the sum along a word's path is the word's rank, and a table indexed by
rank holds its token ids. A lookup walks all words of a batch at once, byte by byte.
"""

from __future__ import annotations

import mmap

import numpy as np

MAGIC = 0x4D41544C  # "MATL"


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """File content for distinct words with their ids. Words must not be empty."""
    entries = sorted(entries)
    register: dict = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)), children before parents

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    # path[k] is the open node after k bytes of the word before; closed when left behind.
    path = [[False, []]]
    before = b""
    for word, _ in entries:
        shared = 0
        for x, y in zip(word, before):
            if x != y:
                break
            shared += 1
        for k in range(len(before), shared, -1):
            path[k - 1][1].append((before[k - 1], freeze(path.pop())))
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        before = word
    for k in range(len(before), 0, -1):
        path[k - 1][1].append((before[k - 1], freeze(path.pop())))
    root = freeze(path[0])

    words_from = np.zeros(len(states), dtype=np.int64)
    keys, nexts, adds = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            nexts.append(to)
            adds.append(n)
            n += words_from[to]
        words_from[s] = n
    final = np.array([f for f, _ in states], dtype=np.int64)
    starts = np.cumsum([0] + [len(i) for _, i in entries])
    ids = np.array([x for _, i in entries for x in i], dtype=np.int64)
    parts = [np.array(keys, dtype=np.int64), np.array(nexts), np.array(adds), final, starts]
    longest = max((len(w) for w, _ in entries), default=0)
    head = np.array([MAGIC, root, longest] + [len(p) for p in parts] + [len(ids)], dtype="<i8")
    return (head.tobytes() + b"".join(np.asarray(p, dtype="<i8").tobytes() for p in parts)
            + ids.astype("<u4").tobytes())


class Lexicon:
    """A compiled lexicon mapped from its file; pages are shared by all workers of a host."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, dtype="<i8", count=9)
        if head[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        self.root, self.longest = int(head[1]), int(head[2])
        at, parts = 72, []
        for n in head[3:8]:
            parts.append(np.frombuffer(self._map, dtype="<i8", count=int(n), offset=at))
            at += 8 * int(n)
        self.keys, self.nexts, self.adds, self.final, self.starts = parts
        self.ids = np.frombuffer(self._map, dtype="<u4", count=int(head[8]), offset=at)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words that the lexicon does not hold."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not len(self.keys):
            return out
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(sizes) - sizes
        live = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        state = np.full(len(live), self.root, dtype=np.int64)
        rank = np.zeros(len(live), dtype=np.int64)
        k = 0
        while len(live):
            key = state << 8 | flat[first[live] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc, rank = live[ok], arc[ok], rank[ok]
            state, rank = self.nexts[arc], rank + self.adds[arc]
            k += 1
            ended = sizes[live] == k
            hit = ended & (self.final[state] == 1)
            out[live[hit]] = rank[hit]
            live, state, rank = live[~ended], state[~ended], rank[~ended]
        return out

    def tokens(self, rank: int) -> np.ndarray:
        return self.ids[self.starts[rank]:self.starts[rank + 1]]
