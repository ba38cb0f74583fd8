"""Token-by-token decoding around a model's logits, with n-gram blocking and rank-band sampling."""

from collections import defaultdict
from collections.abc import Callable

import numpy as np


class Trie:
    """Sequences by prefix. Ends are marked apart from edges, so that no item can collide with them."""

    def __init__(self):
        self.edges: dict = {}
        self.end = False

    def add(self, items) -> None:
        node = self
        for x in items:
            node = node.edges.setdefault(x, Trie())
        node.end = True

    def _at(self, items):
        node = self
        for x in items:
            if (node := node.edges.get(x)) is None:
                return None
        return node

    def __contains__(self, items) -> bool:
        node = self._at(items)
        return node is not None and node.end

    def beginning(self, prefix) -> list[tuple]:
        """All sequences that begin with `prefix`."""
        out, todo = [], [(tuple(prefix), self._at(prefix))]
        while todo:
            path, node = todo.pop()
            if node is None:
                continue
            if node.end:
                out.append(path)
            todo += [((*path, x), n) for x, n in node.edges.items()]
        return out


class BandSampler:
    """Picks uniformly among the tokens of rank `first` to `last`; every (plain + 1)-th call takes the best one."""

    def __init__(self, first: int = 1, last: int = 3, plain: int = 3, seed: int = 0):
        if not 1 <= first <= last:
            raise ValueError("ranks must be 1 <= first <= last")
        self.first, self.last, self.plain = first, last, plain
        self.calls, self.random = 0, np.random.default_rng(seed)

    def __call__(self, logits: np.ndarray) -> np.ndarray:
        self.calls += 1
        if self.calls % (self.plain + 1) == 0:
            return logits.argmax(axis=-1)
        band = np.argsort(-logits, axis=-1, kind="stable")[:, self.first - 1 : self.last]
        return band[np.arange(len(band)), self.random.integers(band.shape[1], size=len(band))]


#: The sampler presets by name.
SAMPLERS = {"top10_30": lambda seed=0: BandSampler(10, 30, 300, seed), "noninfluent": lambda seed=0: BandSampler(seed=seed)}


def decode(logits: Callable[[list[list[int]], list[int]], np.ndarray], rows: int, start: int, end: int, longest: int = 300, block: int = 0, sampler: Callable | None = None) -> list[list[int]]:
    """Sequences of `rows` rows. `logits(sequences, rows)` is asked for the rows that are still alive only; a row ends with
    `end` or after `longest` new tokens. No n-gram of `block` tokens comes twice in a row (0 or 1: no blocking); a row whose
    tokens are all blocked ends."""
    texts = {i: [start] for i in range(rows)}
    follows: dict[tuple, set[int]] = defaultdict(set)  # row and its last block - 1 tokens -> what has followed them
    alive = list(texts)
    for _ in range(longest):
        if not alive:
            break
        table = np.array(logits([texts[i] for i in alive], alive), dtype=float)
        if block > 1:
            for row, i in zip(table, alive):
                row[list(follows[i, *texts[i][1 - block :]])] = -np.inf
        stuck = np.isneginf(table).all(axis=1)
        picked = sampler(table) if sampler else table.argmax(axis=-1)
        for i, token, over in zip(alive, picked.tolist(), stuck.tolist()):
            token = end if over else token
            if block > 1 and len(texts[i]) >= block - 1:
                follows[i, *texts[i][1 - block :]].add(token)
            texts[i].append(token)
        alive = [i for i in alive if texts[i][-1] != end]
    return list(texts.values())
