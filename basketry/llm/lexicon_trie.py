"""Nearest lexicon words by Levenshtein automata along two tries.

The lexicon is a trie, and so are the different words asked about (sorted, their common prefixes are its nodes). The two are
walked together, level by level: a pair (lexicon node, word prefix) holds the state of the Levenshtein automaton, the edit
distances of the lexicon prefix to the word prefixes up to two characters shorter or longer. A pair goes on to the children of
both tries while the least distance is within what some lexicon word below allows. So neither trie is multiplied out
beforehand: memory is linear in the lexicon, and words that begin alike are walked once. Distances count characters.
"""

from __future__ import annotations

import numpy as np

#: Least length of a lexicon word for each allowed distance; shorter ones must match exactly.
DISTANCE = ((10, 2), (5, 1))
NONE = 9


def allowed(term: str) -> int:
    return next((d for n, d in DISTANCE if len(term) >= n), 0)


class Lexicon:
    """Lexicon words as a trie in arrays; the children of a node are next to each other."""

    def __init__(self, terms: list[str]):
        terms = sorted({t for t in terms if t})
        child: list[dict[str, int]] = [{}]
        ends, reach = [-1], [0]
        for t in terms:
            node, d = 0, allowed(t)
            for c in t:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    ends.append(-1)
                    reach.append(0)
                node = child[node][c]
                reach[node] = max(reach[node], d)
            ends[node] = d
        order, code = [0], [0]  # breadth first, so that children are contiguous
        for node in order:
            for c, to in child[node].items():
                order.append(to)
                code.append(ord(c))
        self.code = np.array(code, np.uint32)
        self.ends = np.array([ends[n] for n in order], np.int8)
        self.reach = np.array([reach[n] for n in order], np.int8)
        self.n_children = np.array([len(child[n]) for n in order], np.int64)
        self.first_child = 1 + np.cumsum(self.n_children) - self.n_children
        self.longest = max((len(t) for t in terms), default=0)

    def nearest(self, words: list[str]) -> np.ndarray:
        """Distance of each word to the nearest lexicon word that allows it; ``NONE`` if there is none."""
        out = np.full(len(words), NONE, np.int8)
        size = np.array([len(w) for w in words], np.int64)
        near = np.flatnonzero((size > 0) & (size <= self.longest + 2))  # no other can be within two edits
        if not len(near) or not self.longest:
            return out
        text = np.array([words[i] for i in near])
        text, back = np.unique(text, return_inverse=True)
        best = np.full(len(text), NONE, np.int8)
        width = self.longest + 6
        letters = np.zeros((len(text), width), np.uint32)
        raw = text.astype(f"U{max(1, int(size[near].max()))}")
        letters[:, : raw.dtype.itemsize // 4] = raw.view(np.uint32).reshape(len(raw), -1)
        length = np.array([len(w) for w in text.tolist()], np.int64)
        # words ascend, so the words of a prefix are a range; it begins where a word shares less than that with the one before
        shared = np.zeros(len(text), np.int64)
        shared[1:] = (np.cumprod(letters[1:] == letters[:-1], axis=1)).sum(1)
        shared[0] = -1
        first = {p: np.flatnonzero(shared < p) for p in (2, 3)}
        root = np.array([NONE, NONE, 0, 1, 2], np.int8)
        for node in range(int(self.first_child[0]), int(self.first_child[0] + self.n_children[0])):  # one first letter at a time
            n = len(first[3])
            rows = np.repeat(root[None], n, axis=0)
            pair = self._advanced(np.arange(n), np.full(n, node), rows, 0, first[3], letters, length, best)
            self._walk(pair, first, shared, letters, length, best)
        out[near] = best[back.ravel()]
        return out

    def _walk(self, pair: tuple[np.ndarray, ...], first: dict, shared: np.ndarray, letters: np.ndarray, length: np.ndarray, best: np.ndarray) -> None:
        depth = 1
        while len(pair[0]):
            group, node, rows = pair
            if depth + 3 not in first:
                first[depth + 3] = np.flatnonzero(shared < depth + 3)
            here, below = first[depth + 2], first[depth + 3]
            lo = np.searchsorted(below, here[group])
            hi = np.searchsorted(below, np.append(here[1:], len(shared))[group])
            many, nodes = hi - lo, self.n_children[node]
            total = many * nodes
            at = np.repeat(np.arange(len(group)), total)
            off = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
            each = np.maximum(nodes[at], 1)
            pair = self._advanced(lo[at] + off // each, self.first_child[node[at]] + off % each, rows[at], depth, below, letters, length, best)
            depth += 1

    def _advanced(
        self, group: np.ndarray, node: np.ndarray, rows: np.ndarray, depth: int, first: np.ndarray, letters: np.ndarray, length: np.ndarray, best: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """The automaton's states after the nodes' letters, of pairs that can still match; words that end are entered in
        ``best``. ``rows[:, k]``: distance of the lexicon prefix to the word prefix of ``depth - 2 + k`` characters."""
        word = first[group]
        new = np.full(rows.shape, NONE, np.int8)
        for k in range(5):
            i = depth - 1 + k  # characters of the word prefix
            if i < 0:
                continue
            cell = rows[:, k + 1] + 1 if k < 4 else np.full(len(rows), NONE, np.int8)
            if i > 0:
                other = letters[word, i - 1] != self.code[node] if i <= letters.shape[1] else True
                cell = np.minimum(cell, rows[:, k] + other)
                if k:
                    cell = np.minimum(cell, new[:, k - 1] + 1)
            new[:, k] = np.minimum(cell, NONE)
        depth += 1
        k = length[word] - depth + 2
        ending = np.flatnonzero((self.ends[node] >= 0) & (k >= 0) & (k <= 4))
        distance = new[ending, k[ending]]
        ending, distance = ending[distance <= self.ends[node[ending]]], distance[distance <= self.ends[node[ending]]]
        np.minimum.at(best, word[ending], distance)
        go = np.flatnonzero((new.min(1) <= self.reach[node]) & (self.n_children[node] > 0)) if len(new) else np.zeros(0, np.int64)
        return group[go], node[go], new[go]
