"""Longest common extensions of two suffixes of a sequence in constant time, by a suffix tree and its Euler tour."""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """Ukkonen's tree of a sequence of small integers whose last one occurs nowhere else.

    ``edges`` has the child of a node by its first symbol, under ``node * symbols + symbol``; the label of a node's edge is
    ``text[start[node]:end[node]]``, and leaves end at the end of the text.
    """

    def __init__(self, text: list[int], symbols: int):
        self.text, self.symbols = text, symbols
        self.start, self.end, self.edges = [0], [0], {}
        self._grow()

    def _grow(self) -> None:
        text, symbols, start, end, edges = self.text, self.symbols, self.start, self.end, self.edges
        size, link = len(text), [0]
        node = at = length = open_suffixes = 0  # the active point is ``length`` symbols below ``node``, along text[at]
        for i, symbol in enumerate(text):
            open_suffixes += 1
            unlinked = 0
            while open_suffixes:
                if not length:
                    at = i
                key = node * symbols + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i), end.append(size), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    top = start[child]
                    wide = end[child] - top
                    if length >= wide:
                        node, at, length = child, at + wide, length - wide
                        continue
                    if text[top + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    start.append(top), end.append(top + length), link.append(0)
                    edges[key] = split
                    start[child] = top + length
                    edges[split * symbols + text[top + length]] = child
                    edges[split * symbols + symbol] = split + 1
                    start.append(i), end.append(size), link.append(0)
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - open_suffixes + 1


class Extensions:
    """Order of the suffixes of a sequence, and for pairs of them the length of what they have in common at the front."""

    def __init__(self, text: list[int], symbols: int):
        tree = SuffixTree(text, symbols)
        self.rank, self.first, self.tour = self._walked(tree)

    @staticmethod
    def _walked(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank of each suffix, its place in the tour, and the string depths of the nodes along the tour, children by symbol."""
        size, nodes = len(tree.text), len(tree.start)
        keys = np.fromiter(tree.edges.keys(), np.int64, len(tree.edges))
        below = np.fromiter(tree.edges.values(), np.int64, len(tree.edges))
        order = np.argsort(keys)
        children = below[order].tolist()
        edge = np.searchsorted(keys[order] // tree.symbols, np.arange(nodes + 1))
        todo, last = edge[:-1].tolist(), edge[1:].tolist()
        wide = (np.array(tree.end) - np.array(tree.start)).tolist()
        rank, first, tour = [0] * size, [0] * size, [0]
        node = depth = seen = 0
        above: list[tuple[int, int]] = []
        while True:
            at = todo[node]
            if at < last[node]:
                todo[node] = at + 1
                child = children[at]
                deeper = depth + wide[child]
                if todo[child] < last[child]:
                    above.append((node, depth))
                    node, depth = child, deeper
                    tour.append(depth)
                else:
                    suffix = size - deeper
                    rank[suffix], first[suffix] = seen, len(tour)
                    seen += 1
                    tour.append(deeper)
                    tour.append(depth)
            elif above:
                node, depth = above.pop()
                tour.append(depth)
            else:
                return np.array(rank), np.array(first), np.array(tour, np.int32)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different suffixes the string depth of their lowest common ancestor: the least depth between their places.

        All pairs are known at once, so the doubling table of minima is kept one level at a time, each pair being answered
        at its own level by two entries.
        """
        x, y = self.first[a], self.first[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        table = self.tour
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                table = np.minimum(table[: -(1 << k - 1)], table[1 << k - 1 :])
            some = np.flatnonzero(level == k)
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << k) + 1])
        return out
