"""A graphical model over the nodes of page trees: each node is content or not.

A node's features give its own potential; each node and its parent share a potential that depends on the
kind of node. Sum-product messages, first upward and then downward, give every node's exact marginal; the
gradient of the likelihood of labelled pages is the difference between labels and marginals. All pages of a
slice form one forest, and messages pass for all nodes of a depth at once.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

from threadlens.llm.dom import FORMATTING, TEXT, Page

#: Places that features are hashed to.
SIZE = 1 << 14
#: Kinds of edges, by the child: text, inline, block of text, anything else.
EDGES = 4
_EDGE_KINDS = {TEXT: 0, **dict.fromkeys(FORMATTING | {"span"}, 1), **dict.fromkeys("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody tr td th".split(), 2)}
#: Length of text, share of it in links, and share of stops and commas, from which the next step begins.
_LENGTHS = np.array([1, 4, 12, 30, 60, 120, 250, 600, 2000, 8000])
_LINKS = np.array([0.001, 0.2, 0.5, 0.9])
_STOPS = np.array([0.001, 0.01, 0.02, 0.04])


@lru_cache(maxsize=100_000)
def _place(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


class Forest:
    """Trees of several pages: parents, levels, kinds of edges, and features as (node, place) pairs.

    ``hide`` holds element names that count as ``div``, ``nameless`` drops the words of class, id and role.
    """

    def __init__(self, pages: list[Page], hide: frozenset[str] = frozenset(), nameless: bool = False):
        sizes = np.array([len(p.tags) for p in pages], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = self.n = int(self.first[-1])
        flat = lambda name, kind: np.fromiter((x for p in pages for x in getattr(p, name)), dtype=kind, count=n)
        self.parent = flat("parents", np.int64)
        inner = self.parent >= 0
        self.parent[inner] += np.repeat(self.first[:-1], sizes)[inner]
        depth = flat("depths", np.int64)
        order = np.argsort(depth, kind="stable")
        #: nodes by depth; the first are the roots
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
        tags = ["div" if t in hide else t for p in pages for t in p.tags]
        self.kind = np.fromiter((_EDGE_KINDS.get(t, 3) for t in tags), dtype=np.int64, count=n)
        self.node, self.place = self._features(pages, tags, nameless)

    def _features(self, pages: list[Page], tags: list[str], nameless: bool) -> tuple[np.ndarray, np.ndarray]:
        n = self.n
        texts = [t for p in pages for t in p.texts]
        size = np.fromiter(map(len, texts), dtype=np.float64, count=n)
        stops = np.fromiter((t.count(".") + t.count(",") if t else 0 for t in texts), dtype=np.float64, count=n)
        link = np.zeros(n)
        is_link = np.fromiter((t == "a" for t in tags), dtype=bool, count=n)
        for level in reversed(self.levels[1:]):  # what a node holds, its parent holds
            link[level] = np.where(is_link[level], size[level], link[level])
            for x in (size, stops, link):
                np.add.at(x, self.parent[level], x[level])
        some = np.maximum(size, 1)
        is_text = self.kind == 0
        steps = [("len", np.searchsorted(_LENGTHS, size, side="right")), ("link", np.searchsorted(_LINKS, link / some, side="right")), ("stop", np.searchsorted(_STOPS, stops / some, side="right"))]
        nodes, places = [], []
        for name, step in steps:
            table = np.array([[_place(f"{name}{s}{leaf}") for s in range(12)] for leaf in "et"])
            nodes.append(np.arange(n))
            places.append(table[is_text.astype(int), step])
        above = [tags[p] if p >= 0 else "" for p in self.parent.tolist()]
        for made in ([_place("t:" + t) for t in tags], [_place(f"p:{a}>{t}") for a, t in zip(above, tags, strict=True)]):
            nodes.append(np.arange(n))
            places.append(np.array(made, dtype=np.int64))
        if not nameless:
            named = [(int(o) + i, _place("w:" + w)) for p, o in zip(pages, self.first[:-1], strict=True) for i, words in enumerate(p.names) for w in words]
            nodes.append(np.array([x for x, _ in named], dtype=np.int64))
            places.append(np.array([x for _, x in named], dtype=np.int64))
        return np.concatenate(nodes), np.concatenate(places)


class TreeModel:
    """Weights of features and of parent-child pairs (kind of child, parent's label, child's label)."""

    def __init__(self):
        self.weights, self.pairs = np.zeros(SIZE), np.zeros((EDGES, 2, 2))

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each node to be content, and of each node's pair of labels (parent's, own)."""
        own = np.zeros((f.n, 2))
        own[:, 1] = np.bincount(f.node, weights=self.weights[f.place], minlength=f.n)
        sent = np.zeros((f.n, 2))
        pair = self.pairs[f.kind]
        for level in reversed(f.levels[1:]):
            sent[level] = np.logaddexp(own[level, None, 0] + pair[level, :, 0], own[level, None, 1] + pair[level, :, 1])
            np.add.at(own, f.parent[level], sent[level])
        belief, both = own.copy(), np.zeros((f.n, 2, 2))
        for level in f.levels[1:]:
            rest = belief[f.parent[level]] - sent[level]  # what the parent holds without this child
            joint = rest[:, :, None] + pair[level] + own[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[level] = np.exp(joint) / np.exp(joint).sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), both

    def fit(self, forest: Forest, label: np.ndarray, steps: int = 150, rate: float = 0.15, ridge: float = 1e-4) -> TreeModel:
        """Steps of Adam on the likelihood of labelled nodes; the same forest gives the same weights."""
        y = label.astype(np.float64)
        live = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((EDGES, 2, 2))
        np.add.at(seen, (forest.kind[live], label[forest.parent[live]].astype(int), label[live].astype(int)), 1)
        at = [(self.weights, np.zeros(SIZE), np.zeros(SIZE)), (self.pairs, np.zeros_like(seen), np.zeros_like(seen))]
        for step in range(1, steps + 1):
            p, both = self.marginals(forest)
            expected = np.zeros_like(seen)
            np.add.at(expected, forest.kind[live], both[live])
            slopes = (np.bincount(forest.place, weights=(y - p)[forest.node], minlength=SIZE), seen - expected)
            for (x, mean, square), slope in zip(at, slopes, strict=True):
                g = slope / max(forest.n, 1) - ridge * x
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                x += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return self
