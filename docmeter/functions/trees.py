"""Tree edit distance between tables, three ways to compare cells, over trees and texts that are shared between them.

A table is an ordered tree: sections if it has any, rows, and cells as leaves. Key roots are taken as usual, but rows of the forest
matrix are computed at once: of the three ways to reach a place, the one along the row is a running minimum. A leaf against any tree needs
no matrix: all but the cheapest partner are inserted.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K
from . import tables as TB

VARIANTS = ("teds", "teds_struct", "teds_struct_bool")


class Tree:
    """A table's nodes in post-order: tag, spans, text, leftmost leaf, size, key roots that are no leaves."""

    def __init__(self, t: TB.Table) -> None:
        self.tag: list[str] = []
        self.span: list[tuple[int, int]] = []
        self.text: list[str] = []
        left: list[int] = []

        def add(tag: str, span: tuple[int, int], text: str, first: int | None) -> int:
            left.append(len(left) if first is None else first)
            self.tag.append(tag)
            self.span.append(span)
            self.text.append(text)
            return left[-1]

        start, section, begun = None, None, None
        by_row: dict[int, list[TB.Cell]] = {}
        for c in sorted(t.cells, key=lambda c: (c.row, c.col)):
            by_row.setdefault(c.row, []).append(c)
        for r, cells in by_row.items():
            here = t.sections.get(r)
            if section is not None and here != section:
                add(section[0], (0, 0), "", begun)
                begun = None
            section = here
            first = None
            for c in cells:
                at = add("th" if c.header else "td", (c.rowspan, c.colspan), TB.cell_text(c.text), None)
                first = at if first is None else first
            first = add("tr", (0, 0), "", first)
            start = first if start is None else start
            begun = first if begun is None else begun
        if section is not None:
            add(section[0], (0, 0), "", begun)
        add("table", (0, 0), "", start)
        self.left = np.array(left)
        self.size = np.arange(len(left)) - self.left + 1
        last = {int(x): i for i, x in enumerate(left)}
        self.roots = sorted(i for i in last.values() if self.size[i] > 1)
        # A leaf is its own matrix row; nodes are counted with the marks inside cells.
        self.count = max(t.nodes, len(left))


def costs(a: Tree, b: Tree) -> dict[str, np.ndarray]:
    """What changing a node into another costs, for each variant: 1 for another tag or span, else by the texts of data cells."""
    code = {k: i for i, k in enumerate({*zip(a.tag, a.span, strict=True), *zip(b.tag, b.span, strict=True)})}
    x, y = (np.array([code[k] for k in zip(t.tag, t.span, strict=True)]) for t in (a, b))
    struct = (x[:, None] != y[None, :]).astype(float)
    cells = (np.array([t == "td" for t in a.tag])[:, None] & np.array([t == "td" for t in b.tag])[None, :]) & (struct == 0)
    ta, ia = np.unique(np.array(a.text, object).astype(str), return_inverse=True)
    tb, ib = np.unique(np.array(b.text, object).astype(str), return_inverse=True)
    far = K.text_distances([str(t) for t in ta], [str(t) for t in tb])
    empty = (np.array([not t for t in a.text])[:, None]) != (np.array([not t for t in b.text])[None, :])
    return {"teds": np.where(cells, far[np.ix_(ia, ib)], struct), "teds_struct": struct, "teds_struct_bool": np.where(cells, empty, struct)}


def distance(a: Tree, b: Tree, change: np.ndarray) -> float:
    n, m = len(a.left), len(b.left)
    if n == m and (a.left == b.left).all() and not np.diagonal(change).any():
        return 0.0
    dist = np.zeros((n, m))
    # A leaf against a tree, either way: the cheapest partner in it, all other nodes inserted.
    for q in range(m):
        low = change[:, b.left[q] : q + 1].min(axis=1)
        leaf = a.size == 1
        dist[leaf, q] = b.size[q] - 1 + low[leaf]
    for p in range(n):
        leaf = b.size == 1
        low = change[a.left[p] : p + 1, :].min(axis=0)
        dist[p, leaf] = a.size[p] - 1 + low[leaf]
    for i in a.roots:
        for j in b.roots:
            lo, lb = a.left[i], b.left[j]
            q = np.arange(lb, j + 1)
            back = b.left[q] - lb  # where the forest before q's tree ends
            on_path = b.left[q] == lb
            steps = np.arange(len(q) + 1.0)
            f = np.empty((i - lo + 2, len(q) + 1))
            f[0] = steps
            for p in range(lo, i + 1):
                x = p - lo + 1
                if a.left[p] == lo:
                    reach = np.where(on_path, f[x - 1, :-1] + change[p, q], f[0, back] + dist[p, q])
                else:
                    reach = f[a.left[p] - lo, back] + dist[p, q]
                row = np.empty(len(q) + 1)
                row[0] = x
                np.minimum(f[x - 1, 1:] + 1, reach, out=row[1:])
                f[x] = np.minimum.accumulate(row - steps) + steps
                if a.left[p] == lo and a.size[p] > 1:
                    inner = on_path & (b.size[q] > 1)
                    dist[p, q[inner]] = f[x, 1:][inner]
    return float(dist[-1, -1])


def teds(gt: TB.Table, pred: TB.Table, variants: tuple[str, ...] = VARIANTS, *, trees: tuple[Tree, Tree] | None = None) -> dict[str, float]:
    """1 - tree edit distance / nodes of the larger table, floored at 0, for each variant. Equal tables need no matrix."""
    a, b = trees or (Tree(gt), Tree(pred))
    most = max(a.count, b.count)
    if (a.tag, a.span, a.text) == (b.tag, b.span, b.text):
        return dict.fromkeys(variants, 1.0)
    c = costs(a, b)
    return {v: max(0.0, 1 - distance(a, b, c[v]) / most) for v in variants}
