"""Header metrics of a pair of tables: how well the prediction's header cells agree with the expected ones in number, text, place and shape.

Header cells that touch form blocks. Blocks are paired by content, ties by how much their extents overlap; extra blocks on either side lower every mean.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import kernels as K
from . import tables as TB
from . import text as T

# The weight of extents where contents tie, and how similar a promoted row must be.
EXTENT_TIE, PROMOTED = 1e-4, 0.8
SUBMETRICS = ("cell_count", "grits", "content_bag", "block_extent", "proximity", "direction", "hierarchy_depth", "data_alignment")


def header_text(text: str) -> str:
    return T.normalize_py(TB.cell_text(text)).strip()


def places(c: TB.Cell) -> list[tuple[int, int]]:
    return [(i, j) for i in range(c.row, c.row + c.rowspan) for j in range(c.col, c.col + c.colspan)]


@dataclass
class Block:
    cells: list[TB.Cell] = field(default_factory=list)

    @property
    def span(self) -> tuple[int, int, int, int]:
        """First row and column, and those after the last."""
        return min(c.row for c in self.cells), min(c.col for c in self.cells), max(c.row + c.rowspan for c in self.cells), max(c.col + c.colspan for c in self.cells)

    def grid(self) -> np.ndarray:
        r, c, r1, c1 = self.span
        out = np.full((r1 - r, c1 - c), "", object)
        for cell in self.cells:
            for i, j in places(cell):
                out[i - r, j - c] = header_text(cell.text)
        return out


@dataclass
class Head:
    """A table's header cells and what is measured of them."""

    cells: list[TB.Cell]
    shape: tuple[int, int]

    @classmethod
    def of(cls, t: TB.Table) -> Head:
        return cls([c for c in t.cells if c.header or c.in_head], t.shape)

    def blocks(self) -> list[Block]:
        at = {p: k for k, c in enumerate(self.cells) for p in places(c)}
        group = list(range(len(self.cells)))

        def root(k: int) -> int:
            while group[k] != k:
                group[k] = k = group[group[k]]
            return k

        for (i, j), k in at.items():
            for p in ((i + 1, j), (i, j + 1)):
                if p in at:
                    group[root(at[p])] = root(k)
        out: dict[int, Block] = {}
        for k, c in enumerate(self.cells):
            out.setdefault(root(k), Block()).cells.append(c)
        return sorted(out.values(), key=lambda b: b.span[:2])

    def depth(self) -> int:
        """Levels of headers: a cell is one deeper than the deepest that stands next above it."""
        at = {p: c for c in self.cells for p in places(c)}
        level: dict[int, int] = {}
        for c in sorted(self.cells, key=lambda c: (c.row, c.col)):
            above = [next((at[i, j] for i in range(c.row - 1, -1, -1) if (i, j) in at), None) for j in range(c.col, c.col + c.colspan)]
            level[id(c)] = 1 + max((level.get(id(a), 0) for a in above if a is not None and a is not c), default=0)
        return max(level.values(), default=0)


def share(a: float, b: float) -> float:
    """The smaller over the larger; two zeros agree."""
    return 1.0 if a == b == 0 else min(a, b) / max(a, b)


def extent_iou(a: Block, b: Block, sa: tuple[int, int], sb: tuple[int, int]) -> float:
    x, y = (tuple(v / max(s[k % 2], 1) for k, v in enumerate(blk.span)) for blk, s in ((a, sa), (b, sb)))
    both = max(0.0, min(x[2], y[2]) - max(x[0], y[0])) * max(0.0, min(x[3], y[3]) - max(x[1], y[1]))
    total = (x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - both
    return both / total if total > 0 else 0.0


def edge(a: Block, b: Block) -> np.ndarray:
    """Rows and columns between the nearest edges of two blocks, signed; 0 where they overlap."""
    p, q = a.span, b.span
    gap = lambda lo1, hi1, lo2, hi2: max(lo2 - hi1, 0) - max(lo1 - hi2, 0)
    return np.array([gap(p[0], p[2], q[0], q[2]), gap(p[1], p[3], q[1], q[3])], float)


def relative_places(gt: list[Block], pred: list[Block], pairs: dict[int, int]) -> tuple[float, float]:
    """Over pairs of matched blocks: agreement of distances, and of directions (cosine, from 0 to 1)."""
    n = max(len(gt) * (len(gt) - 1), len(pred) * (len(pred) - 1)) // 2
    if not n:
        return (1.0, 1.0) if len(gt) == len(pred) else (0.0, 0.0)
    near = turn = 0.0
    own = sorted(pairs)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            u, v = edge(gt[a], gt[b]), edge(pred[pairs[a]], pred[pairs[b]])
            x, y = np.linalg.norm(u), np.linalg.norm(v)
            near += 1 - abs(x - y) / max(x, y) if max(x, y) else 1.0
            turn += (np.clip(u @ v / (x * y), -1, 1) + 1) / 2 if x and y else 1.0
    return float(near / n), float(turn / n)


def scores(gt: TB.Table, pred: TB.Table, head: Head | None = None) -> dict[str, float]:
    """SUBMETRICS, perfect, and composite: the mean of SUBMETRICS."""
    a, b = Head.of(gt), head or Head.of(pred)
    if not a.cells or not b.cells:
        alike = float(not a.cells and not b.cells)
        out = dict.fromkeys(SUBMETRICS, alike) | ({"data_alignment": 1.0} if not a.cells else {})
        return out | {"perfect": alike, "composite": sum(out.values()) / len(out)}
    x, y = a.blocks(), b.blocks()
    content = np.array([[TB.grits(p.grid(), q.grid())["f"] for q in y] for p in x])
    extent = np.array([[extent_iou(p, q, a.shape, b.shape) for q in y] for p in x])
    pairs = dict(K.assignment(content + EXTENT_TIE * extent))
    most = max(len(x), len(y))
    left = [header_text(c.text) for c in b.cells]
    hits = 0
    for c in a.cells:
        if (t := header_text(c.text)) in left:
            left.remove(t)
            hits += 1
    whole = TB.grits(gt.grid(), pred.grid())
    rows, cols, grid = dict(whole["rows"]), dict(whole["cols"]), pred.grid()
    aligned = sum(c.row in rows and c.col in cols and header_text(grid[rows[c.row], cols[c.col]]) == header_text(c.text) for c in a.cells)
    near, turn = relative_places(x, y, pairs)
    key = lambda c: (c.row, c.col, c.rowspan, c.colspan, header_text(c.text))
    out = {
        "cell_count": share(len(a.cells), len(b.cells)), "grits": float(sum(content[i, j] for i, j in pairs.items())) / most, "content_bag": hits / len(a.cells), "block_extent": float(sum(extent[i, j] for i, j in pairs.items())) / most,
        "proximity": near, "direction": turn, "hierarchy_depth": share(a.depth(), b.depth()), "data_alignment": aligned / len(a.cells),
    }
    return out | {"perfect": float(sorted(map(key, a.cells)) == sorted(map(key, b.cells))), "composite": sum(out.values()) / len(out)}


def generous(gt: TB.Table, pred: TB.Table) -> float:
    """The composite, where a prediction without header cells may have its first row taken for them if its texts are similar to the expected ones."""
    plain = scores(gt, pred)["composite"]
    own = [c for c in pred.cells if c.row == 0]
    asked = [header_text(c.text) for c in Head.of(gt).cells]
    if Head.of(pred).cells or not own or not asked:
        return plain
    like = [max(K.gestalt(header_text(c.text), t) for t in asked) for c in own]
    return max(plain, scores(gt, pred, Head(own, pred.shape))["composite"]) if sum(like) / len(like) >= PROMOTED else plain
