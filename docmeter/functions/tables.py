"""Table parsing and table similarity kernels, in plain Python and numpy."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

from . import kernels as K
from .text import BULLETS, CROSSES, DASHES, DOT_LEADER, FORMATTING, QUOTES, SPAN, SUBSCRIPTS, SUPERSCRIPTS

_CELL = str.maketrans({**QUOTES, **dict.fromkeys(DASHES, "-"), **dict.fromkeys(BULLETS, "•"), **dict.fromkeys(CROSSES, "⊗"), **dict(zip(*SUPERSCRIPTS, strict=True)), **dict(zip(*SUBSCRIPTS, strict=True))})
# What counts as an empty cell.
EMPTY = frozenset({"", "nan", "NaN", "NAN", "none", "None", "-", "—", "n/a", "N/A"})
TABLE = re.compile("(?i)<table")
MATCHED_COLUMN, BIG_CELLS, BIG_RATIO = 0.9, 2500, 1.5


def cell_text(t: str) -> str:
    """normalize_cell in Python."""
    t = re.sub(r"(?i)<su([pb])[^>]*>(.*?)</su\1>", r"\2", t or "")
    for p, by in ((FORMATTING, ""), (SPAN, ""), (r"\*\*(.*?)\*\*|__(.*?)__", r"\1\2"), (r"(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)|(?<!_)_(?!_)(.*?)(?<!_)_(?!_)", r"\1\2"), (r"~~(.*?)~~", r"\1")):
        t = re.sub(p, by, t)
    t = re.sub(r"\s+", " ", re.sub(DOT_LEADER, "", t.translate(_CELL))).strip()
    return "-" if t and set(t) <= {"-", " "} else t


@dataclass
class Cell:
    row: int
    col: int
    text: str
    header: bool
    rowspan: int = 1
    colspan: int = 1
    in_head: bool = False


@dataclass
class Table:
    cells: list[Cell] = field(default_factory=list)
    context: str = ""
    #: Of a row, its section's tag and number; elements in all, with those inside cells; text behind the table.
    sections: dict[int, tuple[str, int]] = field(default_factory=dict)
    nodes: int = 0
    after: str = ""

    @property
    def shape(self) -> tuple[int, int]:
        return max((c.row + c.rowspan for c in self.cells), default=0), max((c.col + c.colspan for c in self.cells), default=0)

    def grid(self) -> np.ndarray:
        """Texts with spans filled in."""
        out = np.full(self.shape, "", object)
        for c in self.cells:
            out[c.row : c.row + c.rowspan, c.col : c.col + c.colspan] = c.text
        return out

    def header_rows(self) -> set[int]:
        """Leading rows whose cells are all headers."""
        rows = {c.row for c in self.cells}
        out = set()
        for r in sorted(rows):
            if not all(c.header for c in self.cells if c.row <= r < c.row + c.rowspan):
                break
            out.add(r)
        return out


class _Reader(HTMLParser):
    """Tables of an HTML text; a nested table's text stays in its outer cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, bool, int, int]]]] = []
        self.sections: list[dict[int, tuple[str, int]]] = []
        self.nodes: list[int] = []
        self.depth, self.cell, self.at, self.section = 0, None, None, None

    def handle_starttag(self, tag, attrs):
        if self.depth or tag == "table":
            if not self.depth:
                self.nodes.append(0)
                self.sections.append({})
            self.nodes[-1] += 1
        if self.depth == 1 and tag in ("thead", "tbody", "tfoot"):
            self.section = (tag, len(self.tables[-1]))
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.close_cell()
            self.tables[-1].append([])
            if self.section:
                self.sections[-1][len(self.tables[-1]) - 1] = self.section
        elif self.depth == 1 and tag in ("td", "th"):
            self.close_cell()
            span = {k: int(v) if v and v.isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            self.cell, self.at = [], (tag == "th", max(1, min(span.get("rowspan", 1), 1000)), max(1, min(span.get("colspan", 1), 1000)))
        elif self.cell is not None and tag == "br":
            self.cell.append(" ")
        elif self.cell is not None and tag in ("sup", "sub", "b", "i", "u", "s", "em", "strong"):
            self.cell.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("thead", "tbody", "tfoot"):
            self.close_cell()
            self.section = None
        if tag == "table" and self.depth:
            if self.depth == 1:
                self.close_cell()
                self.section = None
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.close_cell()
        elif self.cell is not None and tag in ("sup", "sub", "b", "i", "u", "s", "em", "strong"):
            self.cell.append(f"</{tag}>")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((re.sub(r"\s+", " ", "".join(self.cell)).strip(), *self.at))
            self.cell = None


def table_slices(text: str) -> list[str]:
    """The HTML of all tables, nested ones, too, in the order in which they begin; one that never ends is left out."""
    open_, out = [], []
    for m in re.finditer(r"(?i)<(/?)table\b[^>]*>", text or ""):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            out.append((open_.pop(), m.end()))
    return [text[a:b] for a, b in sorted(out)]


def html_tables(text: str, nested: bool = False) -> list[Table]:
    """Top-level tables (or all) with their spans resolved: a cell goes to the first free column of its row."""
    if nested:
        return [t for part in table_slices(text) for t in html_tables(part)[:1]]
    if not TABLE.search(text or ""):
        return []
    reader = _Reader()
    reader.feed(text or "")
    reader.close()
    reader.close_cell()
    out = []
    for rows, sections, nodes in zip(reader.tables, reader.sections, reader.nodes, strict=True):
        taken: set[tuple[int, int]] = set()
        table = Table(sections=sections, nodes=nodes)
        for r, row in enumerate(rows):
            c = 0
            for t, head, rs, cs in row:
                while (r, c) in taken:
                    c += 1
                rs = min(rs, len(rows) - r)
                taken.update((r + i, c + j) for i in range(rs) for j in range(cs))
                table.cells.append(Cell(r, c, t, head, rs, cs, sections.get(r, ("", 0))[0] == "thead"))
                c += cs
        if table.cells:
            out.append(table)
    return out


def markdown_tables(text: str) -> list[Table]:
    """Runs of two or more lines with bars; the first row is a header if a rule line follows it. Five lines before and two after are context."""
    lines, out, at = (text or "").split("\n"), [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and "|" in lines[end]:
            end += 1
        if end - at >= 2:
            rows = [[x.strip() for x in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||\|\s*$", "", y))] for y in lines[at:end]]
            rule = lambda r: all(re.fullmatch(r":?-+:?", x or "-") for x in r) and any(r)
            head = len(rows) > 1 and rule(rows[1])
            rows = [r for r in rows if not rule(r)]
            width = max(map(len, rows), default=0)
            t = Table([Cell(i, j, x, head and i == 0) for i, r in enumerate(rows) for j, x in enumerate([*r, *[""] * (width - len(r))])], "\n".join(lines[max(0, at - 5) : at]), after="\n".join(lines[end : end + 2]))
            if t.cells:
                out.append(t)
        at = max(end, at + 1)
    return out


def tables(text: str) -> list[Table]:
    """HTML tables, and markdown tables outside them."""
    return html_tables(text) + markdown_tables(re.sub(r"(?is)<table\b.*?</table>", "", text or ""))


def strip_titles(t: Table, most: int = 1) -> Table:
    """Without leading empty rows, leading full-width data rows, and up to `most` leading full-width header rows that leave a header behind."""
    rows, cols = t.shape
    drop, heads = 0, 0
    while drop < rows - 1:
        own = [c for c in t.cells if c.row == drop]
        wide = len(own) == 1 and own[0].colspan == cols and cols > 1
        empty = all(cell_text(c.text) in EMPTY for c in own)
        if empty or wide and not own[0].header and most:
            drop += 1
        elif wide and own[0].header and heads < most and any(c.row == drop + own[0].rowspan and c.header for c in t.cells):
            drop, heads = drop + own[0].rowspan, heads + 1
        else:
            break
    return Table([Cell(c.row - drop, c.col, c.text, c.header, c.rowspan, c.colspan) for c in t.cells if c.row >= drop], t.context)


def split_merged(t: Table, wanted: int) -> list[Table]:
    """A table that holds several side by side: a period that divides the columns and whose header segments repeat in four of five cells."""
    rows, cols = t.shape
    grid, heads = t.grid(), sorted(t.header_rows()) or [0]
    best = None
    for period in range(1, cols // 2 + 1):
        if cols % period or cols // period < 2:
            continue
        n = cols // period
        same = [K.indel_ratio(cell_text(grid[r, c]), cell_text(grid[r, c + k * period])) >= 0.9 for r in heads for k in range(1, n) for c in range(period)]
        if sum(same) >= 0.8 * len(same):
            score = (abs(n - wanted), -sum(same), -period)
            if best is None or score < best[0]:
                best = (score, period)
    if best is None or wanted < 2 or best[0][0] >= abs(1 - wanted):
        return [t]
    p = best[1]
    return [Table([Cell(c.row, c.col - k * p, c.text, c.header, c.rowspan, min(c.colspan, (k + 1) * p - c.col)) for c in t.cells if k * p <= c.col < (k + 1) * p]) for k in range(cols // p)]


def f_score(hit: float, n_true: int, n_pred: int) -> tuple[float, float, float]:
    p, r = hit / n_pred if n_pred else 0.0, hit / n_true if n_true else 0.0
    return (2 * p * r / (p + r) if p + r else 0.0), p, r


def grits(gt: np.ndarray, pred: np.ndarray) -> dict:
    """Content similarity of two grids: rows and columns aligned apart, then cells that both alignments pair."""
    if not gt.size or not pred.size:
        return {"f": 0.0, "precision": 0.0, "recall": 0.0, "bound": 0.0, "rows": [], "cols": []}
    (a, b), (c, d) = gt.shape, pred.shape
    if max(a * b, c * d) >= BIG_CELLS and (max(a, c) / min(a, c) > BIG_RATIO or max(b, d) / min(b, d) > BIG_RATIO):
        return {"f": 0.0, "precision": 0.0, "recall": 0.0, "bound": 0.0, "rows": [], "cols": []}
    norm = np.vectorize(cell_text, otypes=[object])
    x, ix = np.unique(norm(gt).astype(str), return_inverse=True)
    y, iy = np.unique(norm(pred).astype(str), return_inverse=True)
    score = np.array([[K.gestalt(str(s), str(t)) for t in y] for s in x])
    reward = score[ix.reshape(a, b)[:, :, None, None], iy.reshape(c, d)[None, None, :, :]]

    def outer(r: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
        """r[i, j, k, l]: rewards of cells j and l of rows i and k. All pairs of rows are aligned at once."""
        n, w, m, v = r.shape
        best = np.zeros((w + 1, v + 1, n, m))
        for j in range(w):
            for k in range(v):
                best[j + 1, k + 1] = np.maximum(best[j, k] + r[:, j, :, k], np.maximum(best[j, k + 1], best[j + 1, k]))
        return K.align(best[w, v])

    rows, cols = outer(reward), outer(reward.transpose(1, 0, 3, 2))
    hit = sum(reward[i, j, k, m] for i, k in rows[1] for j, m in cols[1])
    f, p, r = f_score(float(hit), a * b, c * d)
    return {"f": f, "precision": p, "recall": r, "bound": f_score(min(rows[0], cols[0]), a * b, c * d)[0], "rows": rows[1], "cols": cols[1]}


def column_keys(t: Table, heads: set[int]) -> tuple[list[str], list[bool]]:
    """Header texts of each column, levels joined, and whether the key is a made-up one; equal keys get numbers."""
    grid = t.grid()
    raw = [" ".join(dict.fromkeys(x for r in sorted(heads) if (x := cell_text(grid[r, c])))) for c in range(t.shape[1])]
    made = [not k for k in raw]
    raw = [k or f"col_{c}" for c, k in enumerate(raw)]
    n, seen, out = Counter(raw), Counter(), []
    for k in raw:
        out.append(f"{k}_{seen[k]}" if n[k] > 1 else k)
        seen[k] += 1
    return out, made


def same_cell(a: str, b: str) -> bool:
    return a == b or a in EMPTY and b in EMPTY


def record_match(gt: Table, pred: Table) -> float:
    """Rows as records keyed by their columns' headers: columns are matched by similarity from 0.9, rows by equal cells, and what has no partner on either side counts as wrong."""
    gh, ph = gt.header_rows(), pred.header_rows()
    if gh and not ph and pred.shape[0] > 1:  # the prediction lost the header marks, not the header
        keys = column_keys(gt, gh)[0]
        first = [cell_text(x) for x in pred.grid()[0]]
        if any(K.indel_ratio(x, k) >= MATCHED_COLUMN for x in first for k in keys):
            ph = {0}
    if not gh:
        ph = set()
    gk, gm = column_keys(gt, gh)
    pk, pm = column_keys(pred, ph)
    sim = np.array([[K.indel_ratio(a, b) if x == y else 0.0 for b, y in zip(pk, pm, strict=True)] for a, x in zip(gk, gm, strict=True)]).reshape(len(gk), len(pk))
    cols = [(i, j) for i, j in K.assignment(sim) if sim[i, j] >= MATCHED_COLUMN]
    rows = lambda t, h: [[cell_text(x) for x in r] for i, r in enumerate(t.grid()) if i not in h]
    a, b = rows(gt, gh), rows(pred, ph)
    if not cols:
        return 0.0
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    total = len(gk) + len(pk) - len(cols)
    m = np.array([[sum(same_cell(x[i], y[j]) for i, j in cols) / total for y in b] for x in a])
    return float(sum(m[i, j] for i, j in K.assignment(m)) / max(len(a), len(b)))


def consistent(t: Table) -> bool:
    """All rows equally wide and all columns equally high, spans counted."""
    rows, cols = t.shape
    filled = np.zeros((rows, cols), int)
    for c in t.cells:
        filled[c.row : c.row + c.rowspan, c.col : c.col + c.colspan] += 1
    return bool((filled == 1).all())


def document_scores(expected: str, actual: str, *, trm_unsupported: bool = False) -> dict[str, float | None]:
    """Table metrics of a document: tables are paired to maximise content similarity, and unpaired expected ones count 0.

    Where records can't be matched (trm_unsupported), the composite is the content score alone.
    """
    from . import headers, trees

    gt, pred = tables(expected), tables(actual)
    out: dict[str, float | None] = {"tables_expected": float(len(gt)), "tables_actual": float(len(pred)), "structural_consistency": sum(map(consistent, pred)) / len(pred) if pred else 1.0}
    if not gt:
        return out | dict.fromkeys(("tables_paired", "grits_con", "table_record_match", "trm_perfect", *trees.VARIANTS, *(f"header_{k}" for k in (*headers.SUBMETRICS, "perfect", "composite", "generous")), "grits_trm_composite", "table_composite", "table_composite_harmonic"))
    plain = [strip_titles(t) for t in pred]
    if len(gt) > len(plain):
        plain = [s for t in plain for s in split_merged(t, len(gt) - len(plain) + 1)]
    bare, n = [strip_titles(t) for t in gt], len(gt)
    score = np.array([[grits(g.grid(), p.grid())["f"] for p in plain] for g in bare]).reshape(n, len(plain))
    pairs = [(i, j) for i, j in K.assignment(score) if score[i, j] > 0]
    mean = lambda x: float(sum(x)) / n
    rec = [record_match(bare[i], plain[j]) for i, j in pairs]
    own, other = [trees.Tree(t) for t in gt], [trees.Tree(t) for t in pred]
    raw = [[trees.teds(g, p, trees=(x, y)) for p, y in zip(pred, other, strict=True)] for g, x in zip(gt, own, strict=True)]
    best = K.assignment(np.array([[r["teds"] for r in row] for row in raw]).reshape(n, len(pred)))
    out["tables_paired"] = float(len(pairs))
    out["grits_con"] = mean(score[i, j] for i, j in pairs)
    out["table_record_match"] = None if trm_unsupported else mean(rec)
    out["trm_perfect"] = None if trm_unsupported else mean(r == 1.0 for r in rec)
    for v in trees.VARIANTS:
        out[v] = mean(raw[i][j][v] for i, j in best)
    heads = [headers.scores(bare[i], plain[j]) for i, j in pairs]
    for k in (*headers.SUBMETRICS, "perfect", "composite"):
        out[f"header_{k}"] = mean(h[k] for h in heads)
    out["header_generous"] = mean(headers.generous(bare[i], plain[j]) for i, j in pairs)
    out["grits_trm_composite"] = out["grits_con"] if trm_unsupported else (out["grits_con"] + out["table_record_match"]) / 2
    g, h = out["grits_con"], out["header_composite"]
    out["table_composite"], out["table_composite_harmonic"] = g * h, 2 * g * h / (g + h) if g + h else 0.0
    return out


def unescape(text: str, most: int = 2) -> str:
    """Entities decoded, at most twice."""
    for _ in range(most):
        new = html.unescape(text)
        if new == text:
            break
        text = new
    return text
