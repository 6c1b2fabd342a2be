"""Numbers of charts: parsing, tolerant matching, similarity, and data points in tables."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import tables as T
from ..functions import text as N

# Scale words at the end of a number, in the order in which they are tried, and how close two numbers are.
SCALES = (("trillion|trill|trn", 1e12), ("billion|bill|bln", 1e9), ("million|mill|mln", 1e6), ("t", 1e12), ("g", 1e9), ("b", 1e9), ("m", 1e6), ("k", 1e3))
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TOLERANCE, CELL_MATCH = 0.01, 0.8
QUARTER = {f"{m:02d}": (m + 2) // 3 for m in range(1, 13)}


def parse_number(text: str) -> float | None:
    """The usual reading: currency marks, an about sign, percent, thousands commas and spaces dropped, a scale word applied."""
    t = re.sub(r"\s*[$€£¥]$", "", re.sub(r"^[$€£¥]\s*", "", (text or "").strip()))
    t = re.sub(r"^[~≈]\s*", "", t).rstrip("%").replace(",", "").replace(" ", "")
    times = 1.0
    for word, scale in SCALES:
        if (m := re.search(rf"(?i)\s*(?:{word})$", t)) is not None:
            t, times = t[: m.start()], scale
            break
    return float(t) * times if re.match(PLAIN_NUMBER, t.strip()) else None


def readings(text: str) -> list[float]:
    """All numbers that a text can mean: a comma stands for thousands or for the decimal point."""
    forms = [text or "", (text or "").replace(",", ".")]
    return list(dict.fromkeys(x for f in forms if (x := parse_number(f)) is not None))


def close(a: float, b: float, tolerance: float = TOLERANCE) -> bool:
    """Within tolerance of the larger one; near zero, within tolerance itself."""
    if a == 0 or b == 0:
        return abs(a - b) < tolerance
    return abs(a - b) <= tolerance * max(abs(a), abs(b))


def same_number(a: str, b: str, tolerance: float = TOLERANCE) -> bool:
    return any(close(x, y, tolerance) for x in readings(a) for y in readings(b))


def number_similarity(expected: float, actual: float) -> float:
    if expected == 0:
        return float(abs(actual) < 0.001)
    return max(0.0, 1 - abs(expected - actual) / abs(expected))


def best_similarity(expected: str, actual: str) -> float | None:
    """Of all readings of both; None if one is no number."""
    return max((number_similarity(x, y) for x in readings(expected) for y in readings(actual)), default=None)


def date_forms(text: str) -> set[str]:
    """A time stamp, month-year, quarter or year, in all the forms that labels use."""
    t = text.strip().lower()
    if m := re.match(r"^(\d{4})-(\d{2})-\d{2}[ t]\d{2}:\d{2}(:\d{2})?", t):
        return {m[1], f"{m[2]}-{m[1]}", f"q{QUARTER.get(m[2], 0)}-{m[1]}"}
    if m := re.match(r"^(\d{1,2})-(\d{4})$", t):
        month = m[1].zfill(2)
        return {m[2], f"{month}-{m[2]}"} | ({f"q{QUARTER[month]}-{m[2]}"} if month in QUARTER else set())
    return {t} if re.match(r"^(q\d-)?\d{4}$", t) else set()


def same_date(a: str, b: str) -> bool:
    return not date_forms(a).isdisjoint(date_forms(b))


def cell_value(expected, actual: str, numbers: bool = True) -> float:
    """Score of a cell: empty meets empty or 0, dates, numbers by relative error (retried at larger scales), else texts by similarity."""
    e = "" if expected is None else str(expected)
    if e.strip() in T.EMPTY and (actual.strip() in T.EMPTY or parse_number(actual) == 0):
        return 1.0
    x, y = N.normalize_py(e), N.normalize_py(actual)
    if x == y or same_date(e, actual):
        return 1.0
    s = best_similarity(e, actual) if numbers else None
    if s is None:
        return K.indel_ratio(x, y)
    if s < CELL_MATCH and (own := parse_number(e)):
        s = max(s, *(best_similarity(str(own / k), actual) or 0.0 for k in (1e3, 1e6, 1e9, 1e12)))
    return s


def label_score(expected, actual: str) -> float:
    """1 for equal texts or dates, similar numbers by their similarity, else mostly similarity, partly containment scaled by length."""
    a, b = N.normalize_py(str(expected)), N.normalize_py(actual)
    if a == b or same_date(str(expected), actual):
        return 1.0
    if (s := best_similarity(str(expected), actual)) is not None and s >= CELL_MATCH:
        return s
    return 0.7 * K.indel_ratio(a, b) + 0.3 * K.partial_ratio(a, b) * min(len(a), len(b)) / max(len(a), len(b), 1)


def best_pairs(score: np.ndarray) -> float:
    """Each row takes, in order, the free column that scores most."""
    total, free = 0.0, set(range(score.shape[1]))
    for row in score:
        k = max(sorted(free), key=lambda j: row[j], default=None)
        if k is not None and row[k] > 0:
            total += row[k]
            free.discard(k)
    return total


def labels_total(headers: list, grid: np.ndarray, shuffled: bool) -> float:
    if grid.shape[1] != len(headers) or not len(grid):
        return 0.0
    score = np.array([[label_score(h, str(x)) for x in grid[0]] for h in headers])
    return best_pairs(score) if shuffled else float(np.trace(score))


def data_total(rows: list[list], grid: np.ndarray, *, columns: bool, lines: bool, numbers: bool) -> float:
    """Sum of cell scores below the first row of grid: by place, with lines or columns in any order, or both."""
    body = grid[1:]
    width = max(map(len, rows), default=0)
    if grid.shape[1] != width or not len(body):
        return 0.0
    cell = lambda i, j, r, c: cell_value(rows[i][j] if j < len(rows[i]) else None, str(body[r, c]), numbers)
    n = min(len(rows), len(body))
    if lines and not columns:
        return best_pairs(np.array([[sum(cell(i, j, r, j) for j in range(width)) for r in range(len(body))] for i in range(len(rows))]))
    if columns and not lines:
        return best_pairs(np.array([[sum(cell(i, j, i, c) for i in range(n)) for c in range(width)] for j in range(width)]))
    if columns:  # a column's values in any order
        return best_pairs(np.array([[sum(max(cell(i, j, r, c) for r in range(len(body))) for i in range(len(rows))) for c in range(width)] for j in range(width)]))
    return sum(cell(i, j, i, j) for i in range(n) for j in range(width))


def array_score(rule: dict, tables: list[T.Table]) -> tuple[float, bool]:
    """Labels or data of a chart against all tables of a document, each as it is and turned; the best counts."""
    data = rule["data"]
    if rule.get("_csv_path") and rule.get("_csv_rows"):  # rows of a file that was read with the rule take the place of data
        data = rule["_csv_rows"]
    turned = [list(x) for x in zip(*data, strict=False)] if rule.get("transposed") else data
    grids = [g for t in tables for g in (t.grid(), t.grid().T)]
    if rule["type"] == "chart_data_array_labels":
        total = len(turned[0])
        best = max((labels_total(turned[0], g, bool(rule.get("x_axis_shuffle"))) for g in grids), default=0.0)
        return (best / total, best >= total - 1e-9) if total else (0.0, False)
    rows = turned[1:]
    total = len(rows) * max(map(len, turned), default=0)
    best = max((data_total(rows, g, columns=bool(rule.get("x_axis_shuffle")), lines=bool(rule.get("y_axis_shuffle")), numbers=rule.get("normalize_numbers", True)) for g in grids), default=0.0)
    return (best / total, best / total >= 0.995) if total else (0.0, False)


def data_point(text: str, value: str, labels: list[str], max_diffs: float = 0, tolerance: float = 0.01) -> bool:
    """A cell of some table has the value, and each label is in its row, its column or the text before the table."""
    for t in T.tables(text):
        grid = t.grid()
        for r, c in zip(*np.nonzero([[same_number(value, T.cell_text(x), tolerance) or T.cell_text(x) == value for x in row] for row in grid]), strict=True):
            near = [T.cell_text(x).lower() for x in (*grid[r], *grid[:, c])]

            def there(label: str) -> bool:
                q = label.lower()
                least = max(0.5, 1 - max_diffs / max(1, len(q)))
                return any(q in x or x and K.partial_ratio(q, x) >= least and len(x) >= len(q) / 2 for x in near) or q in t.context.lower()  # noqa: B023

            if all(map(there, labels)):
                return True
    return False


def to_number(text: Column) -> Column:
    """parse_number in Catalyst; null if there is none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[$€£¥]\s*", ""), r"\s*[$€£¥]$", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[~≈]\s*", ""), "%+$", ""), "[, ]", "")
    scale, body = F.lit(1.0), t
    for word, by in reversed(SCALES):
        here = t.rlike(rf"(?i)(?:{word})$")
        scale, body = F.when(here, F.lit(by)).otherwise(scale), F.when(here, F.regexp_replace(t, rf"(?i)(?:{word})$", "")).otherwise(body)
    return F.when(body.rlike(PLAIN_NUMBER), body.try_cast("double") * scale)


def number_match(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    near = F.abs(a - b)
    return F.coalesce(F.when((a == 0) | (b == 0), near < tolerance).otherwise(near <= tolerance * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    return F.when(a == 0, (F.abs(b) < 0.001).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.abs(F.nullif(a, F.lit(0.0)))))
