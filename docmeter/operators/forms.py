"""Form fields in markdown: values beside labels, checkboxes and signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import tables as T
from ..functions.text import strip_marks
from .charts import readings

# Thresholds of label matching, and the marks of boxes.
RATIO, PARTIAL, SHORTEST, PENALTY = 0.8, 0.90, 6, 0.05
ON, OFF = "☑☒✓✔✗✘■●", "☐□○"
YES, NO = {"yes", "true", "checked", "x", "on", "selected"}, {"no", "false", "unchecked", "off", "not selected", ""}
BOX = re.compile(rf"\[\s*([xX✓✔ ]?)\s*\]|([{ON}{OFF}])")


def plain(text: str) -> str:
    t = strip_marks(T.unescape(text or ""))
    return re.sub(r"\s+", " ", re.sub(r"\*\*|__|</?[^>]+>", "", t)).strip().lower()


def bare(text: str) -> str:
    return re.sub(r"[^\w ]+", "", plain(text)).strip()


def label_score(a: str, b: str) -> float:
    """1 without punctuation alike; else similarity from 0.8, or the shorter one found in the longer from 0.9, less a little."""
    x, y = bare(a), bare(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    best = r if (r := K.indel_ratio(x, y)) >= RATIO else 0.0
    if min(len(x), len(y)) >= SHORTEST and (p := K.partial_ratio(x, y)) >= PARTIAL:
        best = max(best, p - PENALTY)
    return best


def candidates(text: str) -> Iterator[tuple[int, str, str]]:
    """(source, label, value) in the order of sources: bold and colon, colon, markdown table, HTML table, underlined fill, blanks, then the next line."""
    lines = (text or "").split("\n")
    for line in lines:
        for m in re.finditer(r"\*\*([^*\n]+?):?\*\*\s*:?\s*([^*\n]*)", line):
            yield 0, m[1], m[2]
    for line in lines:
        if "|" not in line and (m := re.match(r"^\s*(?:[-*+]\s+)?([^:\n*]{1,120}?)\s*:\s+(.*)$", line)):
            yield 1, m[1], m[2]
    for source, found in ((2, T.markdown_tables(text)), (3, T.html_tables(text))):
        for t in found:
            for row in t.grid():
                for c in range(len(row) - 1):
                    yield source, str(row[c]).rstrip(":"), str(row[c + 1])
            grid = t.grid()
            for c in range(grid.shape[1]):
                if grid.shape[0] == 2:
                    yield source, str(grid[0, c]).rstrip(":"), str(grid[1, c])
    for line in lines:
        if m := re.match(r"^\s*(.+?)\s*<u>(.*?)</u>", line):
            yield 4, m[1].rstrip(":"), m[2]
        if m := re.match(r"^\s*(.+?)\s*:?\s*_{3,}\s*(.*?)\s*_*$", line):
            yield 5, m[1], m[2]
    for a, b in zip(lines, lines[1:], strict=False):
        if a.strip() and b.strip() and ":" not in b:
            yield 6, a.strip().rstrip(":"), b.strip()


def same_value(expected: str, found: str) -> bool:
    """Equal after normalisation, or equal numbers; struck-out text does not count on the found side."""
    x, y = plain(expected), plain(re.sub(r"~~.*?~~", "", found or ""))
    if x == y or x.strip(" .") == y.strip(" ."):
        return True
    a, b = readings(x), readings(y)
    return bool(a and b and set(a) & set(b))


def find_value(text: str, label: str, expected: list[str] | None = None) -> str | None:
    """The value of the best label; ties go to the earlier source and place, but an expected value decides among the best. The next line is the last resort."""
    scored = [(label_score(label, c), s, i, v.strip()) for i, (s, c, v) in enumerate(candidates(text))]
    for rank in (lambda s: s < 6, lambda s: s == 6):
        own = [x for x in scored if x[0] > 0 and rank(x[1])]
        if own:
            top = max(x[0] for x in own)
            best = sorted((x for x in own if x[0] == top), key=lambda x: (x[1], x[2]))
            hit = next((x for x in best for e in expected or [] if same_value(e, x[3])), None)
            return (hit or best[0])[3]
    return None


def row_value(text: str, label: str) -> str | None:
    """`Column (row N)`: the cell of that column in the N-th data row."""
    if not (m := re.match(r"^(.*?)\s*\(row\s+(\d+)\)\s*$", label, re.I)):
        return None
    for t in T.tables(text):
        grid = t.grid()
        for c in range(grid.shape[1]):
            if label_score(m[1], str(grid[0, c])) >= RATIO and int(m[2]) < grid.shape[0]:
                return str(grid[int(m[2]), c])
    return None


def boxes(line: str) -> Iterator[tuple[bool, str, str]]:
    """(ticked, text before, text after) of each box on a line."""
    found = list(BOX.finditer(line))
    for i, m in enumerate(found):
        on = m[2] in ON if m[2] else bool(m[1].strip())
        yield on, line[found[i - 1].end() if i else 0 : m.start()].strip(" -*:"), line[m.end() : found[i + 1].start() if i + 1 < len(found) else len(line)].strip(" -*:")


def checkbox_state(text: str, label: str) -> bool | None:
    best: tuple[float, bool] | None = None
    for line in (text or "").split("\n"):
        for on, before, after in boxes(line):
            score = max(label_score(label, after), label_score(label, before) - 0.01 if not after else 0)
            if score and (best is None or score > best[0]):
                best = (score, on)
    if best:
        return best[1]
    value = find_value(text, label)
    return None if value is None else True if plain(value) in YES else False if plain(value) in NO else None


def field(text: str, kind: str, label: str, expected: list[str]) -> bool:
    """The rule: text (any of the values), checkbox (its state), or signature (signed or not; a missing label fails)."""
    if kind == "checkbox":
        state = checkbox_state(text, label)
        return state is not None and state == (plain(expected[0] if expected else "") in YES)
    if kind == "signature":
        value = find_value(text, label)
        return value is not None and bool(plain(value).strip("_ ")) == bool(expected and expected[0])
    value = row_value(text, label)
    value = find_value(text, label, expected) if value is None else value
    if value is None:
        return not any(expected)
    return any(same_value(e, value) for e in expected) if expected else not plain(value)


def field_udf():
    """(text, kind, label, expected array) -> passed."""

    @F.pandas_udf("boolean")
    def run(text: pd.Series, kind: pd.Series, label: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([field(t or "", k, x, list(e) if e is not None else []) for t, k, x, e in zip(text, kind, label, expected, strict=True)])

    return run
