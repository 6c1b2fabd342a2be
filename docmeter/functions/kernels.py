"""String, sequence and assignment kernels, in plain Python and numpy; Arrow functions call them."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: Sequence, b: Sequence) -> float:
    """2 * LCS / (len a + len b); 1 for two empty strings."""
    if type(a) is type(b) and a == b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string and a window of the longer one, windows at the ends being shorter."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    n, known, best = len(a), set(a), 0.0
    for end in range(1, len(b) + n):
        lo, hi = max(0, end - n), min(end, len(b))
        # A window that ends or starts with a character foreign to a has a shorter one that is at least as good.
        if (end <= len(b) and b[hi - 1] not in known) or (end > len(b) and b[lo] not in known):
            continue
        best = max(best, indel_ratio(a, b[lo:hi]))
        if best == 1.0:
            break
    return best


def near_matches(query: str, text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of substrings within edit distance `most`, one for each run of overlapping ends: the best, then the first."""
    m = len(query)
    if not m:
        return []
    if most < m and not any(query[m * i // (most + 1) : m * (i + 1) // (most + 1)] in text for i in range(most + 1)):
        return []  # of most + 1 parts, most edits leave one whole
    col, start, found = list(range(m + 1)), [0] * (m + 1), []
    for j, c in enumerate(text, 1):
        diag, diag_s = col[0], start[0]
        col[0], start[0] = 0, j
        for i in range(1, m + 1):
            up, left = col[i - 1] + 1, col[i] + 1
            best, s = diag + (query[i - 1] != c), diag_s
            if left < best:
                best, s = left, start[i]
            if up < best:
                best, s = up, start[i - 1]
            diag, diag_s = col[i], start[i]
            col[i], start[i] = best, s
        if col[m] <= most:
            found.append((start[m], j, col[m]))
    out: list[tuple[int, int, int]] = []
    for f in found:
        if out and f[0] < out[-1][1]:
            if f[2] < out[-1][2]:
                out[-1] = f
        else:
            out.append(f)
    return out


def edit_distance(a: Sequence, b: Sequence) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(diag + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def text_distances(xs: list[str], ys: list[str], longest: int = 48) -> np.ndarray:
    """Edit distance over the longer length, of all pairs; short texts are compared all at once, one matrix place at a time."""
    out = np.zeros((len(xs), len(ys)))
    short = [[i for i, t in enumerate(ts) if len(t) <= longest] for ts in (xs, ys)]
    own = [[ts[i] for i in ix] for ts, ix in zip((xs, ys), short, strict=True)]
    if own[0] and own[1]:
        size = [np.array([len(t) for t in ts]) for ts in own]
        code = [np.array([[ord(c) for c in t] + [0] * (n.max(initial=0) - len(t)) for t in ts], np.int32).reshape(len(ts), -1) for ts, n in zip(own, size, strict=True)]
        done = np.zeros((len(own[0]), len(own[1])), np.int16)
        above = [np.full(done.shape, j, np.int16) for j in range(code[1].shape[1] + 1)]
        for i in range(code[0].shape[1] + 1):
            if i:
                row = [np.full(done.shape, i, np.int16)]
                for j in range(1, len(above)):
                    step = above[j - 1] + (code[0][:, i - 1, None] != code[1][None, :, j - 1])
                    row.append(np.minimum(np.minimum(above[j], row[j - 1]) + 1, step).astype(np.int16))
                above = row
            for k in np.flatnonzero(size[0] == i).tolist():
                done[k] = [above[n][k, c] for c, n in enumerate(size[1].tolist())]
        out[np.ix_(short[0], short[1])] = done / np.maximum(np.maximum(size[0][:, None], size[1][None, :]), 1)
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            if max(len(x), len(y)) > longest and x != y:
                out[i, j] = edit_distance(x, y) / max(len(x), len(y))
    return out


def similarity(a: str, b: str) -> float:
    """1 - edit distance / longer length."""
    return 1.0 if a == b else 1 - edit_distance(a, b) / max(len(a), len(b))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of what is missing for each of up to four equal first characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (y for j, y in enumerate(b) if used[j]), strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(200_000)
def _gestalt(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


_short_gestalt = lru_cache(100_000)(_gestalt)


def gestalt(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; not symmetric. Pairs of short texts are remembered."""
    return _short_gestalt(a, b) if len(a) + len(b) <= 128 else _gestalt(a, b)


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that maximise the total score, each used once: shortest augmenting paths with potentials."""
    score = np.asarray(score, float)
    if not score.size:
        return []
    turned = score.shape[0] > score.shape[1]
    cost = -(score.T if turned else score)
    n, m = cost.shape
    u, v, of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = i, -1
        while True:
            slack = cost[row] - u[row] - v + (dist[col] if col >= 0 else 0)
            better = ~done & (slack < dist)
            dist[better], before[better] = slack[better], col
            free = np.where(done, np.inf, dist)
            col = int(free.argmin())
            done[col] = True
            if of[col] < 0:
                break
            row = of[col]
        end = dist[col]
        for j in np.flatnonzero(done):
            if of[j] >= 0:
                u[of[j]] += end - dist[j]
            v[j] -= end - dist[j]
        u[i] += end
        while col >= 0:
            of[col] = of[before[col]] if before[col] >= 0 else i
            col = before[col]
    pairs = [(int(of[j]), j) for j in range(m) if of[j] >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def align(reward: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Best monotone alignment of two sequences: total reward and pairs."""
    n, m = reward.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        for j in range(m):
            best[i + 1, j + 1] = max(best[i, j] + reward[i, j], best[i, j + 1], best[i + 1, j])
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j - 1] + reward[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return float(best[n, m]), pairs[::-1]


def ratio_udf(kind: str):
    """Arrow function of two texts: indel, partial, jaro_winkler, edit or gestalt."""
    kernel = {"indel": indel_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler, "edit": similarity, "gestalt": gestalt}[kind]

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio
