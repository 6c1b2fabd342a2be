"""Packing into sequences of a fixed capacity: a configuration program over the length histogram, then best fit.

Only the histogram of lengths, at most `capacity` rows, comes to the driver. There:

1. Lengths from `sand` tokens up are grouped in at most `classes` classes of about equal numbers of items, each as large as its longest item. A
   configuration is a multiset of classes that fits a sequence. The linear program asks for amounts x of configurations, as few as possible, that
   cover all items of each class. It is solved by multiplicative weights: a class has the weight exp(-how often it is covered); a knapsack
   dynamic program finds the configuration of the largest weight for its items; some of it is added, so little that no class gets more than
   `eps` further; when all are covered ln(classes) / eps times, x is divided by the least cover. That is a fractional solution; the
   weights of each step give a lower bound by duality. Both are returned by `program`.
2. Rounding: amounts become whole numbers by systematic sampling of their running sum, so that any stretch of configurations keeps its total.
   The slots are filled with the longest items of their classes first, so groups of equal sequences stay few; a slot of a class that has run out
   stays empty.
3. What remains, the sand above all, goes by best fit, longest first, into the space left in these groups and then into new
   sequences; all in terms of counts, so the work depends on the number of lengths, not of documents. If best fit from
   the start needs fewer sequences than the rounded program, as it can where items are few, its plan is taken.

The plan, ranks of each length -> sequence and offset, has a row for each group and length and is shipped to the executors,
where pieces, numbered within their length in two levels (no length is numbered by a single task), look up their places.

Defined cases: a null text is empty; every document ends with the id `end`, so an empty one is a piece of one token; only
longer documents than `capacity` are cut; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import claim, register, schema_with, stored

_units: dict[str, bpe.Units] = {}
register("packing", _units.clear)


def dearest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of largest price: place in sizes -> how many. Unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    use = [(k, int(s), float(p)) for k, (s, p) in enumerate(zip(sizes, prices, strict=True)) if p > 0 and s <= capacity]
    layers = []  # the table after each item, to read the choice back
    for _, s, p in use:
        for at in range(s, capacity + 1, s):  # a stretch of s places only looks at the one before it
            np.maximum(best[at : at + s], best[at - s : at][: len(best) - at] + p, out=best[at : at + s])
        layers.append(best.copy())
    out: dict[int, int] = defaultdict(int)
    c = capacity
    for i in range(len(use) - 1, -1, -1):
        k, s, p = use[i]
        before = layers[i - 1] if i else np.zeros(capacity + 1)
        while c >= s and layers[i][c] > before[c]:
            out[k] += 1
            c -= s
    return dict(out)


def program(sizes: list[int], counts: list[int], capacity: int, *, eps: float = 0.3) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations (place in sizes -> how many) with amounts that cover all counts, and a lower bound on any such total."""
    size, n = np.array(sizes, np.int64), np.array(counts, float)
    cover, goal, bound, amount = np.zeros(len(n)), np.log(len(n) + 1) / eps, 0.0, defaultdict(float)
    while len(n) and (live := cover < goal).any():
        weight = np.where(live, np.exp(-cover), 0.0)
        found = dearest(size, weight / n, capacity)
        k, a = np.array(list(found)), np.array(list(found.values()), float)
        bound = max(bound, weight.sum() / (weight[k] / n[k] * a).sum())
        step = eps * (n[k] / a).min()
        amount[tuple(sorted(found.items()))] += step
        cover[k] += step * a / n[k]
    least = cover.min(initial=np.inf)
    return [(dict(c), x / least) for c, x in amount.items()], bound


def rounded(amounts: list[tuple[dict[int, int], float]]) -> list[tuple[dict[int, int], int]]:
    """Whole numbers whose running sum stays within one half of that of the amounts."""
    out, total, done = [], 0.0, 0
    for config, x in sorted(amounts, key=lambda c: sorted(c[0].items(), reverse=True)):
        total += x
        m = int(total + 0.5) - done
        done += m
        if m:
            out.append((config, m))
    return out


def grouped(hist: dict[int, int], classes: int) -> list[list[int]]:
    """Lengths in at most `classes` groups of neighbours with about equal numbers of items."""
    total, out, seen = sum(hist.values()), [], 0
    for s in sorted(hist):
        k = seen * classes // total
        seen += hist[s]
        if not out or k != out[-1][0]:
            out.append((k, []))
        out[-1][1].append(s)
    return [own for _, own in out]


Groups = list[tuple[list[tuple[int, int]], int]]


def plan(hist: dict[int, int], capacity: int, *, sand: int | None = None, classes: int = 40, unit: int = 4, eps: float = 0.3) -> tuple[Groups, dict[str, float]]:
    """Groups of equal sequences: their items [(length, how many)], and how many sequences; all items of hist are placed.

    With them the numbers of sequences: fractional and bound of the program for lengths from sand (an eighth of the capacity), rounded
    (the whole plan by it), best_fit (without it) and taken.
    """
    hist = {s: n for s, n in hist.items() if n > 0}
    large = {s: n for s, n in hist.items() if s >= (capacity // 8 if sand is None else sand)}
    own = grouped(large, classes) if large else []
    amounts, bound = program([-(-c[-1] // unit) for c in own], [sum(large[s] for s in c) for c in own], capacity // unit, eps=eps)
    by_program, alone = filled(hist, capacity, own, rounded(amounts)), filled(hist, capacity, [], [])
    count = lambda groups: sum(m for _, m in groups)
    best = min((by_program, alone), key=count)
    return best, {"fractional": sum(x for _, x in amounts), "bound": bound, "rounded": count(by_program), "best_fit": count(alone), "taken": count(best)}


def filled(hist: dict[int, int], capacity: int, classes: list[list[int]], chosen: list[tuple[dict[int, int], int]]) -> Groups:
    """The chosen configurations (place in classes -> how many) with items in their slots, and all other items by best fit."""
    left = dict(hist)
    open_: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # space left -> groups (linked items, sequences)
    stock = [list(c) for c in classes]  # lengths that are left, the longest last
    for config, times in chosen:
        slots = [k for k, a in sorted(config.items(), reverse=True) for _ in range(a)]
        while times:  # a run of sequences with the same lengths in the same slots
            picked, need = [], defaultdict(int)
            for k in slots:
                while stock[k] and not left[stock[k][-1]]:
                    stock[k].pop()
                s = next((x for x in reversed(stock[k]) if left[x] > need[x]), None)
                if s is not None:
                    need[s] += 1
                    picked.append(s)
            if not picked:
                break
            run = min(times, *(left[s] // need[s] for s in picked))
            for s in set(picked):
                left[s] -= need[s] * run
            items: tuple = ()
            for s in picked:
                items = (s, 1, items)
            open_[capacity - sum(picked)].append((items, run))
            times -= run
    for s in sorted(left, reverse=True):
        n = left[s]
        space = s
        while n:
            while space < capacity and not open_.get(space):
                space += 1
            # The tightest sequence stays so until it is full: all of a group's but one get as many as fit.
            items, m = open_[space].pop() if open_.get(space) else ((), n)
            per = space // s
            full = min(m, n // per)
            if full:
                open_[space - per * s].append(((s, per, items), full))
            some = min(n - full * per, per) if m > full else 0
            if some:
                open_[space - some * s].append(((s, some, items), 1))
            if items and m > full + (some > 0):
                open_[space].append((items, m - full - (some > 0)))
            n -= full * per + some
    groups = []
    for own in open_.values():
        for items, m in own:
            seen: dict[int, int] = defaultdict(int)
            while items:
                seen[items[0]] += items[1]
                items = items[2]
            groups.append((sorted(seen.items(), reverse=True), m))
    return groups


def places(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Rows sorted by (length, first rank): ranks of a length from `first` on go `per` to a sequence, from `sequence` on, at `offset`."""
    rows, used, sequence = [], defaultdict(int), 0
    for items, m in sorted(groups, reverse=True):
        at = 0
        for s, a in items:
            rows.append((s, used[s], a, sequence, at))
            used[s] += a * m
            at += a * s
        sequence += m
    cols = np.array(sorted(rows), np.int64).reshape(len(rows), 5)
    return dict(zip(("length", "first", "per", "sequence", "offset"), cols.T.copy(), strict=True))


def cut(docs: DataFrame, *, id_col: str, text: str, vocabulary: str, capacity: int, end: int, cached: int = 600_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        if vocabulary not in _units:
            _units[vocabulary] = bpe.word_units(bpe.load(vocabulary), cached)
        units = _units[vocabulary]
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = bpe.word_ids(t or "", units) + tail
                n = len(ids) // 4
                for j, at in enumerate(range(0, n, capacity)):
                    one = ids[4 * at : 4 * (at + capacity)] if n > capacity else ids
                    row.append(i)
                    piece.append(j)
                    start.append(at)
                    length.append(len(one) // 4)
                    crc.append(zlib.crc32(one))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, *, length: str = "length", order: list[str], capacity: int = 4096) -> DataFrame:
    """pieces (a stored table) with sequence_id and offset. The column length is at most capacity; order names columns that tell most rows apart."""
    spark = pieces.sparkSession
    hist = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    total = sum(hist.values())
    shared = spark.sparkContext.broadcast(places(plan(hist, capacity)[0]))
    # Numbers within a length, in two levels: at most capacity + 20 000 parts of a few hundred rows or more.
    most = max(256, total // 20_000)
    parts = spark.createDataFrame([(s, -(-n // most)) for s, n in hist.items()], "p_length long, parts int")
    # Rows that are alike are told apart by where they are stored, so that a third of them is no hot part.
    rows = pieces.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(parts), F.col(length) == F.col("p_length")).withColumn("part", F.pmod(F.xxhash64(*order, "__row"), F.col("parts")).cast("int")).drop("p_length", "parts")
    counts = rows.groupBy(F.col(length).alias("c_length"), F.col("part").alias("c_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c_length").orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("c_length", "c_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(length, "part").orderBy(*order, "__row")
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1)
    rows = rows.join(F.broadcast(base), (F.col(length) == F.col("c_length")) & (F.col("part") == F.col("c_part"))).withColumn("rank", F.col("rank") + F.col("base")).drop("c_length", "c_part", "base", "part", "__row")
    names = [c for c in rows.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        by_length = {int(s): (a, b) for s, a, b in zip(*(lambda u, i: (u, i, [*i[1:], len(p["length"])]))(*np.unique(p["length"], return_index=True)), strict=True)}
        for batch in batches:
            s = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            for one in np.unique(s):
                a, b = by_length[int(one)]
                at = np.flatnonzero(s == one)
                k = a + np.searchsorted(p["first"][a:b], rank[at], side="right") - 1
                d = rank[at] - p["first"][k]
                seq[at] = p["sequence"][k] + d // p["per"][k]
                off[at] = p["offset"][k] + d % p["per"][k] * one
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema_with(rows, names, [("sequence_id", "long"), ("offset", "long")]))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", capacity: int = 4096, end: int = 1) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id and offset of every piece. The pieces, without texts, are stored once."""
    pieces = stored(cut(docs, id_col=id_col, text=text, vocabulary=vocabulary, capacity=capacity, end=end))
    return pack(pieces, order=["id", "piece", "ids_crc32"], capacity=capacity).withColumnRenamed("id", id_col)
