"""Boxes: overlap joins, detection metrics, localisation, attribution, reading order, interval unions and line grouping.

Boxes are columns x0, y0, x1, y1. Overlaps are joined on the page, never across pages. gt has: page keys, gt_id, cls and a box; pred: page
keys, pred_id, cls, score and a box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LOCALISED_GT, LOCALISED_PRED = 0.50, 0.20
ATTRIBUTED, TOKEN_F1 = 0.30, 0.80
BAND_X, BAND_Y = 0.80, 0.50
STRICT_IOU, RELAXED_IOU, RELAXED_IOA = 0.50, 0.30, 0.70
AP_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
BOX = ("x0", "y0", "x1", "y1")


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")]


def to_unit(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Pixels to shares of the page."""
    return [(c / (width if i % 2 == 0 else height)).alias(BOX[i]) for i, c in enumerate(box)]


def rescale(box: list[Column], from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> list[Column]:
    return [(c * (to_w / from_w if i % 2 == 0 else to_h / from_h)).alias(BOX[i]) for i, c in enumerate(box)]


def area(p: str) -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def overlaps(gt: DataFrame, pred: DataFrame, page: list[str]) -> DataFrame:
    """Pairs of boxes of a page with inter, iou, ioa_gt and ioa_pred; only pairs that touch."""
    g = gt.select(*page, "gt_id", F.col("cls").alias("g_cls"), *(F.col(c).alias(f"g_{c}") for c in BOX))
    p = pred.select(*page, "pred_id", F.col("cls").alias("p_cls"), "score", *(F.col(c).alias(f"p_{c}") for c in BOX))
    j = g.join(p, page).where((F.col("g_x0") < F.col("p_x1")) & (F.col("p_x0") < F.col("g_x1")) & (F.col("g_y0") < F.col("p_y1")) & (F.col("p_y0") < F.col("g_y1")))
    w, h = F.least("g_x1", "p_x1") - F.greatest("g_x0", "p_x0"), F.least("g_y1", "p_y1") - F.greatest("g_y0", "p_y0")
    j = j.withColumn("inter", w * h).withColumn("g_area", area("g_")).withColumn("p_area", area("p_"))
    return j.withColumns({"iou": F.try_divide(F.col("inter"), F.col("g_area") + F.col("p_area") - F.col("inter")), "ioa_gt": F.try_divide("inter", "g_area"), "ioa_pred": F.try_divide("inter", "p_area")})


def best_match(pairs: DataFrame, page: list[str]) -> DataFrame:
    """For each ground-truth box the localised prediction with the largest IoU, ties to the smallest id."""
    ok = pairs.where((F.col("ioa_gt") >= LOCALISED_GT) & (F.col("ioa_pred") >= LOCALISED_PRED))
    return ok.groupBy(*page, "gt_id").agg(F.min(F.struct((-F.col("iou")).alias("m"), F.col("pred_id"), F.col("p_cls"), F.col("g_cls"), F.col("iou"))).alias("b")).select(*page, "gt_id", "b.pred_id", "b.g_cls", "b.p_cls", "b.iou")


def layout_rules(gt: DataFrame, matches: DataFrame, page: list[str]) -> DataFrame:
    """gt_id with localised and classified."""
    m = matches.select(*page, "gt_id", "pred_id", "p_cls")
    return gt.select(*page, "gt_id", "cls").join(m, [*page, "gt_id"], "left").withColumn("localised", F.col("pred_id").isNotNull()).withColumn("classified", F.coalesce(F.col("cls") == F.col("p_cls"), F.lit(False)))


def groups(rows: pa.RecordBatch, by: list[int]) -> np.ndarray:
    """Numbers of runs of rows that are equal in some columns, which hold no nulls."""
    new = np.zeros(rows.num_rows, np.int64)
    for c in by:
        x = rows.column(c)
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def greedy_all(pairs: DataFrame, keys: list[str], thresholds: tuple[float, ...], *, any_class: bool = False) -> DataFrame:
    """threshold and matches for each threshold, in one pass: predictions by score, each takes the free box with the largest IoU from the threshold on.

    Pages are brought together by one shuffle and read as a stream, many to a batch; a page's pairs are its bound.
    """
    ok = pairs.where(F.col("iou") >= min(thresholds))
    if not any_class:
        ok = ok.where(F.col("g_cls") == F.col("p_cls"))
    by = keys if any_class else [*keys, "g_cls"]
    cols = [*keys, "gt_id", "pred_id", "g_cls", "p_cls", "score", "iou"]
    order = [F.col("score").desc(), F.col("pred_id"), F.col("iou").desc(), F.col("gt_id")]
    rows = ok.select(*cols).repartition(*keys).sortWithinPartitions(*by, *order)
    at = {c: i for i, c in enumerate(cols)}

    def matched(part: pa.RecordBatch) -> pa.RecordBatch:
        """Matches of whole groups. A pair whose boxes are in no other pair is matched up to its IoU; only the others take turns."""
        group = groups(part, [at[c] for c in by])
        iou = part.column(at["iou"]).to_numpy(zero_copy_only=False)
        alone = np.ones(part.num_rows, bool)
        for c in ("gt_id", "pred_id"):
            code = part.column(at[c]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, which, n = np.unique(group * (part.num_rows + 1) + code, return_inverse=True, return_counts=True)
            alone &= n[which] == 1
        take = [np.flatnonzero(alone & (iou >= t)) for t in thresholds]
        level = [np.full(len(i), t) for i, t in zip(take, thresholds, strict=True)]
        if len(rest := np.flatnonzero(~alone)):
            own = part.take(pa.array(rest))
            here, more, levels = -1, [], []
            for i, k, g, p, x in zip(rest.tolist(), group[rest].tolist(), own.column(at["gt_id"]).to_pylist(), own.column(at["pred_id"]).to_pylist(), iou[rest].tolist(), strict=True):
                if k != here:
                    here, free = k, {t: (set(), set()) for t in thresholds}
                for t, (gs, ps) in free.items():
                    if x >= t and g not in gs and p not in ps:
                        gs.add(g)
                        ps.add(p)
                        more.append(i)
                        levels.append(t)
            take.append(np.array(more, np.int64))
            level.append(np.array(levels, float))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(level)), *part.take(pa.array(np.concatenate(take))).columns], names=["threshold", *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch])
            starts = np.flatnonzero(np.diff(groups(ends, [at[c] for c in by]))) + (0 if held else 1)
            if len(starts):
                yield matched(pa.concat_batches([*held, batch.slice(0, int(starts[-1]))]))
                held, batch = [], batch.slice(int(starts[-1]))
            held.append(batch)
        if held:
            yield matched(pa.concat_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, "threshold double, " + ", ".join(f"{c} {kinds[c]}" for c in cols))


def greedy(pairs: DataFrame, keys: list[str], least: float = 0.5, *, any_class: bool = False) -> DataFrame:
    """Greedy matches at one threshold."""
    return greedy_all(pairs, keys, (least,), any_class=any_class).drop("threshold")


def class_scores(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """cls, support, tp, fp, fn, precision, recall, f1 of the classes of the ground truth."""
    n = gt.groupBy("cls").agg(F.count(F.lit(1)).alias("support"))
    p = pred.groupBy("cls").agg(F.count(F.lit(1)).alias("preds"))
    t = matches.groupBy(F.col("g_cls").alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    j = n.join(p, "cls", "left").join(t, "cls", "left").fillna(0, ["preds", "tp"])
    j = j.withColumns({"fp": F.col("preds") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    j = j.withColumns({"precision": F.coalesce(F.try_divide("tp", "preds"), F.lit(0.0)), "recall": F.try_divide("tp", "support")})
    return j.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).drop("preds")


def mean_ap(gt: DataFrame, pred: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """threshold, cls, ap, for the thresholds 0.50 to 0.95 and the classes of the ground truth: one pass of matching, then counts by score."""
    hits = greedy_all(pairs, keys, AP_THRESHOLDS).groupBy("threshold", F.col("p_cls").alias("cls"), "score").agg(F.count(F.lit(1)).alias("h"))
    levels = F.explode(F.array(*map(F.lit, AP_THRESHOLDS))).alias("threshold")
    n = pred.groupBy("cls", "score").agg(F.count(F.lit(1)).alias("n")).select(levels, "cls", "score", "n")
    d = n.join(hits, ["threshold", "cls", "score"], "left").fillna(0, ["h"])
    w = Window.partitionBy("threshold", "cls").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("prec", F.sum("h").over(w) / F.sum("n").over(w)).groupBy("threshold", "cls").agg(F.try_divide(F.sum(F.col("prec") * F.col("h")), F.sum("h")).alias("ap"))
    return gt.select("cls").distinct().select(levels, "cls").join(d, ["threshold", "cls"], "left").fillna(0.0, ["ap"])


def confusion(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """g_cls, p_cls, n and percent of the row; unmatched boxes meet the class (none)."""
    hit = matches.select(*keys, "gt_id", "pred_id", "g_cls", "p_cls")
    miss = gt.select(*keys, "gt_id", F.col("cls").alias("g_cls")).join(hit.select(*keys, "gt_id"), [*keys, "gt_id"], "left_anti").select("g_cls", F.lit("(none)").alias("p_cls"))
    extra = pred.select(*keys, "pred_id", F.col("cls").alias("p_cls")).join(hit.select(*keys, "pred_id"), [*keys, "pred_id"], "left_anti").select(F.lit("(none)").alias("g_cls"), "p_cls")
    cells = hit.select("g_cls", "p_cls").unionByName(miss).unionByName(extra).groupBy("g_cls", "p_cls").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("g_cls")))


def union_length(rows: DataFrame, by: list[str], lo: str, hi: str, name: str = "length") -> DataFrame:
    """by, length: how much of the line the intervals of a group cover together."""
    w = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where(F.col(hi) > F.col(lo)).withColumn("__top", F.max(hi).over(w))
    gain = F.greatest(F.col(hi) - F.greatest(F.coalesce("__top", F.col(lo)), F.col(lo)), F.lit(0))
    return rows.withColumn("__gain", gain).groupBy(*by).agg(F.sum("__gain").alias(name))


def band_cover(gt: DataFrame, pairs: DataFrame, page: list[str]) -> DataFrame:
    """Page furniture: gt_id, x_span, y_cover and localised, from all predictions with a fifth of their area in the band."""
    own = pairs.where(F.col("ioa_pred") >= LOCALISED_PRED)
    for c in BOX:
        own = own.withColumn(f"c_{c}", (F.greatest if c.endswith("0") else F.least)(f"g_{c}", f"p_{c}"))
    keys = [*page, "gt_id"]
    span = own.groupBy(*keys).agg(((F.max("c_x1") - F.min("c_x0")) / F.first(F.col("g_x1") - F.col("g_x0"))).alias("x_span"), F.first(F.col("g_y1") - F.col("g_y0")).alias("height"))
    y = union_length(own.select(*keys, "c_y0", "c_y1"), keys, "c_y0", "c_y1")
    j = gt.select(*keys).join(span, keys, "left").join(y, keys, "left")
    j = j.select(*keys, F.least(F.coalesce("x_span", F.lit(0.0)), F.lit(1.0)).alias("x_span"), F.least(F.coalesce(F.col("length") / F.col("height"), F.lit(0.0)), F.lit(1.0)).alias("y_cover"))
    return j.withColumn("localised", (F.col("x_span") >= BAND_X) & (F.col("y_cover") >= BAND_Y))


def local_order(rows: DataFrame, page: list[str], reach: int = 3) -> DataFrame:
    """rows (page, ro_index, element, pred_order) with passed: after the `reach` rows before and before those behind; a row alone fails."""
    w = Window.partitionBy(*page).orderBy("ro_index", "element")
    before, after = F.max("pred_order").over(w.rowsBetween(-reach, -1)), F.min("pred_order").over(w.rowsBetween(1, reach))
    p = F.col("pred_order")
    ok = F.coalesce(before < p, F.lit(True)) & F.coalesce(after > p, F.lit(True)) & (before.isNotNull() | after.isNotNull())
    return rows.withColumn("passed", ok)


def order_accuracy(rows: DataFrame, page: list[str]) -> DataFrame:
    """page, adjacent, pairwise: shares of neighbours, and of all pairs, of a page in the right order; 1 below two rows. Pairs stay within a page."""
    w = Window.partitionBy(*page).orderBy("ro_index", "element")
    adj = rows.withColumn("nxt", F.lead("pred_order").over(w)).groupBy(*page).agg(F.count("nxt").alias("m"), F.count(F.when(F.col("pred_order") <= F.col("nxt"), 1)).alias("ok"))
    # All pairs of a page are counted inside its row, none are made.
    own = rows.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("ro_index", "element", "pred_order"))), lambda x: x["pred_order"]).alias("o"))
    n = F.size("o")
    later = F.transform("o", lambda x, i: F.size(F.filter(F.slice("o", i + 2, n), lambda y: y >= x)))
    pair = own.select(*page, (n * (n - 1) / 2).alias("pm"), F.aggregate(later, F.lit(0), lambda a, b: a + b).alias("pok"))
    return adj.join(pair, page, "left").select(*page, F.when(F.col("m") > 0, F.col("ok") / F.col("m")).otherwise(1.0).alias("adjacent"), F.when(F.col("pm") > 0, F.col("pok") / F.col("pm")).otherwise(1.0).alias("pairwise"))


def union_area(boxes: list[tuple[float, float, float, float]]) -> float:
    """Area that boxes cover together: slabs between their x bounds."""
    xs, total = sorted({x for b in boxes for x in (b[0], b[2])}), 0.0
    for lo, hi in zip(xs, xs[1:], strict=False):
        top = None
        for y0, y1 in sorted((b[1], b[3]) for b in boxes if b[0] <= lo and b[2] >= hi and b[3] > b[1]):
            y0 = y0 if top is None else max(y0, top)
            if y1 > y0:
                total += (hi - lo) * (y1 - y0)
                top = y1
    return total


def lines(cells: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line, text: cells of a box, by height, a new line where the middle drops by more than half the mean height."""
    all_ = Window.partitionBy(*keys)
    by = all_.orderBy("yc", "x0")
    c = cells.withColumn("yc", (F.col("y0") + F.col("y1")) / 2).withColumn("mean", F.avg(F.col("y1") - F.col("y0")).over(all_))
    c = c.withColumn("new", F.when(F.col("yc") - F.lag("yc").over(by) > F.col("mean") / 2, 1).otherwise(0)).withColumn("line", F.sum("new").over(by))
    return c.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", F.col(text).alias("t")))), lambda s: s["t"]), " ").alias("text"))


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """page, box_id, cell_id: each cell goes to the first box of its page that holds its centre."""
    cx, cy = (F.col("c.x0") + F.col("c.x1")) / 2, (F.col("c.y0") + F.col("c.y1")) / 2
    on = [F.col(f"c.{k}") == F.col(f"b.{k}") for k in page]
    j = cells.alias("c").join(boxes.alias("b"), on).where((cx >= F.col("b.x0")) & (cx <= F.col("b.x1")) & (cy >= F.col("b.y0")) & (cy <= F.col("b.y1")))
    return j.groupBy(*(F.col(f"c.{k}").alias(k) for k in page), F.col("c.cell_id").alias("cell_id")).agg(F.min("b.box_id").alias("box_id"))


def project_labels(boxes: DataFrame, label_map: DataFrame, label: str = "raw_label") -> DataFrame:
    """Boxes with the canonical class; unmapped ones are dropped. A label map has some hundred rows at most."""
    return boxes.join(F.broadcast(label_map), label)
