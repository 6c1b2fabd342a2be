"""Layout scoring of whole pages: localisation, classification and attribution of each element, token scores of the page.

Elements (gt) and predictions of a page are brought together by one shuffle and read as a stream of pages, many to a batch; a page is its natural bound.
gt: page keys, id, cls, x0, y0, x1, y1, tokens, and if there are any, explicit, caption (booleans) and furniture (boolean: a header or footer band).
pred: page keys, id, cls, rank (reading order), a box and tokens. Overlap is the larger share of either box that the other covers.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boxes import ATTRIBUTED, BAND_X, BAND_Y, BOX, LOCALISED_GT, LOCALISED_PRED, TOKEN_F1, union_area

FIELDS = {"id": "long", "cls": "string", "rank": "long", **dict.fromkeys(BOX, "double"), "tokens": "array<string>", "explicit": "boolean", "caption": "boolean", "furniture": "boolean"}
ELEMENT = "id long, cls string, pred_id long, localised boolean, classified boolean, attribution double, attributed boolean, passed boolean"
#: Places of a page's table of counts, elements by kinds of tokens: 128 MB.
DENSE = 16_000_000
PAGE = "lap double, lar double, af1 double, grounding double, pred_tokens long, gt_tokens long"


class Bag:
    """How often each of a page's tokens occurs, as a row of a page's table of counts; with the operators of a Counter."""

    __slots__ = ("n",)

    def __init__(self, n: np.ndarray) -> None:
        self.n = n

    def __and__(self, other: Bag) -> Bag:
        return Bag(np.minimum(self.n, other.n))

    def __add__(self, other: Bag) -> Bag:
        return Bag(self.n + other.n)

    def __sub__(self, other: Bag) -> Bag:
        return Bag(np.maximum(self.n - other.n, 0))

    def __bool__(self) -> bool:
        return bool(self.n.any())

    def total(self) -> int:
        return int(self.n.sum())


Tokens = Counter | Bag


def together(bags: list[Tokens]) -> Tokens | None:
    """All bags as one; None if there are none."""
    return functools.reduce(operator.add, bags) if bags else None


def bags_of(texts: list[pa.Array]) -> list[Tokens]:
    """The bags of a page's elements: rows of one table, or Counters where that would have more than DENSE places."""
    if not any(map(len, texts)):
        return [Counter()] * len(texts)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    coded = pa.concat_arrays(texts).dictionary_encode()
    wide = len(coded.dictionary)
    if len(texts) * wide > DENSE:
        return [Counter(t.to_pylist()) for t in texts]
    at = coded.indices.fill_null(wide).to_numpy(zero_copy_only=False).astype(np.int64)  # a null token is a token of its own
    wide += 1
    return [Bag(n) for n in np.bincount(rows * wide + at, minlength=len(texts) * wide).reshape(len(texts), wide)]


@dataclass
class Part:
    """Boxes of one side of a page."""

    id: list[int] = field(default_factory=list)
    cls: list[str] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    box: list[tuple[float, ...]] = field(default_factory=list)
    tokens: list[Tokens] = field(default_factory=list)
    marks: list[tuple[bool, bool, bool]] = field(default_factory=list)

    def boxes(self) -> np.ndarray:
        return np.array(self.box, float).reshape(len(self.box), 4)


@dataclass
class Overlap:
    """Matrices (gt, pred): intersection over union, and over either side."""

    iou: np.ndarray
    of_gt: np.ndarray
    of_pred: np.ndarray

    @classmethod
    def of(cls, gt: Part, pred: Part) -> Overlap:
        a, b = gt.boxes()[:, None, :], pred.boxes()[None, :, :]
        side = np.clip(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0, None)
        both = side.prod(axis=2)
        size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
        share = lambda n, d: np.divide(n, d, out=np.zeros(np.broadcast(n, d).shape), where=d > 0)
        return cls(share(both, size(a) + size(b) - both), share(both, size(a) + 0 * both), share(both, size(b) + 0 * both))

    @property
    def either(self) -> np.ndarray:
        return np.maximum(self.of_gt, self.of_pred)


def by_page(gt: DataFrame, pred: DataFrame, page: list[str], score: Callable[[Part, Part], list[tuple]], out: str) -> DataFrame:
    """page and the rows that score(gt, pred) gives for each page."""
    side = lambda df, kind: df.select(*page, F.lit(kind).alias("side"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()))
    kinds = {f.name: f.dataType.simpleString() for f in gt.select(*page).schema}
    n, names = len(page), [*page, *(x.split()[0] for x in out.split(", "))]
    rows = side(gt, 0).unionByName(side(pred, 1)).repartition(*page).sortWithinPartitions(*page, "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        key, parts, texts = None, (Part(), Part()), ([], [])
        made: list[tuple] = []

        def scored() -> list[tuple]:
            bags = bags_of(texts[0] + texts[1])
            parts[0].tokens, parts[1].tokens = bags[: len(texts[0])], bags[len(texts[0]) :]
            return [(*key, *r) for r in score(*parts)]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema, strict=True)], names=names)
                made = []

        types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
        for batch in batches:
            schema = schema or [*(batch.schema.field(i).type for i in range(n)), *(types[x.split()[1]] for x in out.split(", "))]
            own = batch.schema.get_field_index("tokens")
            bounds, values = batch.column(own).offsets.to_pylist(), batch.column(own).values
            for r, row in enumerate(zip(*(c.to_pylist() for j, c in enumerate(batch.columns) if j != own), strict=True)):
                if row[:n] != key:
                    if key is not None:
                        made += scored()
                        if len(made) >= 10_000:
                            yield from flush()
                    key, parts, texts = row[:n], (Part(), Part()), ([], [])
                side, i, cls, rank, x0, y0, x1, y1, *marks = row[n:]
                p = parts[side]
                p.id.append(i)
                p.cls.append(cls)
                p.rank.append(rank if rank is not None else len(p.rank))
                p.box.append((x0, y0, x1, y1))
                texts[side].append(values.slice(bounds[r], bounds[r + 1] - bounds[r]))
                p.marks.append(tuple(bool(m) for m in marks))
        if key is not None:
            made += scored()
        yield from flush()

    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in page) + ", " + out)


def token_scores(gt: Tokens, pred: Tokens) -> tuple[float, float]:
    """Recall and F1 of two bags; two empty ones agree."""
    if not gt or not pred:
        return float(not gt), float(not gt and not pred)
    both = (gt & pred).total()
    return both / gt.total(), 2 * both / (gt.total() + pred.total())


def own_tokens(i: int, j: int, gt: Part, pred: Part, near: np.ndarray) -> Tokens:
    """Tokens of prediction j without those that only other elements under it have: a merged block is not held against element i."""
    others = together([gt.tokens[k] for k in np.flatnonzero(near[:, j]).tolist() if k != i])
    return pred.tokens[j] if others is None else pred.tokens[j] - (others - gt.tokens[i])


def best_block(i: int, gt: Part, pred: Part, o: Overlap) -> float:
    """The best score of an element among the predictions that overlap it: recall if explicit, else F1."""
    near = o.either >= ATTRIBUTED
    at = 0 if gt.marks[i][0] else 1
    return max((token_scores(gt.tokens[i], own_tokens(i, j, gt, pred, near))[at] for j in np.flatnonzero(near[i]).tolist()), default=0.0)


def band(i: int, gt: Part, pred: Part, o: Overlap) -> list[int]:
    """Predictions with a fifth of their area in a furniture band, in reading order."""
    return sorted(np.flatnonzero((o.of_pred[i] >= LOCALISED_PRED)).tolist(), key=lambda j: (pred.rank[j], j))


def band_covered(i: int, own: list[int], gt: Part, pred: Part) -> bool:
    x0, y0, x1, y1 = gt.box[i]
    cut = [(max(x0, a), max(y0, b), min(x1, c), min(y1, d)) for a, b, c, d in (pred.box[j] for j in own)]
    cut = [c for c in cut if c[2] > c[0] and c[3] > c[1]]
    if not cut or x1 <= x0 or y1 <= y0:
        return False
    top, covered = y0, 0.0
    for a, b in sorted((c[1], c[3]) for c in cut):
        covered += max(0.0, b - max(a, top))
        top = max(top, b)
    return (max(c[2] for c in cut) - min(c[0] for c in cut)) / (x1 - x0) >= BAND_X and covered / (y1 - y0) >= BAND_Y


def best_run(i: int, own: list[int], gt: Part, pred: Part, o: Overlap) -> float:
    """The best score of any run of neighbours in a band."""
    near, at, best = o.either >= ATTRIBUTED, 0 if gt.marks[i][0] else 1, 0.0
    tokens = {j: own_tokens(i, j, gt, pred, near) for j in own}
    for a in range(len(own)):
        for n in range(a + 1, len(own) + 1):
            run = tokens[own[a]] if n == a + 1 else run + tokens[own[n - 1]]
            best = max(best, token_scores(gt.tokens[i], run)[at])
    return best


def score_elements(gt: Part, pred: Part) -> list[tuple]:
    o, out = Overlap.of(gt, pred), []
    for i in range(len(gt.id)):
        explicit, caption, furniture = gt.marks[i]
        own = band(i, gt, pred, o) if furniture else np.flatnonzero((o.of_gt[i] >= LOCALISED_GT) & (o.of_pred[i] >= LOCALISED_PRED)).tolist()
        j = max(own, key=lambda j: (o.iou[i, j], -pred.id[j])) if own else None
        localised = band_covered(i, own, gt, pred) if furniture else j is not None
        classified = localised and j is not None and pred.cls[j] == gt.cls[i]
        score = None
        if gt.tokens[i] and not caption and gt.cls[i] != "Formula":
            score = best_run(i, own, gt, pred, o) if furniture else best_block(i, gt, pred, o)
        attributed = None if score is None else score >= TOKEN_F1
        out.append((gt.id[i], gt.cls[i], None if j is None else pred.id[j], localised, classified, score, attributed, classified and attributed is not False))
    return out


def score_page(gt: Part, pred: Part) -> list[tuple]:
    near = Overlap.of(gt, pred).either >= ATTRIBUTED
    explicit = np.array([m[0] for m in gt.marks], bool)
    hit = [0, 0]
    total = [0, 0]
    grounded = []
    for j, tokens in enumerate(pred.tokens):
        around = np.flatnonzero(near[:, j])
        if tokens and not (len(around) and explicit[around].all()):
            met = together([gt.tokens[i] for i in around.tolist()])
            hit[0] += (tokens & met).total() if met is not None else 0
            total[0] += tokens.total()
    for i, tokens in enumerate(gt.tokens):
        if tokens:
            met = together([pred.tokens[j] for j in np.flatnonzero(near[i]).tolist()])
            found = (tokens & met).total() if met is not None else 0
            hit[1] += found
            total[1] += tokens.total()
            grounded.append(found / tokens.total() >= TOKEN_F1)
    lap, lar = (h / t if t else 1.0 for h, t in zip(hit, total, strict=True))
    return [(lap, lar, 2 * lap * lar / (lap + lar) if lap + lar else 0.0, sum(grounded) / len(grounded) if grounded else 1.0, *total)]


def score_classes(gt: Part, pred: Part) -> list[tuple]:
    """Precision of the tokens that overlap elements of a class."""
    near, out = Overlap.of(gt, pred).either >= ATTRIBUTED, []
    for cls in sorted({c for c in gt.cls if c is not None}):
        hit = total = 0
        for j, tokens in enumerate(pred.tokens):
            own = [i for i in np.flatnonzero(near[:, j]).tolist() if gt.cls[i] == cls]
            if own and tokens:
                hit += (tokens & together([gt.tokens[i] for i in own])).total()
                total += tokens.total()
        if total:
            out.append((cls, hit / total, total))
    return out


def score_areas(gt: list[tuple], pred: list[tuple]) -> tuple[float, float]:
    cut = [(max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])) for a in gt for b in pred if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]]
    both, x, y = union_area([c for c in cut if c[2] > c[0] and c[3] > c[1]]), union_area(gt), union_area(pred)
    return (both / (x + y - both) if x + y > both else 0.0), (both / x if x else 0.0)


def set_iou(gt: DataFrame, pred: DataFrame, page: list[str]) -> DataFrame:
    """page, iou, recall: of the areas that the boxes of either side cover together. Only boxes are shuffled and read."""
    side = lambda df, kind: df.select(*page, F.lit(kind).alias("side"), *(F.col(c).cast("double").alias(c) for c in BOX))
    rows = side(gt, 0).unionByName(side(pred, 1)).repartition(*page).sortWithinPartitions(*page)
    kinds, n = {f.name: f.dataType.simpleString() for f in rows.schema}, len(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, boxes, made = None, ([], []), []

        def flush(types: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=[*page, "iou", "recall"])  # noqa: B023

        for batch in batches:
            types = [*(batch.schema.field(i).type for i in range(n)), pa.float64(), pa.float64()]
            cols = [c.to_pylist() for c in batch.columns]
            for key, s, box in zip(zip(*cols[:n], strict=True), cols[n], zip(*cols[n + 1 :], strict=True), strict=True):
                if key != last:
                    if last is not None:
                        made.append((*last, *score_areas(*boxes)))
                    last, boxes = key, ([], [])
                boxes[s].append(box)
            if len(made) >= 10_000:
                yield flush(types)
                made = []
        if last is not None:
            made.append((*last, *score_areas(*boxes)))
            yield flush(types)

    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in page) + ", iou double, recall double")


def elements(gt: DataFrame, pred: DataFrame, page: list[str]) -> DataFrame:
    """page and ELEMENT of every element: formulas, captions and elements without tokens have no attribution."""
    return by_page(gt, pred, page, score_elements, ELEMENT)


def page_scores(gt: DataFrame, pred: DataFrame, page: list[str]) -> DataFrame:
    """page and PAGE: token precision and recall of the page, their harmonic mean, and the share of elements with enough of their tokens."""
    return by_page(gt, pred, page, score_page, PAGE)


def class_precision(gt: DataFrame, pred: DataFrame, page: list[str]) -> DataFrame:
    """page, cls, lap, tokens."""
    return by_page(gt, pred, page, score_classes, "cls string, lap double, tokens long")


def rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """From elements: pass rates of localisation, classification and attribution, of all three pooled, and of whole elements."""
    n = lambda c: F.count(F.when(c, 1))
    col: dict[str, Column] = {"loc": n(F.col("localised")), "cls_": n(F.col("classified")), "attr": n(F.col("attributed")), "attr_total": F.count("attributed"), "whole": n(F.col("passed")), "total": F.count(F.lit(1))}
    g = rows.groupBy(*by).agg(*(c.alias(k) for k, c in col.items()))
    pooled = (F.col("loc") + F.col("cls_") + F.col("attr")) / (2 * F.col("total") + F.col("attr_total"))
    return g.select(*by, (F.col("loc") / F.col("total")).alias("localisation"), (F.col("cls_") / F.col("total")).alias("classification"), F.try_divide("attr", "attr_total").alias("attribution"), pooled.alias("layout_rule_pass_rate"), (F.col("whole") / F.col("total")).alias("layout_element_rule_pass_rate"))


def batch_report(pages: DataFrame, by: list[str]) -> DataFrame:
    """From page scores: means over pages, and token-weighted precision and recall."""
    weighted = lambda c, w: F.try_divide(F.sum(F.col(c) * F.col(w)), F.sum(w))
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), *(F.avg(c).alias(c) for c in ("lap", "lar", "af1", "grounding")), weighted("lap", "pred_tokens").alias("lap_by_tokens"), weighted("lar", "gt_tokens").alias("lar_by_tokens"))


def furniture_order(rows: DataFrame, page: list[str]) -> DataFrame:
    """The place of each element in its page's reading order, from 0."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy("rank", "id")) - 1)
