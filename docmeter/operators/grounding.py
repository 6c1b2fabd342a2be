"""Grounding of fields: expected values and their boxes against words and lines of a page, or against cited boxes of an extraction.

A rule meets only units of its document. Units that stand mostly inside its boxes are gathered in reading order for each granularity, and the
granularity that agrees best counts. Localisation is strict by overlap alone, or relaxed by less overlap with an exact value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import strict
from . import boxes as B

# Fixed values.
EXACT, NEAR, INSIDE = 0.999, 0.90, 0.5
RULE = "iou double, recall double, max_ioa double, score double, how string, granularity string, found string"


def value_score(expected, kind: str, text: str) -> tuple[float, str]:
    """1 for a strict match; for text else its Jaro-Winkler similarity, which passes from NEAR on."""
    v = strict.compare(expected, kind, text)
    if v.verified:
        return 1.0, v.how
    if kind != "string" or expected is None:
        return 0.0, "none"
    a, b = (strict.one_space(str(t)).casefold() for t in (expected, text or ""))
    return (K.jaro_winkler(a, b) if a and b else 0.0), "fuzzy"


def area_scores(gt: list[tuple], pred: list[tuple]) -> tuple[float, float, float]:
    """(page, x0, y0, x1, y1) of both sides: IoU of the unions, share of the expected area that is covered, and the larger of both shares."""
    both = a = b = 0.0
    for page in {r[0] for r in gt} | {r[0] for r in pred}:
        g, p = ([tuple(r[1:]) for r in side if r[0] == page] for side in (gt, pred))
        cut = [(max(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), min(x[3], y[3])) for x in g for y in p]
        both += B.union_area([c for c in cut if c[2] > c[0] and c[3] > c[1]])
        a, b = a + B.union_area(g), b + B.union_area(p)
    total = a + b - both
    return (both / total if total > 0 else 0.0), (both / a if a else 0.0), max(both / a if a else 0.0, both / b if b else 0.0)


def inside(unit: tuple, gt: list[tuple]) -> bool:
    """At least INSIDE of a unit's area lies in one of the boxes."""
    page, x0, y0, x1, y1 = unit
    size = max((x1 - x0) * (y1 - y0), 1e-12)
    return any(page == g[0] and max(0.0, min(x1, g[3]) - max(x0, g[1])) * max(0.0, min(y1, g[4]) - max(y0, g[2])) / size >= INSIDE for g in gt)


def best_support(expected: str | None, kind: str, gt: list[tuple], units: list[tuple]) -> tuple:
    """units: (granularity, rank, text, box). RULE of the granularity that agrees best: by value, then by overlap."""
    best = (0.0, 0.0, 0.0, 0.0, "missing", "none", "")
    for g in sorted({u[0] for u in units}):
        own = [u for u in sorted(units, key=lambda u: u[1]) if u[0] == g and inside(u[3], gt)]
        if own:
            text = " ".join(u[2] for u in own)
            score, how = value_score(expected, kind, text)
            one = (*area_scores(gt, [u[3] for u in own]), score, how, g, text)
            best = max(best, one, key=lambda x: (x[3] >= NEAR, x[3], x[0]))
    return best


def localised(iou: Column, max_ioa: Column, score: Column, how: Column) -> Column:
    """Strict overlap, an empty value met by nothing, or relaxed overlap with the exact value."""
    return (iou >= B.STRICT_IOU) | (how == "null_empty") | ((iou >= B.RELAXED_IOU) & (max_ioa >= B.RELAXED_IOA) & (score >= EXACT))


def field_rules(rules: DataFrame, units: DataFrame) -> DataFrame:
    """rules (test_id, field_path, expected, kind, boxes) with RULE, loc, attr and element. units: test_id, granularity, rank, text, page and a box.

    A document's units are gathered once beside its rules' boxes, only those of pages that a rule asks for; a rule is sent those that stand inside its boxes.
    """
    box = F.struct(F.col("page"), *B.BOX)
    pages = rules.select("test_id", F.explode("boxes").alias("b")).select("test_id", F.col("b.page").alias("page")).distinct()
    own = units.join(pages, ["test_id", "page"]).groupBy("test_id").agg(F.collect_list(F.struct("granularity", "rank", "text", box.alias("box"))).alias("units"))

    def stands(unit: Column) -> Column:
        u = {c: unit["box"][c].cast("double") for c in B.BOX}
        size = F.greatest((u["x1"] - u["x0"]) * (u["y1"] - u["y0"]), F.lit(1e-12))
        side = lambda g, a, b: F.greatest(F.lit(0.0), F.least(u[b], g[b].cast("double")) - F.greatest(u[a], g[a].cast("double")))
        return F.exists("boxes", lambda g: (g["page"] == unit["box"]["page"]) & (side(g, "x0", "x1") * side(g, "y0", "y1") / size >= INSIDE))

    own = rules.join(own, "test_id", "left").withColumn("units", F.filter("units", stands))
    kinds = {f.name: f.dataType.simpleString() for f in rules.schema}
    n, at = len(rules.columns), {c: i for i, c in enumerate(rules.columns)}
    types = [pa.float64()] * 4 + [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_box = lambda b: (b["page"], *(float(b[c]) for c in B.BOX))
        for batch in batches:
            out = []
            for e, k, g, u in zip(*(batch.column(i).to_pylist() for i in (at["expected"], at["kind"], at["boxes"], n)), strict=True):
                have = [(x["granularity"], x["rank"], x["text"] or "", as_box(x["box"])) for x in u or ()]
                out.append(best_support(e, k or "string", [as_box(b) for b in g or ()], have))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[*at, *(x.split()[0] for x in RULE.split(", "))])

    out = own.select(*rules.columns, "units").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in at) + ", " + RULE)
    loc = localised(F.col("iou"), F.col("max_ioa"), F.col("score"), F.col("how"))
    return out.withColumn("loc", loc).withColumn("attr", F.col("loc") & (F.col("score") >= NEAR)).withColumn("element", F.col("attr"))


def field_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """The parse_field rates of scored rules; the class of a field counts as passed."""
    n = lambda c: F.count(F.when(c, 1))
    g = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), n(F.col("loc")).alias("loc"), n(F.col("attr")).alias("attr"), n(F.col("element")).alias("element"), F.avg("iou").alias("avg_iou"), F.avg(F.when(F.col("loc"), F.col("iou"))).alias("matched"), F.avg(F.when(~F.col("loc"), F.col("iou"))).alias("unmatched"),
        F.avg("recall").alias("bbox_recall"), F.avg(F.when((F.col("kind") == "string") & (F.col("granularity") != "none"), F.col("score"))).alias("similarity"),
    )
    t = F.col("total")
    return g.select(
        *by, (F.col("element") / t).alias("parse_field_element_pass_rate"), ((F.col("loc") + t + F.col("attr")) / (3 * t)).alias("parse_field_rule_pass_rate"), (F.col("loc") / t).alias("parse_field_localization_pass_rate"), F.lit(1.0).alias("parse_field_classification_pass_rate"),
        (F.col("attr") / t).alias("parse_field_attribution_pass_rate"), F.col("avg_iou").alias("parse_field_avg_iou"), F.coalesce("matched", F.lit(0.0)).alias("parse_field_avg_iou_matched"), F.coalesce("unmatched", F.lit(0.0)).alias("parse_field_avg_iou_unmatched"), F.col("bbox_recall").alias("parse_field_bbox_recall"), F.col("similarity").alias("parse_field_text_similarity"),
    )


def aligned_records(expected: DataFrame, actual: DataFrame, key: str, fields: list[str], least: float = 0.5) -> DataFrame:
    """key, rank, other, agree: records (key, rank, fields) paired greedily by how many fields agree, from more than `least` of them on; ties by rank.

    A document's records are scored where an equal field brings them together, so no record meets one with which it shares nothing. Documents are read as a stream, many to a batch.
    """
    side = lambda d, r: d.select(key, F.col("rank").alias(r), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x")).select(key, r, "x.f", "x.v").where("v is not null")
    pairs = side(expected, "rank").join(side(actual, "other"), [key, "f", "v"]).groupBy(key, "rank", "other").agg((F.count(F.lit(1)) / len(fields)).alias("agree")).where(F.col("agree") > least)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    cols = [key, "rank", "other", "agree"]
    rows = pairs.select(*cols).repartition(key).sortWithinPartitions(key, F.desc("agree"), F.asc_nulls_last("rank"), F.asc_nulls_last("other"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left, right = None, set(), set()
        for batch in batches:
            keep = []
            for i, (k, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if k != last:
                    last, left, right = k, set(), set()
                if a not in left and b not in right:
                    left.add(a)
                    right.add(b)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    return rows.mapInArrow(greedy, ", ".join(f"{c} {kinds[c]}" for c in cols))


def record_metrics(expected: DataFrame, actual: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key, record_accuracy (mean agreement of expected records, unpaired ones 0) and record_grounded_recall (share of expected records that were paired)."""
    n = expected.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    p = pairs.groupBy(key).agg(F.sum("agree").alias("s"), F.count(F.lit(1)).alias("m"))
    j = n.join(p, key, "left")
    return j.select(key, F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("record_accuracy"), F.coalesce(F.col("m") / F.col("n"), F.lit(0.0)).alias("record_grounded_recall"))
