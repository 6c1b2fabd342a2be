"""Comparison of two pipelines, dashboards and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metric that compares, by product type, and the five dimensions of the leaderboard.
COMPARED = {"extract": "accuracy", "parse": "rule_pass_rate", "layout_detection": "mAP@[.50:.95]"}
DIMENSIONS = ("tables", "charts", "content_faithfulness", "semantic_formatting", "visual_grounding")


def compare(a: DataFrame, b: DataFrame, *, key: str = "test_id", value: str = "value", least: float = 1e-9, bad: float = 0.0) -> DataFrame:
    """key, a_value, b_value, category: a_only, b_only, both_bad (neither above bad), tie, a_better or b_better."""
    x, y = a.select(F.col(key), F.col(value).alias("a_value"), F.lit(True).alias("in_a")), b.select(F.col(key), F.col(value).alias("b_value"), F.lit(True).alias("in_b"))
    j = x.join(y, key, "full_outer")
    d = F.col("a_value") - F.col("b_value")
    kind = F.when(F.col("in_b").isNull(), "a_only").when(F.col("in_a").isNull(), "b_only").when(F.abs(d) <= least, F.when(F.col("a_value") <= bad, "both_bad").otherwise("tie")).when(d > 0, "a_better").otherwise("b_better")
    return j.select(key, "a_value", "b_value", kind.alias("category"))


def comparison_stats(compared: DataFrame) -> DataFrame:
    return compared.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.coalesce("a_value", F.lit(0.0)) - F.coalesce("b_value", F.lit(0.0))).alias("difference"))


def overall() -> Column:
    """Mean of the five dimensions, missing ones as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in DIMENSIONS), F.lit(0.0)) / len(DIMENSIONS)


def matrix(agg: DataFrame, names: list[str] | None = None) -> DataFrame:
    """pipeline x metric of the avg_* values; *_predicted and *_judge stay out. names fixes the columns and saves a pass."""
    rows = agg.where(F.col("name").startswith("avg_") & ~F.col("name").endswith("_predicted") & ~F.col("name").endswith("_judge"))
    return (rows.groupBy("pipeline").pivot("name", names) if names else rows.groupBy("pipeline").pivot("name")).agg(F.first("value"))


def top(rows: DataFrame, by: Column, n: int = 10, *ties: Column) -> DataFrame:
    """The n best rows with their rank."""
    best = rows.orderBy(by.desc(), *ties).limit(n)
    return best.select(F.row_number().over(Window.orderBy(by.desc(), *ties)).alias("rank"), "*")


def merge_scores(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of new replace those of old, value by value where new has one."""
    cols = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in cols))


def wide(metrics: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row for each case with a column for each metric, in order of names."""
    return metrics.groupBy(key).pivot(name, sorted(names)).agg(F.first(value))


def paginate(rows: DataFrame, order: list[Column], page: int, size: int, most: int = 200) -> DataFrame:
    """Rows of a page (from 1) of at most `most` rows, with has_more. One row beyond the page is read to know."""
    size = max(1, min(size, most))
    got = rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size + 1)
    n = F.row_number().over(Window.orderBy(*order))
    return got.select("*", n.alias("__n"), (F.count(F.lit(1)).over(Window.partitionBy()) > size).alias("has_more")).where(F.col("__n") <= size).drop("__n")


def folder_rollup(paths: DataFrame, path: str = "path") -> DataFrame:
    """folder, own, subtree: documents right in a folder, and in all below it."""
    parts = F.split(F.col(path), "/")
    depth = F.size(parts) - 1
    rows = paths.where(depth > 0).select(F.explode(F.sequence(F.lit(1), depth)).alias("d"), depth.alias("depth"), parts.alias("parts"))
    return rows.select(F.array_join(F.slice("parts", 1, F.col("d")), "/").alias("folder"), (F.col("d") == F.col("depth")).alias("own")).groupBy("folder").agg(F.count(F.when(F.col("own"), 1)).alias("own"), F.count(F.lit(1)).alias("subtree"))
