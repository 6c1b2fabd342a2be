"""Set and label operations that several metrics share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, item, n: how often an item is in a more than in b."""
    count = lambda d, c: d.groupBy(*keys, item).agg(F.count(F.lit(1)).alias(c))
    j = count(a, "n").join(count(b, "m"), [*keys, item], "left")
    return j.select(*keys, item, (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")


def preview(counts: DataFrame, keys: list[str], item: str, n: str, most: int = 5) -> DataFrame:
    """keys, items: the most frequent items, ties by text. Aggregated to the top ones as they are gathered, not sorted as a whole."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(n), F.col(item))
    top = counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", item))), lambda x: x[item]).alias("items"))


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode, even: the most frequent value, the smallest of equals, and whether all are equal. Widths of a table's rows, for instance."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias("mode"), (F.count(F.lit(1)) == 1).alias("even"))


def union_of_metrics(parts: list[DataFrame]) -> DataFrame:
    """Rows of pipelines with different metric columns; a metric that a pipeline lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def mapped_labels(boxes: DataFrame, maps: DataFrame, *, label: str = "raw_label", strict: bool = False) -> DataFrame:
    """boxes with canonical: by provider and model, else by the matcher of the highest priority whose pattern fits the model, else by provider alone.

    maps: provider, model (null for any), matcher (pattern, null for none), priority, raw_label, canonical: some thousand rows at most, so
    they are broadcast. What no map knows is dropped; if strict, it ends the query.
    """
    m = F.broadcast(maps.select(F.col("provider").alias("m_provider"), F.col("model").alias("m_model"), "matcher", "priority", F.col(label).alias("m_label"), "canonical"))
    fits = (F.col("provider") == F.col("m_provider")) & (F.col(label) == F.col("m_label"))
    exact, by_pattern = F.col("model") == F.col("m_model"), F.col("matcher").isNotNull() & F.col("m_model").isNull() & F.coalesce(F.regexp_like("model", F.col("matcher")), F.lit(False))
    rank = F.when(exact, F.lit(0)).when(by_pattern, F.lit(1)).when(F.col("m_model").isNull() & F.col("matcher").isNull(), F.lit(2))
    keyed = boxes.withColumn("__key", F.monotonically_increasing_id())
    hit = keyed.select("__key", "provider", "model", label).join(m, fits).withColumn("__rank", rank).where("__rank is not null")
    best = hit.groupBy("__key").agg(F.min_by("canonical", F.struct("__rank", -F.coalesce("priority", F.lit(0)), "canonical")).alias("canonical"))
    out = keyed.join(best, "__key", "left" if strict else "inner").drop("__key")
    return out.withColumn("canonical", F.coalesce("canonical", F.raise_error(F.concat(F.lit("unknown label "), F.col(label))).cast("string"))) if strict else out


def page_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys of either side, once, with where they are."""
    side = lambda d, c: d.select(*keys).distinct().withColumn(c, F.lit(True))
    j = side(a, "in_a").join(side(b, "in_b"), keys, "full_outer")
    return j.select(*keys, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def normal_attributes(attributes: Column) -> Column:
    """A map with trimmed lower-case keys and values as trimmed text; entries without a value go."""
    kept = F.map_filter(attributes, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return F.transform_values(F.transform_keys(kept, lambda k, v: F.lower(F.trim(k))), lambda k, v: F.trim(v))


def is_true(value: Column) -> Column:
    """Whether a text attribute says yes."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes", "y"), F.lit(False))


def field_rules(rules: DataFrame, *, kinds: tuple[str, ...] = ("extract_field",), verified_only: bool = True) -> DataFrame:
    """Typed extraction rules: of the asked kinds, verified unless they say otherwise, with a path."""
    out = rules.where(F.col("type").isin(*kinds) & F.col("field_path").isNotNull())
    return out.where(F.coalesce("verified", F.lit(True))) if verified_only else out
