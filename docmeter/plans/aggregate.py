"""From per-case metrics to a report: macro, micro, padded, per-tag and percentile aggregates.

Long tables. results: pipeline, test_id, product_type, success, error, tags. metrics: pipeline, test_id, product_type, metric,
value, and, where they apply, passed, total, tp, fp, fn, score_sum, score_count, cnt, tables_predicted, string_rule_count.
Every step is a grouped sum, so Spark combines on the map side and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Counts, and a rate of which less is better, that a failure must not pad.
NOT_SCORES = ("num_predictions", "num_ground_truth", "tables_expected", "tables_actual", "tables_paired", "tables_unmatched_expected", "tables_unmatched_pred", "tables_unparseable_pred", "parse_field_gt_count", "unmatched_gt_elements", "unmatched_pred_elements", "null_hallucination_rate")
OPTIONAL = {"passed": "long", "total": "long", "tp": "long", "fp": "long", "fn": "long", "score_sum": "double", "score_count": "double", "cnt": "long", "tables_predicted": "boolean", "string_rule_count": "double"}


def failure_kind(success: Column, error: Column) -> Column:
    """ok, skip (never meant to be scored), infra (the harness failed) or failed."""
    e = F.coalesce(error, F.lit(""))
    harness = e.startswith("Worker error:") | e.startswith("Evaluation error:") | e.startswith("Task execution error:")
    return F.when(success, "ok").when(e.contains("No layout data"), "skip").when(harness & ~e.contains("not LayoutOutput"), "infra").otherwise("failed")


def complete(metrics: DataFrame) -> DataFrame:
    """metrics with every optional column."""
    return metrics.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in metrics.columns})


def aggregate_metrics(metrics: DataFrame, results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, name, value: avg, min and max of each metric with a zero for each failed case of its product types, totals and micro values of the survivors."""
    by = ["pipeline"] if by is None else by
    m = complete(metrics)
    fails = results.where(failure_kind(F.col("success"), F.col("error")) == "failed").groupBy(*by, "product_type").agg(F.count(F.lit(1)).alias("fails"))
    both = F.col("total").isNotNull() & F.col("passed").isNotNull()
    prf = F.col("tp").isNotNull() & F.col("fp").isNotNull() & F.col("fn").isNotNull()
    scored = F.col("score_count") > 0
    weighted = (F.col("metric") == "parse_field_text_similarity") & (F.col("string_rule_count") > 0)
    seen = F.coalesce("tables_predicted", F.lit(False))
    sums = m.groupBy(*by, "metric", "product_type").agg(
        F.sum("value").alias("s"), F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("cnt").alias("has_cnt"), F.sum("cnt").alias("cnt"),
        F.sum(F.when(both, F.col("passed"))).alias("passed"), F.sum(F.when(both, F.col("total"))).alias("total"),
        *(F.sum(F.when(prf, F.col(c))).alias(c) for c in ("tp", "fp", "fn")),
        F.sum(F.when(scored, F.col("score_sum"))).alias("score_sum"), F.sum(F.when(scored, F.col("score_count"))).alias("score_count"),
        F.sum(F.when(weighted, F.col("value") * F.col("string_rule_count"))).alias("w_sum"), F.sum(F.when(weighted, F.col("string_rule_count"))).alias("w_count"),
        F.sum(F.when(seen, F.col("value"))).alias("p_s"), F.count(F.when(seen, F.col("value"))).alias("p_n"), F.min(F.when(seen, F.col("value"))).alias("p_lo"), F.max(F.when(seen, F.col("value"))).alias("p_hi"),
    )
    joined = sums.join(fails, [*by, "product_type"], "left")
    total = joined.groupBy(*by, "metric").agg(*(f(c).alias(c) for f, cs in ((F.sum, ("s", "n", "has_cnt", "cnt", "passed", "total", "tp", "fp", "fn", "score_sum", "score_count", "w_sum", "w_count", "p_s", "p_n")), (F.min, ("lo", "p_lo")), (F.max, ("hi", "p_hi"))) for c in cs), F.sum(F.coalesce("fails", F.lit(0))).alias("fails"))
    may_pad = (F.col("has_cnt") == 0) & ~F.col("metric").isin(*NOT_SCORES) & (F.col("lo") >= 0) & (F.col("hi") <= 1)
    total = total.withColumn("pad", F.when(may_pad, F.col("fails")).otherwise(0))
    named = lambda pre, name, value, when=None: F.struct(F.concat(F.lit(pre), name).alias("name"), (value if when is None else F.when(when, value)).cast("double").alias("value"))
    name = F.col("metric")
    micro = F.when(F.col("w_count") > 0, F.col("w_sum") / F.col("w_count")).when(F.col("score_count") > 0, F.col("score_sum") / F.col("score_count")).when(F.col("total") > 0, F.col("passed") / F.col("total"))
    rows = F.array(
        named("avg_", name, F.col("s") / (F.col("n") + F.col("pad")), F.col("n") > 0),
        named("min_", name, F.when(F.col("pad") > 0, F.least(F.lit(0.0), F.col("lo"))).otherwise(F.col("lo"))),
        named("max_", name, F.col("hi")),
        named("total_", F.concat(name, F.lit("_passed")), F.col("passed"), F.col("total") > 0),
        named("total_", F.concat(name, F.lit("_evaluated")), F.col("total"), F.col("total") > 0),
        named("micro_", name, micro),
        *(named("total_", F.concat(name, F.lit(f"_{c}")), F.col(c)) for c in ("tp", "fp", "fn")),
        named("avg_", F.concat(name, F.lit("_predicted")), F.col("p_s") / F.col("p_n"), F.col("p_n") > 0),
        named("min_", F.concat(name, F.lit("_predicted")), F.col("p_lo")),
        named("max_", F.concat(name, F.lit("_predicted")), F.col("p_hi")),
        named("total_", name, F.col("cnt"), F.col("has_cnt") > 0),
    )
    out = total.select(*by, F.inline(rows)).where("value is not null")
    # Pooled precision, recall and F1, where a metric family has all three; they stand before other micro values.
    part = F.regexp_extract("metric", "^(.*)_(precision|recall|f1)$", 2)
    family = total.where(F.col("tp").isNotNull() & (part != "")).withColumn("prefix", F.regexp_extract("metric", "^(.*)_(precision|recall|f1)$", 1))
    p = family.groupBy(*by, "prefix").agg(F.count(F.lit(1)).alias("parts"), *(F.max(F.when(part == "precision", F.col(c))).alias(c) for c in ("tp", "fp", "fn"))).where("parts = 3")
    share = lambda c: F.coalesce(F.try_divide("tp", F.col("tp") + F.col(c)), F.lit(0.0))
    p = p.withColumn("p", share("fp")).withColumn("r", share("fn")).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    pooled = p.select(*by, F.inline(F.array(*(F.struct(F.concat(F.lit("micro_"), F.col("prefix"), F.lit(f"_{k}")).alias("name"), F.col(c).alias("value")) for k, c in (("precision", "p"), ("recall", "r"), ("f1", "f"))))))
    both = out.withColumn("rank", F.lit(0)).unionByName(pooled.withColumn("rank", F.lit(1)))
    return both.groupBy(*by, "name").agg(F.max_by("value", "rank").alias("value"))


def tag_metrics(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """pipeline, tag, name, value: the same for each tag; a case with k tags counts k times."""
    tagged = results.select("*", F.explode("tags").alias("tag"))
    m = metrics.join(tagged.select("pipeline", "test_id", "product_type", "tag"), ["pipeline", "test_id", "product_type"])
    n = tagged.groupBy("pipeline", "tag").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("name", F.lit("example_count"))
    return aggregate_metrics(m, tagged, ["pipeline", "tag"]).unionByName(n)


def stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Total, avg, min, max, count and p50 to p99 of value: the value at place floor(n * p / 100) of the sorted ones, the last at most.

    The places come from counts of distinct values, summed in order, so a group is never held in one row.
    """
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*by)
    places = distinct.withColumn("__upto", F.sum("__k").over(w.orderBy("__v"))).withColumn("__n", F.sum("__k").over(w))
    at = lambda p: F.least(F.floor(F.col("__n") * p / 100), F.col("__n") - 1)
    tops = [F.min(F.when(F.col("__upto") > at(p), F.col("__v"))).alias(f"p{p}") for p in (50, 90, 95, 99)]
    total = F.sum(F.col("__v") * F.col("__k"))
    return places.groupBy(*by).agg(total.alias("total"), (total / F.sum("__k")).alias("avg"), F.min("__v").alias("min"), F.max("__v").alias("max"), F.sum("__k").alias("n"), *tops)


def run_summary(results: DataFrame) -> DataFrame:
    """Cases, successes, failures, skips and harness errors of each pipeline."""
    kind = failure_kind(F.col("success"), F.col("error"))
    return results.groupBy("pipeline").agg(F.count(F.lit(1)).alias("cases"), *(F.count(F.when(kind == k, 1)).alias(n) for k, n in (("ok", "successful"), ("failed", "failed"), ("skip", "skipped"), ("infra", "infra"))))


def f_score(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when(b * p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)


def weighted_mean(parts: dict[str, float]) -> Column:
    """Mean of the columns that are not null, by weight."""
    w = sum((F.when(F.col(c).isNotNull(), F.lit(float(x))).otherwise(0.0) for c, x in parts.items()), F.lit(0.0))
    return F.when(w > 0, sum((F.coalesce(F.col(c) * float(x), F.lit(0.0)) for c, x in parts.items()), F.lit(0.0)) / w)


# Rule types of each category, and category weights.
CORRECTNESS = ("missing_sentence_percent", "unexpected_sentence_percent", "too_many_sentence_occurence_percent", "missing_word_percent", "unexpected_word_percent", "too_many_word_occurence_percent", "bag_of_digit_percent", "extra_content")
TEXT_SCORE = {"text_correctness": 1, "order": 1, "styling": 1, "title": 1, "code_block": 0.2, "latex": 0.2}
FAITHFULNESS = {"text_correctness": 1, "order": 0.5}
SEMANTIC = {"styling": 1, "title": 1, "latex": 0.2, "code_block": 0.2}
STYLES = ("bold", "strikeout", "sup", "sub")


def type_means(rule_results: DataFrame) -> DataFrame:
    """pipeline, test_id, type, score, rules: mean score of each rule type in a document."""
    return rule_results.groupBy("pipeline", "test_id", "type").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("rules"))


def rule_pass_rate(rule_results: DataFrame) -> DataFrame:
    """Mean rule score of a document, as a metric with passed and total."""
    return rule_results.groupBy("pipeline", "test_id").agg(F.avg("score").alias("value"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.lit(1)).alias("total")).withColumn("metric", F.lit("rule_pass_rate"))


def category_scores(rule_results: DataFrame) -> DataFrame:
    """Per document: text correctness, order, styling (F0.5 of positive and negative rules, by rules), title, code, latex, and the three composites."""
    t = type_means(rule_results)
    mean = lambda types: F.avg(F.when(F.col("type").isin(*types), F.col("score")))
    cats = t.groupBy("pipeline", "test_id").agg(mean(CORRECTNESS).alias("text_correctness"), mean(("order",)).alias("order"), mean(("is_title", "title_hierarchy_percent")).alias("title"), mean(("is_code_block",)).alias("code_block"), mean(("is_latex",)).alias("latex"))
    style = F.regexp_extract("type", f"^is_(?:not_)?({'|'.join(STYLES)})$", 1)
    pairs = t.withColumn("style", style).where("style <> ''").groupBy("pipeline", "test_id", "style").agg(F.coalesce(F.max(F.when(~F.col("type").startswith("is_not_"), F.col("score"))), F.lit(1.0)).alias("pos"), F.coalesce(F.max(F.when(F.col("type").startswith("is_not_"), F.col("score"))), F.lit(1.0)).alias("neg"), F.sum("rules").alias("rules"))
    styling = pairs.groupBy("pipeline", "test_id").agg((F.sum(f_score(F.col("pos"), F.col("neg"), 0.5) * F.col("rules")) / F.sum("rules")).alias("styling"))
    out = cats.join(styling, ["pipeline", "test_id"], "left")
    return out.withColumns({"normalized_text_score": weighted_mean(TEXT_SCORE), "content_faithfulness": weighted_mean(FAITHFULNESS), "semantic_formatting": weighted_mean(SEMANTIC)})
