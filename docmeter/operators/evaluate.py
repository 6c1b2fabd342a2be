"""The evaluation run: rules meet documents by key, every rule type is scored, and the results are the input of the aggregates.

A document's rules are gathered beside it, in parts of about `part` rules, so that its features are computed once for each part and no row
grows with the number of rules; texts are shuffled once. Rules that are marked as not verified are left out on request.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

RESULT = "rule_id string, type string, page int, passed boolean, score double, explanation string"


def coerced(rules: DataFrame, *, verified_only: bool = False) -> DataFrame:
    """test_id, rule_id, type, page, rule: from rule JSON that may be encoded twice. A rule without a type ends the query, as does text that is no object."""
    once = F.when(F.substring(F.trim("rule"), 1, 1) == '"', F.get_json_object(F.concat(F.lit('{"x":'), F.col("rule"), F.lit("}")), "$.x")).otherwise(F.col("rule"))
    kind = F.get_json_object(once, "$.type")
    out = rules.withColumn("rule", once).withColumn("type", F.when(kind.isNull(), F.raise_error(F.concat(F.lit("rule without a type: "), F.coalesce(F.col("rule"), F.lit("null")))).cast("string")).otherwise(kind))
    out = out.withColumn("page", F.get_json_object("rule", "$.page").cast("int"))
    if verified_only:
        out = out.where(F.coalesce(F.get_json_object("rule", "$.verified").cast("boolean"), F.lit(True)))
    return out.select("test_id", "rule_id", "type", "page", "rule")


def layout_ids(*fields: Column) -> Column:
    """Ids of several fields, in order and once each; nulls and empty ones left out."""
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(f, F.array().cast("array<string>")) for f in fields)), lambda x: x.isNotNull() & (x != "")))


def run_rules(rules: DataFrame, docs: DataFrame, *, page: int | None = None, part: int = 2000) -> DataFrame:
    """test_id and RESULT of every rule. docs: test_id, text, and if there are any, headers, footers, pages (maps by page) and angle.

    With a page, only its rules and those of no page are run. A rule whose document is missing meets a blank one and fails.
    """
    kind = docs.schema["test_id"].dataType.simpleString()
    if page is not None:
        rules = rules.where(F.col("page").isNull() | (F.col("page") == page))
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("test_id")) / part).cast("int")
    dealt = rules.where("test_id is not null").withColumn("part", F.pmod(F.xxhash64("rule_id"), parts))
    own = dealt.groupBy("test_id", "part").agg(F.collect_list(F.struct("rule_id", "rule")).alias("rules"))
    extra = {"pages": "map<int,string>", "headers": "map<int,string>", "footers": "map<int,string>", "angle": "int"}
    have = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]
    rows = own.join(docs.select("test_id", "text", *have), "test_id", "left").select("test_id", "rules", "text", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["test_id", "rule_id", "type", "page", "passed", "score", "explanation"]
        types = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.string())
        book = lambda m: None if m is None else dict(m)
        for batch in batches:
            keys, rules, texts, pages, headers, footers, angles = batch.columns
            at, out = [], []

            def made() -> pa.RecordBatch:
                cols = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)  # noqa: B023

            bounds, ids, bodies = rules.offsets.to_pylist(), rules.values.field(0), rules.values.field(1)
            for i in range(batch.num_rows):
                doc = R.Page(texts[i].as_py() or "", book(pages[i].as_py()) or {}, book(headers[i].as_py()), book(footers[i].as_py()), angles[i].as_py())
                a, n = bounds[i], bounds[i + 1] - bounds[i]
                for rule_id, text in zip(ids.slice(a, n).to_pylist(), bodies.slice(a, n).to_pylist(), strict=True):
                    one = R.parse(text)
                    score, passed, why = R.score(one, doc)
                    at.append(i)
                    out.append((rule_id, one["type"], one.get("page"), passed, score, why))
                if len(out) >= 10_000:
                    yield made()
                    at, out = [], []
            if out:
                yield made()

    return rows.mapInArrow(run, f"test_id {kind}, {RESULT}")


def document_metrics(results: DataFrame, tests: DataFrame) -> DataFrame:
    """test_id, metric, value, passed, total: the pass rate of every test (1 without rules), that of each type, and the rotation rates."""
    sums = (F.sum("s").alias("s"), F.sum("m").alias("m"), F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    kinds = results.groupBy("test_id", "type").agg(F.sum("score").alias("s"), F.count("score").alias("m"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.lit(1)).alias("total"))
    rate = F.try_divide("s", "m").alias("value")
    by_type = F.struct(F.concat(F.lit("rule_"), "type", F.lit("_pass_rate")).alias("metric"), rate, "passed", "total")
    own = kinds.groupBy("test_id").agg(F.collect_list(by_type).alias("kinds"), *sums)  # as long as there are types; the results are read once
    known = tests.select("test_id").distinct().withColumn("known", F.lit(True))
    whole = F.struct(F.lit("rule_pass_rate").alias("metric"), F.coalesce(rate, F.lit(1.0)).alias("value"), F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("total", F.lit(0)).alias("total"))
    none = F.array().cast("array<struct<metric:string,value:double,passed:bigint,total:bigint>>")
    rows = F.concat(F.when(F.col("known"), F.array(whole)).otherwise(none), F.coalesce("kinds", none))
    return known.join(own, "test_id", "full_outer").select("test_id", F.inline(rows))


def rotation_scores(results: DataFrame, rules: DataFrame) -> DataFrame:
    """test_id, angle_0, angle_90, angle_180, angle_270 and weighted: upright pages weigh 10, the others 1, over the angles that occur."""
    angle = rules.where(F.col("type") == "rotate_check").select("test_id", "rule_id", F.get_json_object("rule", "$.value").cast("int").alias("angle"))
    by = results.join(angle, ["test_id", "rule_id"]).groupBy("test_id").agg(*(F.avg(F.when(F.col("angle") == a, F.col("score"))).alias(f"angle_{a}") for a in (0, 90, 180, 270)))
    weight = {0: 10.0, 90: 1.0, 180: 1.0, 270: 1.0}
    total = sum((F.when(F.col(f"angle_{a}").isNotNull(), F.lit(w)).otherwise(0.0) for a, w in weight.items()), F.lit(0.0))
    return by.withColumn("weighted", F.when(total > 0, sum((F.coalesce(F.col(f"angle_{a}") * w, F.lit(0.0)) for a, w in weight.items()), F.lit(0.0)) / total))
