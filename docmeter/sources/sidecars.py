"""Test cases from files beside documents: `<stem>.test.json`, and `<stem>.md` and `<stem>.csv` where there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "array<string>"
CHARTS = ("chart_data_array_labels", "chart_data_array_data")


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """stem (folder and name without the suffix), folder, name and value of all files below a path that match."""
    suffix = pattern.lstrip("*")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    stem = F.expr(f"substr(path, 1, length(path) - {len(suffix)})")
    return rows.select(stem.alias("stem"), F.element_at(F.split(stem, "/"), -2).alias("folder"), F.element_at(F.split(stem, "/"), -1).alias("name"), "value")


def kind(json: Column) -> Column:
    """extract with a schema, layout_detection with a layout rule, else parse."""
    rules = F.from_json(F.coalesce(F.get_json_object(json, "$.test_rules"), F.lit("[]")), "array<string>")
    layout = F.exists(rules, lambda r: F.coalesce(F.get_json_object(r, "$.type") == "layout", F.lit(False)))
    return F.when(F.get_json_object(json, "$.data_schema").isNotNull(), "extract").when(F.coalesce(layout, F.lit(False)), "layout_detection").otherwise("parse")


def cases(spark: SparkSession, path: str, *, product_type: str | None = None) -> DataFrame:
    """test_id, product_type, tags, expected_markdown, flags and rules of every sidecar. A file that is no JSON object ends the query.

    A document's tags go to its rules and back. Markdown in the sidecar comes before the file beside it. Chart rules get the path of the CSV file.
    """
    own = files(spark, path, "*.test.json")
    bad = F.raise_error(F.concat(F.lit("no JSON object in "), F.col("stem"))).cast("string")
    own = own.withColumn("value", F.when(F.get_json_object("value", "$").isNull() | ~F.trim("value").startswith("{"), bad).otherwise(F.col("value")))
    md = files(spark, path, "*.md").select("stem", F.col("value").alias("md"))
    get = lambda k, t="string": F.get_json_object("value", f"$.{k}").cast(t)
    none = F.array().cast(TAGS)
    rules = F.from_json(F.coalesce(get("test_rules"), F.lit("[]")), "array<string>")
    doc_tags = F.coalesce(F.from_json(get("tags"), TAGS), none)
    rule_tags = lambda r: F.coalesce(F.from_json(F.get_json_object(r, "$.tags"), TAGS), none)
    out = own.join(md, "stem", "left").withColumn("doc_tags", doc_tags).withColumn("raw", rules)
    typed = F.transform("raw", lambda r: F.struct(F.get_json_object(r, "$.type").alias("type"), F.array_distinct(F.concat("doc_tags", rule_tags(r))).alias("tags"), F.when(F.get_json_object(r, "$.type").isin(*CHARTS), F.concat("stem", F.lit(".csv"))).alias("csv_path"), r.alias("rule")))
    out = out.withColumn("rules", typed).select(
        F.concat_ws("/", "folder", "name").alias("test_id"), kind(F.col("value")).alias("product_type"), F.array_distinct(F.concat("doc_tags", F.flatten(F.transform("rules", lambda r: r["tags"])))).alias("tags"),
        F.coalesce(get("expected_markdown"), F.col("md")).alias("expected_markdown"), F.coalesce(get("allow_splitting_ambiguous_merged_tables", "boolean"), F.lit(False)).alias("allow_splitting"), F.coalesce(get("trm_unsupported", "boolean"), F.lit(False)).alias("trm_unsupported"),
        F.coalesce(get("max_top_title_rows", "int"), F.lit(1)).alias("max_top_title_rows"), F.coalesce(get("page_index", "int"), F.lit(0)).alias("page_index"), get("expected_output").alias("expected_output"), get("data_schema").alias("data_schema"), "rules",
    )
    return out if product_type is None else out.where(F.col("product_type") == product_type)


def load(spark: SparkSession, path: str, *, product_type: str | None = None) -> DataFrame:
    """Cases of a folder in either layout: rule files (`*.jsonl`, a rule a line), or sidecars."""
    from . import corpus

    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path")
    if listing.isEmpty():
        return cases(spark, path, product_type=product_type)
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).where(F.trim("value") != "")
    get = lambda k, t="string": F.get_json_object("value", f"$.{k}").cast(t)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1)
    rows = lines.select(F.coalesce(get("category"), name).alias("category"), get("pdf").alias("pdf"), get("id").alias("id"), get("type").alias("type"), get("page", "int").alias("page"), get("verified", "boolean").alias("verified"), F.from_json(get("tags"), TAGS).alias("tags"), get("expected_markdown").alias("expected_markdown"), get("rule").alias("rule"))
    return corpus.group_rules(rows)
