"""Sources: rule corpora, predictions, their matching, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "pdf string, category string, id string, type string, page int, verified boolean, tags array<string>, expected_markdown string, rule string"
BOX = "struct<x:double,y:double,w:double,h:double>"
SEGMENT = "struct<x:double,y:double,w:double,h:double,confidence:double,label:string,start_index:int,end_index:int>"
ITEM = f"struct<type:string,md:string,html:string,value:string,bbox:{BOX},layout_segments:array<{SEGMENT}>>"
PAGE = f"struct<page_number:int,width:double,height:double,md:string,text:string,page_header_markdown:string,page_footer_markdown:string,printed_page_number:string,original_orientation_angle:int,items:array<{ITEM}>>"
OUTPUT = f"struct<task_type:string,example_id:string,pipeline_name:string,markdown:string,job_id:string,pages:array<struct<page_index:int,markdown:string>>,layout_pages:array<{PAGE}>,model:string,image_width:int,image_height:int,predictions:array<struct<bbox:array<double>,score:double,label:string,page:int>>,extracted_data:string,field_citations:array<struct<field_path:string,page:int,bbox:array<double>,reference_text:string,confidence:double,source:string>>>"
PREDICTION_SCHEMA = f"request struct<example_id:string,source_file_path:string,product_type:string>, pipeline_name string, product_type string, raw_output string, output {OUTPUT}, started_at timestamp_ntz, completed_at timestamp_ntz, latency_in_ms bigint, _corrupt_record string"
READY = ("chart.jsonl", "layout.jsonl", "table.jsonl", "text_content.jsonl", "text_formatting.jsonl")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSONL files, one a line; a broken line ends the read. The category defaults to the file's name; a rule encoded twice is decoded."""
    rows = spark.read.schema(RULE_SCHEMA).json(path, mode="FAILFAST").withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
    rule = F.when(F.col("rule").startswith('"'), F.expr("try_variant_get(try_parse_json(rule), '$', 'string')")).otherwise(F.col("rule"))
    return rows.withColumns({"category": F.coalesce("category", "file"), "rule": rule}).drop("file")


def group_rules(rules: DataFrame, markdown: DataFrame | None = None) -> DataFrame:
    """One test case for each (category, pdf): rules, tags, and the first expected markdown by id, else that of the side map (pdf, md)."""
    first = F.min(F.when(F.col("expected_markdown").isNotNull(), F.struct("id", "expected_markdown")))["expected_markdown"]
    g = rules.groupBy("category", "pdf").agg(F.array_sort(F.collect_list(F.struct("id", "type", "page", "verified", "tags", "rule"))).alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), first.alias("expected_markdown"))
    if markdown is not None:
        g = g.join(markdown.select("pdf", F.col("md").alias("__md")), "pdf", "left").withColumn("expected_markdown", F.coalesce("expected_markdown", "__md")).drop("__md")
    return g.withColumn("test_id", F.concat_ws("/", "category", "pdf"))


def group_counts(rules: DataFrame) -> DataFrame:
    """Status of a corpus: rules and verified rules of each (category, pdf), and the markdown of the first id."""
    return rules.groupBy("category", "pdf").agg(F.count(F.lit(1)).alias("rules"), F.count(F.when(verified(), 1)).alias("verified"), F.min("md")["t"].alias("expected"))


def verified() -> Column:
    """Rules not marked as unverified."""
    return F.coalesce(F.col("verified"), F.lit(True))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of all *.result.json files below a path; a broken file becomes a row with _corrupt_record."""
    return spark.read.schema(PREDICTION_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.result.json").option("multiLine", True).json(path, mode="PERMISSIVE")


def match(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions with the test case of their id: equal, or equal in NFC form, or that without the extension; the closest form wins."""
    from ..functions.text import nfc_udf

    c = cases.withColumn("k", nfc_udf(F.col("test_id")))
    p = predictions.withColumn("k1", nfc_udf(F.col("example_id"))).withColumn("k2", F.regexp_replace("k1", r"\.[^./]+$", ""))
    forms = p.select("*", F.explode(F.array_distinct(F.array("k1", "k2"))).alias("k"))
    j = forms.join(c, "k")
    best = F.when(F.col("example_id") == F.col("test_id"), 0).when(F.col("k") == F.col("k1"), 1).otherwise(2)
    return j.groupBy("example_id").agg(F.min(F.struct(best.alias("r"), "test_id"))["test_id"].alias("test_id"))


def match_pages(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """test_id, example_id: a document's prediction meets the case of its id and those of its pages (`id/…`). The prefix is cut off, so the join is on equal keys."""
    c = cases.select("test_id", F.explode(F.array_distinct(F.array("test_id", F.regexp_replace("test_id", "/[^/]*$", "")))).alias("example_id"))
    return c.join(predictions.select("example_id"), "example_id").select("test_id", "example_id")


def missing(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases without any prediction, as blank failures of product type parse."""
    gone = cases.join(predictions.select(F.col("example_id").alias("test_id")).distinct(), "test_id", "left_anti")
    return gone.select("*", F.lit("").alias("markdown"), F.lit(False).alias("success"), F.lit("parse").alias("produced_as"))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def stats(rows: DataFrame, key: str, raw: str, units: dict[str, str]) -> DataFrame:
    """key, name, value, unit of the raw answer's operational figures that are there."""
    parts = F.array(*(F.struct(F.lit(n).alias("name"), F.get_json_object(raw, f"$.{n}").try_cast("double").alias("value"), F.lit(u).alias("unit")) for n, u in units.items()))
    return rows.select(key, F.inline(parts)).where("value is not null")


def write_results(results: DataFrame, path: str) -> None:
    """Results by pipeline and group, for pruning."""
    results.write.mode("overwrite").partitionBy("pipeline", "grp").parquet(path)


def report_blob(results: DataFrame, expected: DataFrame, key: str = "test_id") -> DataFrame:
    """key, blob: one JSON object for each case, of all that is known of it."""
    return results.join(expected, key, "left").select(key, F.to_json(F.struct("*")).alias("blob"))


def markdown_summary(aggregates: DataFrame, pipeline: str) -> str:
    """The summary text of a pipeline; an aggregate has some hundred rows."""
    rows = aggregates.where(F.col("pipeline") == pipeline).orderBy("name").collect()
    return "\n".join([f"# {pipeline}", "", "| Metric | Value |", "|---|---|", *(f"| {r['name']} | {r['value']:.4f} |" for r in rows)])


def ready(spark: SparkSession, path: str) -> list[str]:
    """Files of a corpus that are missing, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f for f in (*READY, "docs") if not fs.exists(jvm.org.apache.hadoop.fs.Path(p, f))]


def rule_csv(results: DataFrame, path: str) -> None:
    """Rule results as CSV files with a header, one folder for each pipeline if there is one."""
    out = results.select(*(F.col(c).cast("string").alias(c) for c in results.columns))
    writer = out.write.mode("overwrite").option("header", True)
    (writer.partitionBy("pipeline") if "pipeline" in results.columns else writer).csv(path)


def skip_rows(lines: list[str]) -> int:
    """Leading CSV rows with one filled field at most."""
    import csv

    for i, row in enumerate(csv.reader(lines)):
        if sum(bool(x.strip()) for x in row) > 1:
            return i
    return 0
