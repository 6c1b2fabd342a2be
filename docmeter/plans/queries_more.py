"""Queries of strict comparison, set operations, labels and array rules over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strict
from ..operators import extract as X
from ..operators import sets as S
from ..sources import registry
from .catalog import query, read

HOW_SQL = "CASE o_orderkey % 8 WHEN 0 THEN 'identity' WHEN 1 THEN 'numeric' WHEN 2 THEN 'date' WHEN 3 THEN 'case_insensitive' WHEN 4 THEN 'trailing_punct_fold' WHEN 5 THEN 'footer_text_trim' WHEN 6 THEN 'annotation_truncated' ELSE 'none' END"


@query(f"SELECT o_orderkey, {HOW_SQL} AS how, o_orderkey % 8 <> 7 AS verified FROM orders")
def strict_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of orders against texts in another form; every eighth is another value."""
    k, price, day = F.col("o_orderkey"), F.format_number("o_totalprice", 2), F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderpriority")
    e = F.when(k % 8 == 1, F.col("o_totalprice").cast("string")).when(k % 8 == 2, day).otherwise(F.concat(F.lit("Order of "), kind, F.lit(" Class")))
    plain = F.concat(F.lit("Order of "), kind, F.lit(" Class"))
    t = F.when(k % 8 == 1, F.concat(F.lit("$"), price)).when(k % 8 == 2, F.date_format("o_orderdate", "MMMM d, yyyy")).when(k % 8 == 3, F.upper(plain)).when(k % 8 == 4, F.concat(plain, F.lit("."))).when(k % 8 == 5, F.concat(plain, F.lit("Monthly"))).when(k % 8 == 6, F.concat(plain, F.lit(" and more"))).when(k % 8 == 7, F.lit("another thing")).otherwise(plain)

    @F.pandas_udf("string")
    def how(e: pd.Series, kind: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([strict.compare(a, b, c).how for a, b, c in zip(e, kind, t, strict=True)])

    out = read(spark, sf_dir, "orders").select("o_orderkey", how(e, F.when(k % 8 == 1, "number").otherwise("string"), t).alias("how"))
    return out.withColumn("verified", F.col("how") != "none")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN true WHEN 2 THEN p_size = 7 ELSE p_size % 3 <> 0 END AS passed FROM part""")
def qa_answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds: letters, sets of letters, numbers, and sets between commas."""
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    kind = F.when(k == 0, "single").when(k == 1, "multiple").when(k == 2, "numerical").otherwise("free")
    e = F.when(k == 0, "B").when(k == 1, "A, C").when(k == 2, "7").otherwise("red, blue")
    a = F.when(k == 0, F.when(s % 2 == 0, "The answer is B").otherwise("C")).when(k == 1, "C and A").when(k == 2, F.concat(F.lit("$"), s.cast("string"), F.lit(".00"))).otherwise(F.when(s % 3 != 0, "Blue, Red").otherwise("blue"))
    return read(spark, sf_dir, "part").select("p_partkey", X.answer_match(kind, e, a).alias("passed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round((1 + (l_partkey % 3 <> 0)::INT + (l_partkey % 5 <> 0)::INT + (l_partkey % 2)) / 4.0, 9)::DOUBLE AS score FROM lineitem""")
def extract_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leaves of a line: a text in another case, a number, a date in another form, and a list by index."""
    li, k = read(spark, sf_dir, "lineitem"), F.col("l_partkey")
    day = lambda f: F.date_format("l_shipdate", f)
    e = F.to_json(F.struct(F.lit("ship").alias("mode"), F.col("l_quantity").alias("n"), F.struct(day("yyyy-MM-dd").alias("day")).alias("when"), F.array(F.lit("a")).alias("tags")))
    a = F.to_json(F.struct(F.lit("SHIP").alias("mode"), F.when(k % 3 != 0, F.col("l_quantity")).otherwise(F.lit(-1.0)).alias("n"), F.struct(F.when(k % 5 != 0, day("MM/dd/yyyy")).otherwise("never").alias("day")).alias("when"), F.array(F.when(k % 2 == 1, "a").otherwise("b")).alias("tags"), F.lit(1).alias("more")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.accuracy_udf()(e, a), 9).alias("score"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 3 = 0 WHEN 1 THEN c_custkey % 5 <> 0 WHEN 2 THEN c_custkey % 7 <> 0 ELSE true END AS passed FROM customer")
def typed_value_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans, numbers, dates and texts, compared by their type."""
    k = F.col("c_custkey")
    n = F.round(F.abs("c_acctbal"), 2)
    kind = F.when(k % 4 == 0, "boolean").when(k % 4 == 1, "number").when(k % 4 == 2, "date").otherwise("string")
    e = F.when(k % 4 == 0, "true").when(k % 4 == 1, n.cast("string")).when(k % 4 == 2, "2024-03-05").otherwise(F.col("c_name"))
    a = F.when(k % 4 == 0, F.when(k % 3 == 0, "yes").otherwise("no")).when(k % 4 == 1, F.when(k % 5 != 0, F.concat(F.lit("$"), F.format_number(n, 2))).otherwise("none")).when(k % 4 == 2, F.when(k % 7 != 0, "03/05/2024").otherwise("03/06/2024")).otherwise(F.upper("c_name"))

    @F.pandas_udf("boolean")
    def same(e: pd.Series, a: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([X.same_value(x, y, z) for x, y, z in zip(e, a, kind, strict=True)])

    return read(spark, sf_dir, "customer").select("c_custkey", same(e, a, kind).alias("passed"))


# Expected: the lines of an order; found: the same lines, each one place later. Values are part keys, each used once under one pattern.
@query("""WITH l AS (SELECT l_orderkey AS k, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
    SELECT k, v, count(*) AS matched FROM l GROUP BY k, v""")
def index_tolerant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"), i.alias("i"))
    path = lambda n: F.concat(F.lit("lines["), n.cast("string"), F.lit("].part"))
    e, a = rows.select("k", path(F.col("i")).alias("path"), F.col("v").alias("value")), rows.select("k", path(F.col("i") + 1).alias("path"), F.col("v").alias("value"))
    m = X.index_tolerant(e, a, "k")
    return m.join(e, ["k", "path"]).groupBy("k", F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("matched"))


@query("SELECT event_id, user_id % 5 = 0 OR event_type = 'error' OR user_id % 7 = 0 AS stray FROM events")
def stray_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are missing, and tags that say that none is expected."""
    u, t = F.col("user_id"), F.col("event_type")
    tags = F.when(t == "error", F.array(F.lit("no_value"), t)).when(u % 7 == 0, F.array(F.lit("page:stray"))).otherwise(F.array(t))
    return read(spark, sf_dir, "events").select("event_id", X.stray(F.when(u % 5 != 0, F.col("value").cast("string")), tags).alias("stray"))


@query("""WITH a AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source, lang, count(*) AS m FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL)
    SELECT a.source, a.lang, n - coalesce(m, 0) AS n FROM a LEFT JOIN b ON a.source IS NOT DISTINCT FROM b.source AND a.lang IS NOT DISTINCT FROM b.lang WHERE n > coalesce(m, 0) AND a.source IS NOT NULL AND a.lang IS NOT NULL""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").where("source is not null and lang is not null")
    return S.multiset_difference(d, d.where("doc_id % 3 <> 0"), ["source"], "lang")


@query("""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS item FROM documents), n AS (SELECT source, item, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, item) AS r FROM n) SELECT source, string_agg(item, ',' ORDER BY r) AS items FROM r WHERE r <= 5 GROUP BY 1""")
def preview_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent words of each source."""
    w = read(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), 1)).alias("item"))
    n = w.groupBy("source", "item").agg(F.count(F.lit(1)).alias("n"))
    return S.preview(n, ["source"], "item", "n").select("source", F.array_join("items", ",").alias("items"))


@query("""WITH n AS (SELECT l_orderkey, l_quantity::INT AS q, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, q) AS r, count(*) OVER (PARTITION BY l_orderkey) AS kinds FROM n)
    SELECT l_orderkey, q AS mode, kinds = 1 AS even FROM r WHERE r = 1""")
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("q"))
    return S.modal(rows, ["l_orderkey"], "q")


@query("""SELECT c_custkey AS k, c_acctbal AS balance, NULL::VARCHAR AS segment, 'a' AS pipeline FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, c_mktsegment, 'b' FROM customer WHERE c_custkey % 2 = 1""")
def metric_name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pipelines with metrics of their own under one header."""
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    a = c.where("k % 2 = 0").select("k", F.col("c_acctbal").alias("balance"), F.lit("a").alias("pipeline"))
    b = c.where("k % 2 = 1").select("k", F.col("c_mktsegment").alias("segment"), F.lit("b").alias("pipeline"))
    return S.union_of_metrics([a, b])


@query("""SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS in_a, bool_or(o_orderstatus = 'O') AS in_b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders, open ones, or both."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return S.page_union(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["k"])


MAPS = [("acme", "m1", None, 0, "ECONOMY", "Table"), ("acme", None, "^m[23]$", 5, "ECONOMY", "Text"), ("acme", None, "^m", 1, "ECONOMY", "Picture"), ("acme", None, None, 0, "ECONOMY", "Title"), ("acme", None, None, 0, "STANDARD", "Caption")]


@query("SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'Caption' ELSE CASE p_partkey % 6 WHEN 1 THEN 'Table' WHEN 2 THEN 'Text' WHEN 3 THEN 'Text' WHEN 5 THEN 'Title' ELSE 'Picture' END END AS canonical FROM part WHERE split_part(p_type, ' ', 1) IN ('ECONOMY', 'STANDARD')")
def label_mapper_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by model, by pattern and priority, and by provider; unknown ones are dropped."""
    k = F.col("p_partkey") % 6
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lit("acme").alias("provider"), F.when(k == 5, "other").otherwise(F.concat(F.lit("m"), k.cast("string"))).alias("model"), F.split("p_type", " ")[0].alias("raw_label"))
    maps = spark.createDataFrame(MAPS, "provider string, model string, matcher string, priority int, raw_label string, canonical string")
    return S.mapped_labels(rows, maps).select("p_partkey", "canonical")


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS explicit, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey END AS nation FROM supplier")
def layout_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute maps with keys and values in any case and spacing."""
    k = F.col("s_suppkey")
    m = F.create_map(F.lit(" Explicit "), F.when(k % 3 == 0, " Yes").otherwise("no"), F.lit("NATION"), F.when(k % 2 == 0, F.concat(F.lit(" n"), F.col("s_nationkey").cast("string"))).otherwise(" "))
    own = S.normal_attributes(m)
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.is_true(own["explicit"]).alias("explicit"), own["nation"].alias("nation"))


# Answers of two shapes for the parts: a list of items, and pages of blocks in pixels. Both name the same box.
@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'flat' WHEN p_partkey % 3 = 1 THEN 'deep' ELSE 'other' END AS pipeline, p_brand AS cls, p_name AS text, round(p_size / 64.0::DOUBLE, 9) AS x0, round((p_size + 16) / 64.0::DOUBLE, 9) AS x1 FROM part")
def renormalised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers projected by the adapter of their pipeline: by key, by pattern, and by default."""
    reg = registry.Registry()
    reg.pipeline("flat", "acme", "one")
    reg.pipeline("deep", "acme", "two-v3")
    reg.pipeline("other", "none", "x")
    reg.adapter("acme/one")(registry.plain_items)
    reg.adapter(pattern=r"^acme/two", priority=2)(registry.nested_items)
    reg.adapter(pattern=r"^acme/", priority=1)(registry.plain_items)
    reg.adapter()(registry.plain_items)
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    flat = F.to_json(F.array(F.struct(F.lit(1).alias("page"), F.col("p_brand").alias("cls"), F.col("p_name").alias("text"), (s / 64).alias("x0"), F.lit(0.0).alias("y0"), ((s + 16) / 64).alias("x1"), F.lit(1.0).alias("y1"))))
    block = F.struct(F.col("p_brand").alias("type"), F.col("p_name").alias("text"), (10 * s).alias("x"), F.lit(0.0).alias("y"), F.lit(160.0).alias("w"), F.lit(100.0).alias("h"))
    deep = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("number"), F.lit(640.0).alias("width"), F.lit(100.0).alias("height"), F.array(block).alias("blocks"))).alias("pages")))
    name = F.when(k % 3 == 0, "flat").when(k % 3 == 1, "deep").otherwise("other")
    p = read(spark, sf_dir, "part").select("p_partkey", name.alias("pipeline"), F.when(k % 3 == 1, deep).otherwise(flat).alias("raw"))
    return reg.renormalise(p).select("p_partkey", "pipeline", F.inline("items")).select("p_partkey", "pipeline", "cls", "text", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))
