"""Queries of extraction, question answering, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..sources import corpus
from ..streaming import windows
from .catalog import query, read

FIELDS_SQL = "SELECT l_orderkey, 'lines[' || (l_linenumber - 1)::VARCHAR || '].' || k AS path, v AS value, l_partkey, l_linenumber FROM (SELECT *, unnest(['qty', 'flag']) AS k, unnest([l_quantity::BIGINT::VARCHAR, l_returnflag]) AS v FROM lineitem)"


def fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expected, actual): two fields of each line; the second has each seventh part missing and each fifth flag changed."""
    li = read(spark, sf_dir, "lineitem")
    path = lambda k: F.concat(F.lit("lines["), (F.col("l_linenumber") - 1).cast("string"), F.lit(f"].{k}"))
    f = li.select("l_orderkey", "l_partkey", "l_linenumber", F.inline(F.array(F.struct(path("qty").alias("path"), F.col("l_quantity").cast("long").cast("string").alias("value")), F.struct(path("flag").alias("path"), F.col("l_returnflag").alias("value")))))
    a = f.where("l_partkey % 7 <> 0").withColumn("value", F.when((F.col("l_partkey") % 5 == 0) & F.col("path").endswith("flag"), "X").otherwise(F.col("value")))
    return f.drop("l_partkey", "l_linenumber"), a.drop("l_partkey", "l_linenumber")


@query(f"""WITH e AS (SELECT l_orderkey, regexp_replace(path, '\\[\\d+\\]', '[*]', 'g') AS pattern, value, count(*) AS e FROM ({FIELDS_SQL}) GROUP BY ALL),
    a AS (SELECT l_orderkey, regexp_replace(path, '\\[\\d+\\]', '[*]', 'g') AS pattern, CASE WHEN l_partkey % 5 = 0 AND path LIKE '%flag' THEN 'X' ELSE value END AS value, count(*) AS a FROM ({FIELDS_SQL}) WHERE l_partkey % 7 <> 0 GROUP BY ALL),
    j AS (SELECT coalesce(e.pattern, a.pattern) AS pattern, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.pattern = a.pattern AND e.value = a.value),
    g AS (SELECT pattern, sum(least(e, a))::BIGINT AS tp, sum(greatest(a - e, 0))::BIGINT AS fp, sum(greatest(e - a, 0))::BIGINT AS fn FROM j GROUP BY 1), s AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM g)
    SELECT pattern, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM s""")
def value_prf_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.value_scores(*fields(spark, sf_dir), "l_orderkey").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""WITH e AS (SELECT l_orderkey, l_quantity, l_returnflag, count(*) AS e FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, l_quantity, CASE WHEN l_partkey % 5 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, count(*) AS a FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY ALL),
    j AS (SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.l_quantity = a.l_quantity AND e.l_returnflag = a.l_returnflag),
    g AS (SELECT l_orderkey, sum(least(e, a)) AS hit, sum(e) AS e, sum(a) AS a FROM j GROUP BY 1), s AS (SELECT l_orderkey, CASE WHEN a > 0 THEN hit / a ELSE 0 END AS p, hit / e AS r FROM g)
    SELECT l_orderkey, round(p::DOUBLE, 9) AS record_precision, round(r::DOUBLE, 9) AS record_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE, 9) AS record_f1 FROM s""")
def record_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    e = li.select("l_orderkey", "l_quantity", "l_returnflag")
    a = li.where("l_partkey % 7 <> 0").select("l_orderkey", "l_quantity", F.when(F.col("l_partkey") % 5 == 0, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    return X.record_scores(e, a, "l_orderkey", ["l_quantity", "l_returnflag"]).withColumns({c: F.round(c, 9) for c in ("record_precision", "record_recall", "record_f1")})


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props::JSON ->> 'k') END AS value FROM events), a AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN props::JSON ->> 'k' END AS got FROM events)
    SELECT event_type, avg((got IS NOT NULL)::INT)::DOUBLE AS rate FROM e JOIN a USING (event_id) WHERE value IS NULL GROUP BY 1""")
def null_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.get_json_object("props", "$.k")
    rows = e.select("event_id", "event_type", F.lit("k").alias("path"), F.when(F.col("event_id") % 3 != 0, k).alias("value"), F.when(F.col("event_id") % 4 != 0, k).alias("got"))
    per = X.null_hallucination(rows.select("event_id", "path", "value"), rows.select("event_id", "path", F.col("got").alias("value")), "event_id")
    return per.join(rows.select("event_id", "event_type"), "event_id").groupBy("event_type").agg(F.avg("rate").alias("rate"))


@query("SELECT event_id, props::JSON ->> 'k' AS v FROM events")
def json_path_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')").alias("v"))


@query("""WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(v) > 3 AS longer, len(v) >= 2 AND v[1:2] = [1, 2] AS head, len(v) >= 1 AND v[len(v)] = 4 AS tail FROM o""")
def array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"]).alias("v"))
    v = F.col("v")
    return o.select("l_orderkey", X.array_length(v, "gt", 3).alias("longer"), X.array_head(v, F.array(F.lit(1), F.lit(2))).alias("head"), X.array_tail(v, F.array(F.lit(4))).alias("tail"))


@query("SELECT doc_id, substr(sha256(source || chr(0) || lang), 1, 16) AS rule_id FROM documents")
def rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.rule_id_column(F.col("source"), F.col("lang")).alias("rule_id"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [F.date_format("o_orderdate", f) for f in ("MM-dd-yyyy", "EEEE MMMM d, yyyy", "MMMM d, yyyy")]
    return read(spark, sf_dir, "orders").select("o_orderkey", X.date_column(F.element_at(F.array(*forms), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("d"))


@query("""SELECT source, lang, count(*) AS rules, count(CASE WHEN doc_id % 10 <> 3 THEN 1 END) AS verified, min(text) AS expected FROM (SELECT *, text FROM documents) GROUP BY 1, 2""".replace("min(text) AS expected", "min_by(text, doc_id) AS expected"))
def corpus_group_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    rules = d.select(F.col("source").alias("category"), F.col("lang").alias("pdf"), F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 10 == 3, F.lit(False)).alias("verified"), F.struct("doc_id", F.col("text").alias("t")).alias("md"))
    return corpus.group_counts(rules).select(F.col("category").alias("source"), F.col("pdf").alias("lang"), "rules", "verified", "expected")


@query("SELECT o_orderkey::VARCHAR AS test_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("test_id"))
    got = read(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").cast("string").alias("example_id"))
    return corpus.missing(cases, got).select("test_id")


@query("SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS test_id, conv_id::VARCHAR AS example_id FROM conversations UNION ALL SELECT DISTINCT conv_id::VARCHAR, conv_id::VARCHAR FROM conversations WHERE conv_id % 2 = 0")
def page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    cases = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("test_id")).unionByName(c.where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("test_id")).distinct())
    return corpus.match_pages(cases, c.select(F.col("conv_id").cast("string").alias("example_id")).distinct())


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def resumable_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id")
    return corpus.remaining(e, e.where("event_id % 3 = 0"), "event_id")


@query("SELECT test_id, name, value, unit FROM (SELECT event_id AS test_id, unnest(['latency', 'cost']) AS name, unnest([value, (props::JSON ->> 'k')::DOUBLE]) AS value, unnest(['ms', 'usd']) AS unit FROM events) WHERE value IS NOT NULL")
def operational_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("test_id"), F.to_json(F.struct(F.col("value").alias("latency"), F.get_json_object("props", "$.k").try_cast("double").alias("cost"))).alias("raw"))
    return corpus.stats(e, "test_id", "raw", {"latency": "ms", "cost": "usd"})


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's windows on the whole table; the stream itself gives the same rows once its watermark has passed."""
    return windows.tumbling(read(spark, sf_dir, "events"), "1 day").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return windows.sessions(e, "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("first_ts"), "n")


@query("""SELECT d.doc_id::VARCHAR AS test_id, '{"lang":"' || d.lang || '","n_chars":' || d.n_chars || '}' AS expected, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IS NOT NULL""")
def report_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's expectation as JSON beside its result."""
    d = read(spark, sf_dir, "documents").where("lang is not null").select(F.col("doc_id").cast("string").alias("test_id"), F.to_json(F.struct("lang", "n_chars")).alias("expected"))
    return d.join(read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("test_id"), "quality"), "test_id", "left")
