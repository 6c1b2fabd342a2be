"""Queries of aggregation, comparison, leaderboards and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aggregate as A
from . import compare as C
from .catalog import query, read

# Cases from documents: two pipelines, two product types, some failures of each kind. Values are multiples of 1/128, so sums are exact.
CASES_SQL = """
    SELECT 'p' || (doc_id % 2)::VARCHAR AS pipeline, doc_id::VARCHAR AS test_id, CASE WHEN doc_id % 5 < 3 THEN 'parse' ELSE 'extract' END AS product_type,
           doc_id % 13 <> 0 AS success,
           CASE WHEN doc_id % 13 <> 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'No layout data here' WHEN doc_id % 4 = 1 THEN 'Worker error: broke' WHEN doc_id % 4 = 2 THEN 'Worker error: not LayoutOutput' ELSE 'timeout' END AS error,
           lang, source, n_chars, doc_id
    FROM documents"""
METRICS_SQL = f"""
    SELECT pipeline, test_id, product_type, 'rule_pass_rate' AS metric, (n_chars % 129) / 128.0 AS value, n_chars % 129 AS passed, 128 AS total, NULL AS tp, NULL AS fp, NULL AS fn, NULL AS cnt, n_chars % 3 = 0 AS seen FROM ({CASES_SQL}) WHERE success
    UNION ALL SELECT pipeline, test_id, product_type, 'f_precision', (n_chars % 65) / 64.0, NULL, NULL, n_chars % 7, n_chars % 5, n_chars % 3, NULL, false FROM ({CASES_SQL}) WHERE success AND product_type = 'extract'
    UNION ALL SELECT pipeline, test_id, product_type, 'f_recall', (n_chars % 33) / 32.0, NULL, NULL, n_chars % 7, n_chars % 5, n_chars % 3, NULL, false FROM ({CASES_SQL}) WHERE success AND product_type = 'extract'
    UNION ALL SELECT pipeline, test_id, product_type, 'f_f1', (n_chars % 17) / 16.0, NULL, NULL, n_chars % 7, n_chars % 5, n_chars % 3, NULL, false FROM ({CASES_SQL}) WHERE success AND product_type = 'extract'
    UNION ALL SELECT pipeline, test_id, product_type, 'unmatched_gt_elements', n_chars % 11, NULL, NULL, NULL, NULL, NULL, n_chars % 11, false FROM ({CASES_SQL}) WHERE success"""


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(results, metrics) made of documents."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    error = F.when(i % 13 != 0, None).when(i % 4 == 0, "No layout data here").when(i % 4 == 1, "Worker error: broke").when(i % 4 == 2, "Worker error: not LayoutOutput").otherwise("timeout")
    r = d.select(F.concat(F.lit("p"), (i % 2).cast("string")).alias("pipeline"), i.cast("string").alias("test_id"), F.when(i % 5 < 3, "parse").otherwise("extract").alias("product_type"), (i % 13 != 0).alias("success"), error.alias("error"), F.array("lang", "source").alias("tags"), "n_chars")
    n, key = F.col("n_chars"), ("pipeline", "test_id", "product_type")
    part = lambda name, by, **more: F.struct(F.lit(name).alias("metric"), ((n % (by + 1)) / by).alias("value"), *(more.get(c, F.lit(None)).cast(A.OPTIONAL[c]).alias(c) for c in ("passed", "total", "tp", "fp", "fn", "cnt", "tables_predicted")))
    prf = {"tp": n % 7, "fp": n % 5, "fn": n % 3}
    own = F.array(part("rule_pass_rate", 128, passed=n % 129, total=F.lit(128), tables_predicted=n % 3 == 0), F.struct(F.lit("unmatched_gt_elements").alias("metric"), (n % 11).cast("double").alias("value"), *(F.lit(None).cast(A.OPTIONAL[c]).alias(c) for c in ("passed", "total", "tp", "fp", "fn")), (n % 11).alias("cnt"), F.lit(None).cast("boolean").alias("tables_predicted")))
    fields = F.array(part("f_precision", 64, **prf), part("f_recall", 32, **prf), part("f_f1", 16, **prf))
    m = r.where("success").select(*key, F.inline(F.when(F.col("product_type") == "extract", F.concat(own, fields)).otherwise(own)))
    return r.drop("n_chars"), m


def aggregate_sql(metrics: str, fails: str, by: str) -> str:
    return f"""
    WITH m AS ({metrics}), fails AS ({fails}),
    s AS (SELECT {by}, metric, product_type, sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi, count(cnt) AS has_cnt, sum(cnt) AS cnt, sum(passed) AS passed, sum(total) AS total,
                 sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(CASE WHEN seen THEN value END) AS p_s, count(CASE WHEN seen THEN value END) AS p_n, min(CASE WHEN seen THEN value END) AS p_lo, max(CASE WHEN seen THEN value END) AS p_hi
          FROM m GROUP BY ALL),
    t AS (SELECT {", ".join(f"s.{c.strip()}" for c in by.split(","))}, s.metric, {", ".join(f"sum(s.{c}) AS {c}" for c in ("s", "n", "has_cnt", "cnt", "passed", "total", "tp", "fp", "fn", "p_s", "p_n"))},
                 min(s.lo) AS lo, max(s.hi) AS hi, min(s.p_lo) AS p_lo, max(s.p_hi) AS p_hi,
                 CASE WHEN sum(s.has_cnt) = 0 AND min(s.lo) >= 0 AND max(s.hi) <= 1 AND s.metric <> 'unmatched_gt_elements' THEN coalesce(sum(fails.fails), 0) ELSE 0 END AS pad
          FROM s LEFT JOIN fails ON {" AND ".join(f"s.{c.strip()} = fails.{c.strip()}" for c in by.split(","))} AND s.product_type = fails.product_type GROUP BY {", ".join(f"s.{c.strip()}" for c in by.split(","))}, s.metric),
    f AS (SELECT {by}, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM t WHERE metric = 'f_precision')
    SELECT {by}, name, value::DOUBLE AS value FROM (
        SELECT {by}, 'avg_' || metric AS name, s / (n + pad) AS value FROM t UNION ALL SELECT {by}, 'min_' || metric, CASE WHEN pad > 0 THEN least(0, lo) ELSE lo END FROM t UNION ALL SELECT {by}, 'max_' || metric, hi FROM t
        UNION ALL SELECT {by}, 'total_' || metric || '_passed', passed FROM t WHERE total > 0 UNION ALL SELECT {by}, 'total_' || metric || '_evaluated', total FROM t WHERE total > 0 UNION ALL SELECT {by}, 'micro_' || metric, passed / total FROM t WHERE total > 0
        UNION ALL SELECT {by}, 'total_' || metric || '_tp', tp FROM t UNION ALL SELECT {by}, 'total_' || metric || '_fp', fp FROM t UNION ALL SELECT {by}, 'total_' || metric || '_fn', fn FROM t
        UNION ALL SELECT {by}, 'avg_' || metric || '_predicted', p_s / p_n FROM t WHERE p_n > 0 UNION ALL SELECT {by}, 'min_' || metric || '_predicted', p_lo FROM t UNION ALL SELECT {by}, 'max_' || metric || '_predicted', p_hi FROM t
        UNION ALL SELECT {by}, 'total_' || metric, cnt FROM t WHERE has_cnt > 0
        UNION ALL SELECT {by}, 'micro_f_precision', p FROM f UNION ALL SELECT {by}, 'micro_f_recall', r FROM f UNION ALL SELECT {by}, 'micro_f_f1', 2 * p * r / (p + r) FROM f) WHERE value IS NOT NULL"""


FAILED = "NOT success AND error NOT LIKE '%No layout data%' AND (error NOT LIKE 'Worker error:%' OR error LIKE '%not LayoutOutput%')"


@query(aggregate_sql(METRICS_SQL, f"SELECT pipeline, product_type, count(*) AS fails FROM ({CASES_SQL}) WHERE {FAILED} GROUP BY ALL", "pipeline"))
def agg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = cases(spark, sf_dir)
    return A.aggregate_metrics(m, r)


TAGS = "SELECT test_id AS t_id, unnest([lang, source]) AS tag FROM ({})".format(CASES_SQL)


@query(
    aggregate_sql(f"SELECT * FROM ({METRICS_SQL}) JOIN ({TAGS}) ON test_id = t_id", f"SELECT pipeline, tag, product_type, count(*) AS fails FROM ({CASES_SQL}) JOIN ({TAGS}) ON test_id = t_id WHERE {FAILED} GROUP BY ALL", "pipeline, tag")
    + f" UNION ALL SELECT pipeline, tag, 'example_count', count(*)::DOUBLE FROM ({CASES_SQL}) JOIN ({TAGS}) ON test_id = t_id GROUP BY ALL"
)
def agg_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = cases(spark, sf_dir)
    return A.tag_metrics(m, r)


@query(f"""SELECT pipeline, count(*) AS cases, count(CASE WHEN success THEN 1 END) AS successful, count(CASE WHEN {FAILED} THEN 1 END) AS failed,
           count(CASE WHEN NOT success AND error LIKE '%No layout data%' THEN 1 END) AS skipped,
           count(CASE WHEN NOT success AND error LIKE 'Worker error:%' AND error NOT LIKE '%not LayoutOutput%' THEN 1 END) AS infra FROM ({CASES_SQL}) GROUP BY 1""")
def agg_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_summary(cases(spark, sf_dir)[0])


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, min(value) AS min, max(value) AS max, max(CASE WHEN i = least(n * 50 // 100, n - 1) THEN value END) AS p50, max(CASE WHEN i = least(n * 90 // 100, n - 1) THEN value END) AS p90,
           max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN value END) AS p95, max(CASE WHEN i = least(n * 99 // 100, n - 1) THEN value END) AS p99, round(sum(value), 4) AS total, round(avg(value), 6) AS avg FROM v GROUP BY 1""")
def op_stats_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.stats(read(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumns({"total": F.round("total", 4), "avg": F.round("avg", 6)})


RULES_SQL = """
    SELECT 'p' || (doc_id % 2)::VARCHAR AS pipeline, (doc_id // 24)::VARCHAR AS test_id,
           ['missing_word_percent','order','is_title','is_bold','is_not_bold','is_latex','is_code_block','is_sup','bag_of_digit_percent','title_hierarchy_percent','is_not_sub','is_strikeout'][(doc_id // 2 % 12 + 1)::INT] AS type,
           (n_chars % 129) / 128.0 AS score FROM documents"""


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = ["missing_word_percent", "order", "is_title", "is_bold", "is_not_bold", "is_latex", "is_code_block", "is_sup", "bag_of_digit_percent", "title_hierarchy_percent", "is_not_sub", "is_strikeout"]
    i, s = F.col("doc_id"), F.col("n_chars") % 129
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (i % 2).cast("string")).alias("pipeline"), F.floor(i / 24).cast("string").alias("test_id"), F.element_at(F.array(*map(F.lit, types)), (F.floor(i / 2) % 12 + 1).cast("int")).alias("type"), (s / 128).alias("score"), (s == 128).alias("passed"))


@query(f"SELECT pipeline, test_id, type, avg(score)::DOUBLE AS score, count(*) AS rules FROM ({RULES_SQL}) GROUP BY ALL")
def rule_type_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.type_means(rule_rows(spark, sf_dir))


@query(f"SELECT pipeline, test_id, avg(score)::DOUBLE AS value, count(CASE WHEN score = 1 THEN 1 END) AS passed, count(*) AS total, 'rule_pass_rate' AS metric FROM ({RULES_SQL}) GROUP BY pipeline, test_id")
def rule_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rule_pass_rate(rule_rows(spark, sf_dir))


def weighted_sql(parts: dict[str, float]) -> str:
    up = " + ".join(f"coalesce({c} * {x}::DOUBLE, 0)" for c, x in parts.items())
    down = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {x}::DOUBLE ELSE 0 END" for c, x in parts.items())
    return f"CASE WHEN {down} > 0 THEN ({up}) / ({down}) END"


@query(f"""WITH t AS (SELECT pipeline, test_id, type, avg(score) AS score, count(*) AS rules FROM ({RULES_SQL}) GROUP BY ALL),
    c AS (SELECT pipeline, test_id, avg(CASE WHEN type IN ('missing_word_percent', 'bag_of_digit_percent') THEN score END) AS text_correctness, avg(CASE WHEN type = 'order' THEN score END) AS "order",
                 avg(CASE WHEN type IN ('is_title', 'title_hierarchy_percent') THEN score END) AS title, avg(CASE WHEN type = 'is_code_block' THEN score END) AS code_block, avg(CASE WHEN type = 'is_latex' THEN score END) AS latex FROM t GROUP BY ALL),
    st AS (SELECT pipeline, test_id, regexp_replace(type, '^is_(not_)?', '') AS style, coalesce(max(CASE WHEN type NOT LIKE 'is_not_%' THEN score END), 1.0) AS pos, coalesce(max(CASE WHEN type LIKE 'is_not_%' THEN score END), 1.0) AS neg, sum(rules) AS rules
           FROM t WHERE type IN ('is_bold', 'is_not_bold', 'is_sup', 'is_not_sub', 'is_strikeout') GROUP BY ALL),
    sy AS (SELECT pipeline, test_id, sum(CASE WHEN 0.25 * pos + neg > 0 THEN 1.25 * pos * neg / (0.25 * pos + neg) ELSE 0 END * rules) / sum(rules) AS styling FROM st GROUP BY ALL),
    j AS (SELECT c.*, styling FROM c LEFT JOIN sy USING (pipeline, test_id))
    SELECT pipeline, test_id, {", ".join(f"round({e}, 9) AS {n}" for n, e in {**{c: c if c != "order" else '"order"' for c in ("text_correctness", "title", "code_block", "latex", "styling")}, "normalized_text_score": weighted_sql({(c if c != "order" else '"order"'): x for c, x in A.TEXT_SCORE.items()}), "content_faithfulness": weighted_sql({(c if c != "order" else '"order"'): x for c, x in A.FAITHFULNESS.items()}), "semantic_formatting": weighted_sql(A.SEMANTIC)}.items())} FROM j""")
def category_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.category_scores(rule_rows(spark, sf_dir)).drop("order")
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("pipeline", "test_id")})


COMPARE_SQL = """WITH a AS (SELECT o_orderkey, (o_totalprice::BIGINT % 5) / 4.0 AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, (o_custkey % 5) / 4.0 AS v FROM orders WHERE o_orderkey % 5 <> 0),
    j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.v AS a_value, b.v AS b_value FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
    c AS (SELECT o_orderkey, a_value::DOUBLE AS a_value, b_value::DOUBLE AS b_value, CASE WHEN b_value IS NULL THEN 'a_only' WHEN a_value IS NULL THEN 'b_only' WHEN a_value = b_value AND a_value = 0 THEN 'both_bad' WHEN a_value = b_value THEN 'tie' WHEN a_value > b_value THEN 'a_better' ELSE 'b_better' END AS category FROM j)"""


def scorings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    return o.where("o_orderkey % 7 <> 0").select("o_orderkey", ((F.round("o_totalprice").cast("long") % 5) / 4).alias("value")), o.where("o_orderkey % 5 <> 0").select("o_orderkey", ((F.col("o_custkey") % 5) / 4).alias("value"))


@query(COMPARE_SQL.replace("o_totalprice::BIGINT", "round(o_totalprice)::BIGINT") + " SELECT * FROM c")
def compare_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(*scorings(spark, sf_dir), key="o_orderkey")


@query(COMPARE_SQL.replace("o_totalprice::BIGINT", "round(o_totalprice)::BIGINT") + " SELECT category, count(*) AS cases, sum(coalesce(a_value, 0) - coalesce(b_value, 0)) AS difference FROM c GROUP BY 1")
def comparison_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparison_stats(C.compare(*scorings(spark, sf_dir), key="o_orderkey"))


BOARD_SQL = """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey * 7 % 101) * 1.0 END AS tables, (s_suppkey * 11 % 97) * 1.0 AS charts, (s_suppkey * 13 % 89) * 1.0 AS content_faithfulness, (s_suppkey * 17 % 83) * 1.0 AS semantic_formatting, (s_suppkey * 19 % 79) * 1.0 AS visual_grounding FROM supplier"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    parts = {"tables": F.when(k % 4 != 0, (k * 7 % 101).cast("double")), "charts": k * 11 % 97, "content_faithfulness": k * 13 % 89, "semantic_formatting": k * 17 % 83, "visual_grounding": k * 19 % 79}
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", *(v.cast("double").alias(c) for c, v in parts.items()))


@query(f"WITH b AS ({BOARD_SQL}), o AS (SELECT *, (coalesce(tables, 0) + charts + content_faithfulness + semantic_formatting + visual_grounding) / 5 AS overall FROM b) SELECT row_number() OVER (ORDER BY overall DESC, s_suppkey)::INT AS rank, s_suppkey, s_name, overall::DOUBLE AS overall FROM o ORDER BY overall DESC, s_suppkey LIMIT 10")
def leaderboard_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top(board(spark, sf_dir).select("s_suppkey", "s_name", C.overall().alias("overall")), F.col("overall"), 10, F.col("s_suppkey"))


@query(f"SELECT pipeline, max(CASE WHEN name = 'avg_f_f1' THEN value END) AS avg_f_f1, max(CASE WHEN name = 'avg_rule_pass_rate' THEN value END) AS avg_rule_pass_rate FROM ({aggregate_sql(METRICS_SQL, f'SELECT pipeline, product_type, count(*) AS fails FROM ({CASES_SQL}) WHERE {FAILED} GROUP BY ALL', 'pipeline')}) GROUP BY 1")
def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = cases(spark, sf_dir)
    return C.matrix(A.aggregate_metrics(m, r), ["avg_f_f1", "avg_rule_pass_rate"])


@query("""WITH o AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20), n AS (SELECT n_nationkey, n_name || '*' AS n_name FROM nation WHERE n_nationkey >= 15)
    SELECT coalesce(o.n_nationkey, n.n_nationkey) AS n_nationkey, coalesce(n.n_name, o.n_name) AS n_name, o.n_regionkey FROM o FULL JOIN n ON o.n_nationkey = n.n_nationkey""")
def leaderboard_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return C.merge_scores(n.where("n_nationkey < 20"), n.where("n_nationkey >= 15").select("n_nationkey", F.concat("n_name", F.lit("*")).alias("n_name")), "n_nationkey")


@query(f"SELECT test_id, max(CASE WHEN metric = 'f_f1' THEN value END)::DOUBLE AS f_f1, max(CASE WHEN metric = 'f_precision' THEN value END)::DOUBLE AS f_precision, max(CASE WHEN metric = 'rule_pass_rate' THEN value END)::DOUBLE AS rule_pass_rate FROM ({METRICS_SQL}) GROUP BY 1")
def csv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.wide(cases(spark, sf_dir)[1], "test_id", "metric", "value", ["rule_pass_rate", "f_precision", "f_f1"])


@query("SELECT page_id, url, (SELECT count(*) FROM pages) > 40 AS has_more FROM pages ORDER BY page_id LIMIT 20 OFFSET 20")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paginate(read(spark, sf_dir, "pages").select("page_id", "url"), [F.col("page_id")], 2, 20)


@query("""WITH p AS (SELECT source || '/' || lang || '/' || (doc_id % 3)::VARCHAR || '/' || doc_id::VARCHAR AS path FROM documents), f AS (SELECT string_split(path, '/') AS s FROM p), g AS (SELECT s, unnest(range(1, 4)) AS d FROM f)
    SELECT array_to_string(s[1:d], '/') AS folder, count(CASE WHEN d = 3 THEN 1 END) AS own, count(*) AS subtree FROM g GROUP BY 1""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.folder_rollup(read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 3).cast("string"), F.col("doc_id").cast("string")).alias("path")))
