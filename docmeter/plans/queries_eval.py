"""The evaluation run over a page for each customer: rules of every family, their results, and the rates made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from .catalog import query, read

# A page leaves something out by its customer's key: the SQL says which rules it then fails.
CASES = [
    ("title", "is_title", "k % 7 <> 0"), ("bold", "is_bold", "k % 3 <> 0"), ("not_bold", "is_not_bold", "k % 3 = 0"), ("strike", "is_strikeout", "k % 8 <> 0"), ("sub", "is_sub", "k % 8 <> 0"),
    ("color", "mark_color", "k % 8 <> 0"), ("there", "present", "k % 5 <> 0"), ("gone", "absent", "k % 5 = 0"), ("order", "order", "k % 5 <> 0"), ("sentences", "missing_sentence_percent", "k % 5 <> 0"),
    ("twice", "too_many_sentence_occurence", "NOT (k % 11 = 0 AND k % 5 <> 0)"), ("words", "missing_word_percent", "k % 5 <> 0"), ("word", "missing_specific_word", "k % 5 <> 0"), ("right", "table_adjacent_right", "k % 4 <> 0"),
    ("left", "table_adjacent_left", "k % 4 = 0"), ("edge", "table_no_left", "k % 4 <> 0"), ("end", "table_no_right", "k % 4 = 0"), ("head", "table_top_header", "true"), ("span", "table_colspan", "k % 2 = 0"), ("chain", "table_header_chain", "true"),
    ("cell", "table", "k % 4 <> 0"), ("values", "tables_values", "k % 4 <> 0 AND k % 2 = 0"), ("rows", "tables_num_rows", "k % 3 = 1"), ("code", "is_code_block", "k % 6 = 0"), ("formula", "is_latex", "k % 9 = 0"), ("angle", "rotate_check", "k % 4 = 1"),
    ("header", "is_header", "k % 10 <> 0"), ("box", "form_field", "k % 2 = 0"), ("tree", "title_hierarchy_percent", "k % 7 <> 0"), ("text", "baseline", "true"),
]
SCORES = {"sentences": "CASE WHEN k % 5 = 0 THEN 0.5 ELSE 1 END", "words": "CASE WHEN k % 5 = 0 THEN 0.5 ELSE 1 END"}
RESULTS_SQL = "WITH c AS (SELECT c_custkey AS k FROM customer) " + " UNION ALL ".join(
    f"SELECT k AS test_id, '{i}' AS rule_id, '{t}' AS type, k % 13 <> 0 AND ({ok}) AS passed, (CASE WHEN k % 13 = 0 THEN 0 ELSE {SCORES.get(i, f'({ok})::INT')} END)::DOUBLE AS score FROM c" for i, t, ok in CASES
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test_id, text, headers, angle and k, seg of each customer."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("n"), F.col("c_mktsegment").alias("seg"))
    k, key = F.col("k"), F.col("k").cast("string")
    b = (k * 37 % 1000).cast("string")
    say = F.concat(F.lit("The market segment is "), F.col("seg"), F.lit(" today."))
    pick = lambda by, yes, no: F.when(k % by == 0, yes).otherwise(no)
    td = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    nation, value = td(F.concat(F.lit("nat"), "n")), td(F.concat(F.lit("val"), b))
    table = F.concat(
        F.lit("<table><tr>"), pick(4, F.lit("<th>Value</th><th>Nation</th>"), F.lit("<th>Nation</th><th>Value</th>")), F.lit("</tr><tr>"), pick(4, F.concat(value, nation), F.concat(nation, value)),
        F.lit("</tr><tr>"), pick(2, F.lit('<td colspan="2">Total line</td>'), F.lit("<td>Total line</td><td>end</td>")), F.lit("</tr></table>"),
    )
    lines = [
        F.concat(pick(7, F.lit(""), F.lit("# ")), F.lit("Profile of client "), key), F.lit(""), F.concat(pick(3, F.lit("Balance: "), F.lit("**Balance:** ")), b), pick(5, F.lit("Nothing to say here."), say),
        F.when((k % 11 == 0) & (k % 5 != 0), say).otherwise(""), pick(6, F.concat(F.lit("```python\nprint("), key, F.lit(")\n```")), F.concat(F.lit("```sql\nselect "), key, F.lit("\n```"))),
        pick(9, F.concat(F.lit("Formula $a + "), key, F.lit("$.")), F.lit("Formula none.")), pick(8, F.lit("old H2O hot"), F.lit('~~old~~ H<sub>2</sub>O <mark style="color:red">hot</mark>')), pick(2, F.lit("- [x] Active"), F.lit("- [ ] Active")), table,
    ]
    text = F.when(k % 13 == 0, "").otherwise(F.array_join(F.array(*lines), "\n"))
    head = pick(10, F.lit("none"), F.concat(F.lit("Header of "), "seg"))
    return c.select(k.alias("test_id"), text.alias("text"), F.create_map(F.lit(1), head).alias("headers"), (90 * (k % 4)).cast("int").alias("angle"), "k", "n", "seg", b.alias("b"))


def rules(docs: DataFrame) -> DataFrame:
    """test_id, rule_id and rule (JSON, every second one encoded twice) of each page, and one rule that is not verified."""
    key = F.col("k").cast("string")
    profile, say = F.concat(F.lit("Profile of client "), key), F.concat(F.lit("The market segment is "), "seg", F.lit(" today"))
    val, nat = F.concat(F.lit("val"), "b"), F.concat(F.lit("nat"), "n")
    cell = lambda *t: F.struct(F.array(*(F.struct(F.lit(x).alias("text") if isinstance(x, str) else x.alias("text"), F.lit(w).alias("colspan")) for x, w in t)).alias("cells"))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    own: dict[str, dict[str, object]] = {
        "title": {"text": profile}, "bold": {"text": "Balance"}, "not_bold": {"text": "Balance"}, "strike": {"text": "old"}, "sub": {"text": "2"}, "color": {"text": "hot", "color": "red"},
        "there": {"text": "The market segment is"}, "gone": {"text": "The market segment is"}, "order": {"before": "Balance", "after": "market segment"},
        "sentences": {"bag_of_sentence": F.create_map(say, F.lit(1), profile, F.lit(1))}, "twice": {"bag_of_sentence": F.create_map(say, F.lit(1))},
        "words": {"bag_of_word": F.create_map(*(F.lit(x) for w in ("market", "segment", "balance", "profile") for x in (w, 1)))}, "word": {"word": "segment"},
        "right": {"anchor_cell": "Nation", "expected_neighbor": "Value"}, "left": {"anchor_cell": "Nation", "expected_neighbor": "Value"}, "edge": {"cell": "Nation"}, "end": {"cell": "Nation", "table_anchor_cells": F.array(F.lit("Nation"))},
        "head": {"data_cell": val, "expected_header": "Value"}, "span": {"cell": "Total line", "expected_colspan": 2}, "chain": {"data_cell": nat, "column_headers": F.array(F.lit("Nation"))}, "cell": {"cell": val, "left": nat, "right": "zzzz", "top_heading": "Value"},
        "values": {"table_variations": F.array(F.struct(F.array(cell(("Nation", 1), ("Value", 1)), cell((nat, 1), (val, 1)), cell(("Total line", 2))).alias("rows"))), "table_match_threshold": 0.9, "table_values_match_threshold": 0.9},
        "rows": {"actual_num_rows": (F.col("k") % 3).cast("int"), "expected_num_rows": 1}, "code": {"language": "python", "code": F.concat(F.lit("print("), key, F.lit(")"))}, "formula": {"formula": F.concat(F.lit("a+"), key)},
        "angle": {"value": 90}, "header": {"text": F.concat(F.lit("Header of "), "seg"), "page": 1}, "box": {"field_type": "checkbox", "label": "Active", "value": "yes"}, "tree": {"title_hierarchy": F.create_map(profile, F.create_map().cast("map<string,string>"))}, "text": {},
    }
    made = []
    for i, (name, kind, _) in enumerate(CASES):
        rule = F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(name).alias("id"), *(lit(v).alias(k) for k, v in own[name].items())))
        twice = F.concat(F.lit('"'), F.replace(F.replace(rule, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        made.append(F.struct(F.lit(name).alias("rule_id"), (twice if i % 2 else rule).alias("rule")))
    made.append(F.struct(F.lit("open").alias("rule_id"), F.lit('{"type": "present", "text": "x", "verified": false}').alias("rule")))
    return docs.select("test_id", F.inline(F.array(*made)))


def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = pages(spark, sf_dir)
    own = E.coerced(rules(docs), verified_only=True)
    return docs, own, E.run_rules(own, docs.select("test_id", "text", "headers", "angle"))


@query(RESULTS_SQL)
def eval_rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of every page, dispatched by its type; blank pages fail all of theirs."""
    return results(spark, sf_dir)[2].select("test_id", "rule_id", "type", "passed", "score")


@query(f"""WITH r AS ({RESULTS_SQL}) SELECT test_id, 'rule_pass_rate' AS metric, round(avg(score), 9) AS value, count(CASE WHEN passed THEN 1 END) AS passed, count(*) AS total FROM r GROUP BY 1
    UNION ALL SELECT test_id, 'rule_' || type || '_pass_rate', round(avg(score), 9), count(CASE WHEN passed THEN 1 END), count(*) FROM r GROUP BY 1, type""")
def eval_document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pass rate of each page, over all rules and by type."""
    docs, _, r = results(spark, sf_dir)
    return E.document_metrics(r, docs).withColumn("value", F.round("value", 9))


@query(f"WITH r AS ({RESULTS_SQL}) SELECT type, round(avg(score), 9) AS value, count(CASE WHEN passed THEN 1 END) AS passed, count(*) AS total, count(CASE WHEN score = 0 THEN 1 END) AS zeros FROM r GROUP BY 1")
def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule type comes to over the whole run."""
    r = results(spark, sf_dir)[2]
    return r.groupBy("type").agg(F.round(F.avg("score"), 9).alias("value"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("score") == 0, 1)).alias("zeros"))


@query("""WITH c AS (SELECT c_nationkey AS n, 90 * (c_custkey % 4) AS a, (c_custkey % 13 <> 0 AND c_custkey % 4 = 90 * (c_custkey % 4) / 90 AND c_custkey % 3 <> 0)::INT AS s FROM customer),
    g AS (SELECT n, avg(CASE WHEN a = 0 THEN s END) AS a0, avg(CASE WHEN a = 90 THEN s END) AS a90, avg(CASE WHEN a = 180 THEN s END) AS a180, avg(CASE WHEN a = 270 THEN s END) AS a270 FROM c GROUP BY 1)
    SELECT n AS test_id, round((coalesce(10 * a0, 0) + coalesce(a90, 0) + coalesce(a180, 0) + coalesce(a270, 0)) / (CASE WHEN a0 IS NULL THEN 0 ELSE 10 END + (a90 IS NOT NULL)::INT + (a180 IS NOT NULL)::INT + (a270 IS NOT NULL)::INT), 9) AS weighted FROM g""")
def rotation_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation checks of a nation's customers, upright ones weighing ten times the others."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    own = c.select(F.col("c_nationkey").alias("test_id"), k.cast("string").alias("rule_id"), F.lit("rotate_check").alias("type"), F.to_json(F.struct((90 * (k % 4)).alias("value"))).alias("rule"))
    r = c.select(F.col("c_nationkey").alias("test_id"), k.cast("string").alias("rule_id"), ((k % 13 != 0) & (k % 3 != 0)).cast("double").alias("score"))
    return E.rotation_scores(r, own).select("test_id", F.round("weighted", 9).alias("weighted"))
