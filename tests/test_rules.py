"""Rules of every type on small pages, kernels of tables, charts and layouts against brute force, loaders on files."""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmeter.functions import headers, kernels, rules, strict, tables, trees
from docmeter.functions import text as T
from docmeter.operators import boxes, charts, evaluate, extract, formatting, layout, sets, text_rules
from docmeter.sources import sidecars


def run(md, **rule):
    return rules.score(rule, rules.Page(md))[:2]


STYLED = [
    ("**Bold words** and more", "bold", "Bold words", True), ("**Bold words**", "bold", "Bold", True), ("**one** two **three**", "bold", "two", False), ("  ## Head line", "bold", "Head", True), ("<strong>a</strong>", "bold", "a", False),
    ("<b>a</b> plain <b>c</b>", "bold", "plain", False), ("***both***", "bold", "both", True), ("*slanted ones*", "italic", "slanted", True), ("<em>x</em>", "italic", "x", True), ("**x**", "italic", "x", False), ("~~gone~~", "strikeout", "gone", True),
    ("~~all gone~~", "strikeout", "gone", False), ("<del>gone</del>", "strikeout", "gone", True), ("<u>under it</u>", "underline", "under", False), ("<ins>under</ins>", "underline", "under", True), ("<mark>lit</mark>", "mark", "lit", True),
    ("x<sup>2</sup>", "sup", "2", True), ("x²", "sup", "2", True), ("x<sup>23</sup>", "sup", "2", False), ("H<sub>2</sub>O", "sub", "2", True), ("H₂O", "sub", "2", True), ("**a ~~b~~ c**", "bold", "a b c", True),
]


@pytest.mark.parametrize("text, kind, query, there", STYLED)
def test_styles(text, kind, query, there):
    assert run(text, type=f"is_{kind}", text=query) == (float(there), there)
    assert run(text, type=f"is_not_{kind}", text=query) == (float(not there), not there)


def test_styles_in_catalyst(spark):
    d = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(STYLED)], "id int, md string, style string, q string")
    hit = F.lit(None).cast("boolean")
    for s in rules.SPANS:
        hit = F.when(F.col("style") == s, formatting.has_style(F.col("md"), F.col("q"), s)).otherwise(hit)
    assert [r["hit"] for r in d.select("id", hit.alias("hit")).orderBy("id").collect()] == [x[3] for x in STYLED]


@pytest.mark.parametrize("text, rule, want", [
    ("Sum: $a + b$ and $$c$$", {"type": "is_latex", "formula": "$a+b$"}, 1.0), ("none", {"type": "is_latex", "formula": "$a$"}, 0.0), ("```python\nprint(1)\n```\n", {"type": "is_code_block", "language": "python", "code": "print(1)"}, 1.0),
    ("```sql\nselect\n```\n", {"type": "is_code_block", "language": "python", "code": "select"}, 0.0), ("# A\n\n## B\n\n## C\n", {"type": "title_hierarchy_percent", "title_hierarchy": {"A": {"B": {}, "C": {}}}}, 1.0),
    ("# A\n\ntext\n", {"type": "title_hierarchy_percent", "title_hierarchy": {"A": {"B": {}}}}, 1 / 3), ("nothing", {"type": "title_hierarchy_percent", "title_hierarchy": {"A": {}}}, 0.0), ('<mark style="color: red">hot</mark>', {"type": "mark_color", "text": "hot", "color": "red"}, 1.0),
    ('<mark style="color: blue">hot</mark>', {"type": "mark_color", "text": "hot", "color": "red"}, 0.0), ("**Alone**", {"type": "is_title", "text": "alone"}, 1.0), ("&lt;h1&gt;Top&lt;/h1&gt;", {"type": "is_title", "text": "Top"}, 1.0), ("plain", {"type": "is_title", "text": "plain"}, 0.0),
    ("You can’t go", {"type": "missing_specific_word", "word": "can't"}, 1.0), ("Une équipe", {"type": "missing_specific_word", "word": "d'équipe"}, 1.0), ("nothing", {"type": "missing_specific_word", "word": "word"}, 0.0), ("検査abc結果", {"type": "missing_specific_word", "word": "結果"}, 1.0),
    ("<page_header>Big Name</page_header>", {"type": "is_header", "text": "big name"}, 1.0), ("the theatre", {"type": "missing_specific_sentence", "sentence": "Theatre"}, 1.0), ("", {"type": "absent", "text": "x"}, 0.0), ("x", {"type": "what"}, 0.0), ("x", {"type": "present"}, 0.0),
])
def test_other_rules(text, rule, want):
    assert rules.score(rule, rules.Page(text))[0] == pytest.approx(want)


def test_sentence_bags():
    text = "The first sentence is here. The second one, too! The first sentence is here.\n<table><tr><td>Hidden in a cell</td><td>of a row</td></tr></table>"
    bag = {"The first sentence is here": 2, "The second one, too": 1}
    assert run(text, type="missing_sentence_percent", bag_of_sentence=bag) == (1.0, True)
    assert run(text, type="missing_sentence_percent", bag_of_sentence=bag | {"Hidden in a cell of a row": 1, "Not there at all": 1}) == (pytest.approx(0.8), False)
    assert run(text, type="too_many_sentence_occurence_percent", bag_of_sentence={"The first sentence is here": 1}) == (0.5, False)
    assert run(text, type="unexpected_sentence_percent", bag_of_sentence={"The first sentence is here": 2}) == (pytest.approx(2 / 3), False)
    assert run(text, type="unexpected_sentence_percent", bag_of_sentence={"The first sentence is here": 2}, original_md="Before. The second one, too") == (1.0, True)
    assert run(text, type="unexpected_sentence", bag_of_sentence={"The first sentence is here and the second one, too": 1}) == (1.0, True)
    assert run(text, type="missing_sentence", bag_of_sentence={"Hidden in a cell": 1}) == (1.0, True)
    assert run("See A. Fig x. A longer sentence ends.", type="unexpected_sentence", bag_of_sentence={"See A Fig x": 1, "A longer sentence ends": 1})[1]


def test_word_bags():
    assert run("one two two $3 + x$ <b>three</b>", type="missing_word_percent", bag_of_word={"one": 1, "two": 3, "three": 1}) == (pytest.approx(0.8), False)
    assert run("one two two", type="too_many_word_occurence", bag_of_word={"two": 1}) == (0.0, False)
    assert run("one two two", type="unexpected_word_percent", bag_of_word={"two": 1}) == (pytest.approx(2 / 3), False)
    assert run("12 12 3<b class='9'>", type="bag_of_digit_percent", bag_of_digit={"1": 2, "2": 1, "9": 1}) == (pytest.approx(0.75), False)


NESTED = "<table><tr><th>Name</th><th colspan=2>Sizes</th></tr><tr><td>Tea</td><td>3</td><td>4</td></tr><tr><td>Inner <table><tr><td>deep</td><td>down</td></tr></table></td><td>5</td><td></td></tr></table><table><tr><td>Tea</td><td>9</td></tr></table>"


@pytest.mark.parametrize("rule, want", [
    ({"type": "table_adjacent_right", "anchor_cell": "deep", "expected_neighbor": "down"}, 1), ({"type": "table_adjacent_right", "anchor_cell": "Tea", "expected_neighbor": "9"}, 1), ({"type": "table_adjacent_right", "anchor_cell": "Tea", "expected_neighbor": "9", "table_anchor_cells": ["Sizes"]}, 0),
    ({"type": "table_adjacent_up", "anchor_cell": "3", "expected_neighbor": "Sizes"}, 1), ({"type": "table_adjacent_down", "anchor_cell": "Name", "expected_neighbor": "Tea"}, 1), ({"type": "table_adjacent_left", "anchor_cell": "4", "expected_neighbor": "3"}, 1), ({"type": "table_no_above", "cell": "Sizes"}, 1),
    ({"type": "table_no_below", "cell": "Name"}, 0), ({"type": "table_no_right", "cell": "5"}, 1), ({"type": "table_left_header", "data_cell": "4", "expected_header": "Tea"}, 1), ({"type": "table_header_chain", "data_cell": "4", "column_headers": ["Sizes"], "row_headers": ["Tea", "3"]}, 1),
    ({"type": "table_same_column", "cell_a": "Sizes", "cell_b": "4"}, 1), ({"type": "table_same_row", "cell_a": "Name", "cell_b": "4"}, 0), ({"type": "table_colspan", "cell": "Size", "expected_colspan": 2, "table_anchor_cells": ["Name"]}, 1), ({"type": "table_rowspan", "cell": "Name", "expected_rowspan": 2}, 0),
    ({"type": "table", "cell": "3", "left": "Tea", "top_heading": "Sizes"}, 1), ({"type": "table", "cell": "4", "left_heading": "Coffee"}, 0), ({"type": "tables_num_cols", "actual_num_cols": 3, "expected_num_cols": 3}, 1), ({"type": "tables_num_rows", "expected_num_rows": 3}, 0),
])
def test_table_rules(rule, want):
    assert run(NESTED, **rule) == (float(want), bool(want))


def test_numbers_of_charts():
    assert charts.readings("$39.2m") == [39.2e6] and charts.readings("~5%") == [5.0] and charts.readings("3,125") == [3125.0, 3.125] and charts.readings("(5)") == [] and charts.readings("6 888 €") == [6888.0] and charts.readings("2g") == [2e9] and charts.readings("1 bln") == [1e9]
    assert charts.close(100, 99) and not charts.close(100, 98.9) and charts.close(0, 0.005) and not charts.close(0, 0.02)
    assert charts.number_similarity(0, 0.0001) == 1 and charts.same_date("2008-04-01 00:00:00", "Q2-2008") and charts.same_date("1-2008", "01-2008") and not charts.same_date("2008", "2009")
    assert charts.cell_value(None, "n/a") == 1 and charts.cell_value("-", "0") == 1 and charts.cell_value("5000000", "5") == 1


def test_numbers_in_catalyst_are_those_in_python(spark):
    texts = ["$1,200", "~5 %", "3.5 million", "2k", "7 bln", "(5)", "none", "", "1e3", "-4", "5€", "1 trn", "12 mill", "nan", "1d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", charts.to_number(F.col("t")).alias("n")).collect()
    assert all(r["n"] == charts.parse_number(r["t"]) for r in rows)


@pytest.mark.parametrize("rule, text, want", [
    ({"data": [["Q", "V"], ["a", 1], ["b", 2]]}, "| Q | V |\n|---|---|\n| a | 1 |\n| b | 2 |", 1.0), ({"data": [["Q", "V"], ["a", 1], ["b", 2]], "y_axis_shuffle": True}, "| Q | V |\n|---|---|\n| b | 2 |\n| a | 1 |", 1.0),
    ({"data": [["Q", "V"], ["a", 1], ["b", 2]], "x_axis_shuffle": True}, "| V | Q |\n|---|---|\n| 1 | a |\n| 2 | b |", 1.0), ({"data": [["Q", "V"], ["a", 1], ["b", 2]]}, "| Q | a | b |\n|---|---|---|\n| V | 1 | 2 |", 1.0), ({"data": [["Q", "V"], ["a", 1], ["b", 2]]}, "| Q | V |\n|---|---|\n| a | 1 |", 0.5),
])
def test_chart_arrays(rule, text, want):
    assert run(text, type="chart_data_array_data", **rule)[0] == pytest.approx(want)
    assert run("| Q | V |\n|---|---|\n| a | 1 |", type="chart_data_array_labels", data=[["V", "Q"]], x_axis_shuffle=True) == (1.0, True)
    assert run("| Q | V | W |\n|---|---|---|\n| a | 1 | 2 |", type="chart_data_array_labels", data=[["Q", "V"]])[0] == 0.5  # turned, it has two columns


def slow_tree_distance(a, b, change):
    def children(t):
        out, open_ = [], []
        for i, lo in enumerate(t.left):
            own = []
            while open_ and open_[-1] >= lo:
                own.append(open_.pop())
            out.append(tuple(own[::-1]))
            open_.append(i)
        return out

    ka, kb = children(a), children(b)

    @lru_cache(None)
    def far(x, y):
        if not x or not y:
            return sum(a.size[i] for i in x) + sum(b.size[i] for i in y)
        p, q = x[-1], y[-1]
        return min(far(x[:-1] + ka[p], y) + 1, far(x, y[:-1] + kb[q]) + 1, far(x[:-1], y[:-1]) + far(ka[p], kb[q]) + change[p, q])

    return far((len(a.left) - 1,), (len(b.left) - 1,))


def test_tree_distance_brute_force():
    rng = random.Random(2)
    cells = ["<td>a</td>", "<td>bb</td>", "<th>a</th>", "<td colspan=2>ab</td>", "<td></td>", "<td><b>a</b></td>"]

    def table():
        head = rng.random() < 0.5
        rows = ["<tr>" + "".join(rng.choices(cells, k=rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(1, 3))]
        return tables.html_tables("<table>" + ("<thead>" + rows[0] + "</thead><tbody>" + "".join(rows[1:]) + "</tbody>" if head else "".join(rows)) + "</table>")[0]

    for _ in range(80):
        a, b = trees.Tree(x := table()), trees.Tree(y := table())
        for v, c in trees.costs(a, b).items():
            assert trees.distance(a, b, c) == pytest.approx(slow_tree_distance(a, b, c))
        assert 0 <= min(trees.teds(x, y).values()) and trees.teds(x, x)["teds"] == 1
    # Marks inside cells count as nodes of the larger table.
    plain, marked = (tables.html_tables(f"<table><tr><td>{t}</td><td>x</td></tr></table>")[0] for t in ("a", "<b>b</b>"))
    assert trees.teds(plain, marked)["teds"] == pytest.approx(1 - 1 / 5)


def test_text_distances():
    rng = random.Random(3)
    xs, ys = (["".join(rng.choices("abc", k=rng.randint(0, n))) for _ in range(12)] for n in (9, 70))
    got = kernels.text_distances(xs, ys)
    assert all(got[i, j] == pytest.approx(kernels.edit_distance(x, y) / max(len(x), len(y), 1)) for i, x in enumerate(xs) for j, y in enumerate(ys))


def test_headers():
    one = lambda h: tables.html_tables(h)[0]
    gt = one("<table><tr><th colspan=2>Top</th></tr><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>")
    assert headers.scores(gt, gt)["composite"] == 1 and headers.scores(gt, gt)["perfect"] == 1 and headers.Head.of(gt).depth() == 2
    lost = one("<table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table>")
    s = headers.scores(gt, lost)
    assert s["composite"] == 0 and headers.generous(gt, lost) > 0.4
    less = headers.scores(gt, one("<table><thead><tr><td>A</td><td>B</td></tr></thead><tr><td>1</td><td>2</td></tr></table>"))
    assert less["cell_count"] == pytest.approx(2 / 3) and less["content_bag"] == pytest.approx(2 / 3) and less["hierarchy_depth"] == 0.5 and less["perfect"] == 0
    two = one("<table><tr><th>A</th><td>x</td><th>B</th></tr></table>")
    apart = one("<table><tr><th>A</th><td>x</td><td>x</td><th>B</th></tr></table>")
    s = headers.scores(two, apart)
    assert s["direction"] == 1 and s["proximity"] == pytest.approx(1 - (3 - 2) / 3 if False else 1 - 1 / 2) and len(headers.Head.of(two).blocks()) == 2
    assert headers.scores(lost, lost)["composite"] == 1


def test_document_scores():
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
    same = tables.document_scores(html, html)
    assert all(same[k] == 1 for k in ("grits_con", "table_record_match", "teds", "teds_struct_bool", "header_composite", "table_composite", "table_composite_harmonic", "structural_consistency"))
    assert tables.document_scores(html, html, trm_unsupported=True)["grits_trm_composite"] == 1 and tables.document_scores(html, "")["grits_trm_composite"] == 0
    assert tables.document_scores("no table", html)["teds"] is None


def test_layout_elements(spark):
    gt = [(1, 1, "Text", 0.0, 0.0, 10.0, 10.0, ["a", "b", "c"], False, False, False), (1, 2, "Title", 0.0, 10.0, 10.0, 20.0, ["d", "e"], False, False, False), (1, 3, "Page-header", 0.0, 30.0, 100.0, 40.0, ["x", "y", "z"], False, False, True), (1, 4, "Formula", 50.0, 0.0, 60.0, 10.0, ["q"], False, False, False), (2, 1, "Text", 0.0, 0.0, 10.0, 10.0, [], True, False, False)]
    pred = [(1, 1, "Text", 0, 0.0, 0.0, 10.0, 20.0, ["a", "b", "c", "d", "e"]), (1, 2, "Page-header", 1, 0.0, 30.0, 45.0, 40.0, ["x", "y"]), (1, 3, "Page-header", 2, 55.0, 30.0, 100.0, 40.0, ["z"]), (1, 4, "Formula", 3, 50.0, 0.0, 60.0, 10.0, ["w"])]
    g = spark.createDataFrame(gt, "page int, id long, cls string, x0 double, y0 double, x1 double, y1 double, tokens array<string>, explicit boolean, caption boolean, furniture boolean")
    p = spark.createDataFrame(pred, "page int, id long, cls string, rank long, x0 double, y0 double, x1 double, y1 double, tokens array<string>")
    rows = layout.elements(g, p, ["page"])
    got = {(r["page"], r["id"]): (r["localised"], r["classified"], r["attributed"], r["passed"]) for r in rows.collect()}
    # A merged prediction is not held against either element, a band is made of two predictions, a formula has no attribution.
    assert got == {(1, 1): (True, True, True, True), (1, 2): (True, False, True, False), (1, 3): (True, True, True, True), (1, 4): (True, True, None, True), (2, 1): (False, False, None, False)}
    r = layout.rates(rows, ["page"]).where("page = 1").collect()[0]
    assert r["layout_rule_pass_rate"] == pytest.approx((4 + 3 + 3) / 11) and r["layout_element_rule_pass_rate"] == 0.75
    s = {x["page"]: x for x in layout.page_scores(g, p, ["page"]).collect()}
    assert s[1]["lap"] == pytest.approx(8 / 9) and s[1]["lar"] == pytest.approx(8 / 9) and s[1]["grounding"] == 0.75 and s[2]["lap"] == 1


@pytest.mark.parametrize("e, kind, t, ocr, how", [
    (None, "string", "—", False, "null_empty"), (None, "string", "x", False, "none"), ("Ab  c", "string", "Ab c", False, "identity"), ("abc", "string", "ABC", False, "case_insensitive"), ("abc", "string", "abc.*", False, "trailing_punct_fold"), ("50uL", "string", "50µL", False, "unicode_compat_fold"),
    ("MARIA", "string", "MARIAMonthly", False, "footer_text_trim"), (1739.12, "number", "$1,739.12", False, "numeric"), (-123, "number", "(123)", False, "numeric"), (2671.43, "number", "2 671 43", False, "numeric"), (5, "number", "6", False, "none"), ("2024-03-05", "string", "March 5, 2024", False, "date"),
    ("2024-03-05", "date", "05/03/2024", False, "date"), ("2024-03-05", "date", "06/03/2024", False, "none"), (True, "boolean", "[x]", False, "boolean"), (False, "boolean", "~", False, "boolean"), (True, "boolean", "[ ]", False, "none"), ("a,b", "string", "a. b", True, "ocr_punctuation_fold"), ("a,b", "string", "a. b", False, "none"),
    ("160.18 FIT 74.08", "string", "160 18 FIT 74 08", False, "alnum_text_fold"), ("bór", "string", "þór", True, "icelandic_diacritic_fold"), ("1234567890ab", "string", "1234567890abc more", False, "annotation_truncated"), ("462 N Rodeo Dr", "string", "1462 N Rodeo Dr", False, "ocr_noise_prefix"),
])
def test_strict_comparison(e, kind, t, ocr, how):
    assert strict.compare(e, kind, t, ocr=ocr).how == how


def test_strict_similarity():
    assert strict.compare(2671.43, "number", "2,671.48").similarity > 0.9 and strict.partial("one two three four", "two") and not strict.partial("one two", "one two")


@pytest.mark.parametrize("t, iso", [("2024-1-5", "2024-01-05"), ("01/05/2024", "2024-01-05"), ("13/05/2024", "2024-05-13"), ("01-05-2024", "2024-01-05"), ("January 5, 2024", "2024-01-05"), ("Jan 5 2024", "2024-01-05"), ("Friday January 5, 2024", "2024-01-05"), ("5 January 2024", "2024-01-05"), ("20240105", None), ("x", None)])
def test_dates(spark, t, iso):
    assert extract.iso_date(t) == iso
    assert spark.createDataFrame([(t,)], "t string").select(extract.date_column(F.col("t"))).collect()[0][0] == iso


def test_quotes_and_scripts():
    assert T.normalize_py("＂a＂ ‵b‵ «c»，。") == "\"a\" 'b' «c»,." and T.normalize_py("が") == "が" and T.normalize_py("é") == "e"


def test_anchor_free_rules_and_ids(spark):
    d = spark.createDataFrame([(["a", None, "b"], ["b", ""], None)], "x array<string>, y array<string>, z array<string>")
    assert d.select(evaluate.layout_ids(F.col("x"), F.col("y"), F.col("z"))).collect()[0][0] == ["a", "b"]
    bad = spark.createDataFrame([("t", "r", "[1]")], "test_id string, rule_id string, rule string")
    with pytest.raises(Exception, match="without a type"):
        evaluate.coerced(bad).collect()


def test_evaluation_run_by_page_and_blank(spark):
    rows = [("a", "1", {"type": "present", "text": "hello", "page": 1}), ("a", "2", {"type": "present", "text": "hello", "page": 2}), ("a", "3", {"type": "absent", "text": "hello"}), ("b", "1", {"type": "absent", "text": "x"}), ("c", "1", {"type": "form_field", "field_type": "text", "label": "Name", "value": "Ada", "page": 2})]
    r = evaluate.coerced(spark.createDataFrame([(t, i, json.dumps(x)) for t, i, x in rows], "test_id string, rule_id string, rule string"))
    d = spark.createDataFrame([("a", "Hello there", None), ("c", "Name: Bob\nName: Ada", {1: "Name: Bob", 2: "Name: Ada"}), ("e", "", None)], "test_id string, text string, pages map<int,string>")
    got = {(x["test_id"], x["rule_id"]): x["score"] for x in evaluate.run_rules(r, d, part=1).collect()}
    assert got == {("a", "1"): 1.0, ("a", "2"): 1.0, ("a", "3"): 0.0, ("b", "1"): 0.0, ("c", "1"): 1.0}
    assert {x["rule_id"] for x in evaluate.run_rules(r, d, page=1).where("test_id = 'a'").collect()} == {"1", "3"}
    m = {(x["test_id"], x["metric"]): x["value"] for x in evaluate.document_metrics(evaluate.run_rules(r, d), d).collect()}
    assert m[("e", "rule_pass_rate")] == 1 and m[("a", "rule_pass_rate")] == pytest.approx(2 / 3) and m[("a", "rule_present_pass_rate")] == 1


def test_passages_in(spark):
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "dd"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(40)] + [(99, None)]
    passages = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(60)] + [(98, "a bb cc dd a"), (97, None)]
    d, p = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(passages, "p long, q string")
    want = {(i, j) for i, t in docs for j, q in passages if t is not None and q is not None and q in t}
    for few in (100_000, 0):
        got = [tuple(r) for r in text_rules.passages_in(d, p, "d", "t", "p", "q", few=few).select("d", "p").collect()]
        assert set(got) == want and len(got) == len(want)


def test_sidecars(spark, tmp_path):
    put = lambda name, x: (tmp_path / "grp").mkdir(exist_ok=True) or (tmp_path / "grp" / name).write_text(x if isinstance(x, str) else json.dumps(x))
    put("a.test.json", {"tags": ["t"], "test_rules": [{"type": "present", "text": "x", "tags": ["u", "t"]}, {"type": "chart_data_array_data", "data": []}], "trm_unsupported": True})
    put("a.md", "# beside")
    put("b.test.json", {"data_schema": {"x": 1}, "expected_output": {"x": 2}, "expected_markdown": "inside"})
    put("c.test.json", {"test_rules": [{"type": "layout", "id": "e"}], "page_index": 3})
    got = {r["test_id"]: r for r in sidecars.load(spark, str(tmp_path)).collect()}
    a = got["grp/a"]
    assert {k: r["product_type"] for k, r in got.items()} == {"grp/a": "parse", "grp/b": "extract", "grp/c": "layout_detection"}
    assert a["tags"] == ["t", "u"] and a["rules"][0]["tags"] == ["t", "u"] and a["rules"][1]["tags"] == ["t"] and a["rules"][1]["csv_path"].endswith("grp/a.csv") and a["expected_markdown"] == "# beside" and a["trm_unsupported"] and a["max_top_title_rows"] == 1
    assert got["grp/b"]["expected_markdown"] == "inside" and json.loads(got["grp/b"]["expected_output"]) == {"x": 2} and got["grp/c"]["page_index"] == 3
    put("d.test.json", "[]")
    with pytest.raises(Exception, match="no JSON object"):
        sidecars.cases(spark, str(tmp_path)).collect()


def test_unknown_labels(spark):
    maps = spark.createDataFrame([("p", None, None, 0, "x", "Text")], "provider string, model string, matcher string, priority int, raw_label string, canonical string")
    rows = spark.createDataFrame([("p", "m", "x"), ("p", "m", "y")], "provider string, model string, raw_label string")
    assert [r["canonical"] for r in sets.mapped_labels(rows, maps).collect()] == ["Text"]
    with pytest.raises(Exception, match="unknown label"):
        sets.mapped_labels(rows, maps, strict=True).collect()


def test_field_rules(spark):
    r = spark.createDataFrame([("extract_field", "a", None), ("extract_field", "b", False), ("array_length", "c", True), ("extract_field", None, True)], "type string, field_path string, verified boolean")
    assert [x["field_path"] for x in sets.field_rules(r).collect()] == ["a"]


def test_union_area_of_random_boxes():
    rng = np.random.default_rng(1)
    b = [tuple(map(float, (x, y, x + w, y + h))) for x, y, w, h in rng.integers(1, 9, (12, 4))]
    grid = np.zeros((20, 20), bool)
    for x0, y0, x1, y1 in b:
        grid[int(y0) : int(y1), int(x0) : int(x1)] = True
    assert boxes.union_area(b) == grid.sum()


def test_registry(spark, tmp_path):
    from docmeter.sources import corpus, registry

    reg = registry.Registry()
    reg.pipeline("a", "p", "m1")
    with pytest.raises(ValueError, match="already"):
        reg.pipeline("a", "p", "m1")
    with pytest.raises(LookupError):
        reg.resolve("a")
    low, high, own = (lambda raw: raw), (lambda raw: raw), (lambda raw: raw)
    reg.adapter(pattern="^p/", priority=1)(low)
    reg.adapter(pattern="m1$", priority=5)(high)
    assert reg.resolve("a") is high
    reg.adapter("p/m1")(own)
    assert reg.resolve("a") is own and [tuple(r) for r in reg.table(spark).collect()] == [("a", "p", "m1", "parse")]
    corpus.rule_csv(spark.createDataFrame([("a", "t", True, 0.5)], "pipeline string, test_id string, passed boolean, score double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0]["score"] == "0.5"


def test_field_grounding(spark):
    from docmeter.operators import grounding as G

    box = lambda x0, y0, x1, y1, page=1: (page, x0, y0, x1, y1)
    assert G.area_scores([box(0.0, 0.0, 2.0, 2.0)], [box(1.0, 0.0, 3.0, 2.0)]) == (pytest.approx(1 / 3), 0.5, 0.5)
    assert G.value_score("Jonathan", "string", "Jonathon")[0] >= G.NEAR and G.value_score("5", "number", "6") == (0.0, "none") and G.value_score(None, "string", "-")[1] == "null_empty"
    words = [("word", i, t, box(10.0 * i, 0.0, 10.0 * i + 9, 10.0)) for i, t in enumerate(["Ada", "King", "Rome"])]
    lines = [("line", 0, "Ada King Rome", box(0.0, 0.0, 29.0, 10.0))]
    got = G.best_support("Ada King", "string", [box(0.0, 0.0, 19.0, 10.0)], words + lines)
    assert got[3:] == (1.0, "identity", "word", "Ada King") and got[0] > 0.9
    rules_ = [("t", "a", "Ada King", "string", [box(0.0, 0.0, 19.0, 10.0)]), ("t", "b", "Rome", "string", [box(0.0, 50.0, 19.0, 60.0)]), ("u", "c", None, "string", [box(0.0, 0.0, 1.0, 1.0)])]
    r = spark.createDataFrame(rules_, "test_id string, field_path string, expected string, kind string, boxes array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>")
    u = spark.createDataFrame([("t", g, i, t, *b) for g, i, t, b in words + lines], "test_id string, granularity string, rank int, text string, page int, x0 double, y0 double, x1 double, y1 double")
    s = {x["field_path"]: (x["loc"], x["attr"], x["granularity"]) for x in G.field_rules(r, u).collect()}
    assert s == {"a": (True, True, "word"), "b": (False, False, "none"), "c": (False, False, "none")}


def test_records_are_aligned_greedily(spark):
    from docmeter.operators import grounding as G

    e = spark.createDataFrame([("d", 1, "a", "b", "c"), ("d", 2, "a", "b", "x"), ("d", 3, "q", "r", "s")], "k string, rank long, f string, g string, h string")
    a = spark.createDataFrame([("d", 10, "a", "b", "x"), ("d", 11, "a", "b", "c"), ("d", 12, "q", "zz", "zz")], "k string, rank long, f string, g string, h string")
    pairs = G.aligned_records(e, a, "k", ["f", "g", "h"])
    assert {(r["rank"], r["other"], round(r["agree"], 3)) for r in pairs.collect()} == {(1, 11, 1.0), (2, 10, 1.0)}
    m = G.record_metrics(e, a, pairs, "k").collect()[0]
    assert m["record_accuracy"] == pytest.approx(2 / 3) and m["record_grounded_recall"] == pytest.approx(2 / 3)


def test_greedy_at_all_thresholds(spark):
    rng = random.Random(4)
    rows = [(p, i, j, "A", "A", rng.choice([0.3, 0.5, 0.7, 0.9]), rng.random()) for p in range(6) for i in range(5) for j in range(5) if rng.random() < 0.6]
    pairs = spark.createDataFrame(rows, "page int, gt_id int, pred_id int, g_cls string, p_cls string, score double, iou double")
    got = {(r["threshold"], r["page"], r["gt_id"], r["pred_id"]) for r in boxes.greedy_all(pairs, ["page"], (0.5, 0.75)).collect()}
    want = set()
    for t in (0.5, 0.75):
        for p in range(6):
            free_g, free_p = set(range(5)), set(range(5))
            for r in sorted((r for r in rows if r[0] == p and r[6] >= t), key=lambda r: (-r[5], r[2], -r[6], r[1])):
                if r[1] in free_g and r[2] in free_p:
                    free_g.discard(r[1])
                    free_p.discard(r[2])
                    want.add((t, p, r[1], r[2]))
    assert got == want


def test_words_of_many_pages_make_few_patterns():
    """Patterns made of a page's own words cost more than all else of a page: none is made where no mark of theirs stands."""
    rules.pattern.cache_clear()
    for i in range(50):
        for text in (f"# Client {i} of ours\n", f"Client {i} of ours, **not** a title", f"market {i} closed"):
            page = rules.Page(text)
            assert rules.score({"type": "is_title", "text": f"Client {i} of ours"}, page)[1] == text.startswith("#")
            s = f"market {i} closed"
            assert rules.score({"type": "missing_sentence", "bag_of_sentence": {s: 1}}, page)[1] == (s in text)
    assert rules.pattern.cache_info().misses == 0
    for part, text in [("ab", "ab abc ab_ -ab- abab"), ("a a", "a a a a a"), ("a.b", "a.b axb a.b1"), ("é", "é éé é"), ("-a", "b-a -a"), ("", "a b")]:
        assert rules.alone(part, text) == len(re.findall(rf"(?<!\w){re.escape(part)}(?!\w)", text)), (part, text)


def test_nested_and_hidden_tables_are_still_apart():
    for text in ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", "<!-- <table><tr><td>a</td></tr></table> --><table><tr><td>b</td></tr></table>", "<table></table><table><tr><td>x</td></tr>", "<table><tr><td>x</td></tr></table><table><tr><th>y</th></tr></table>"):
        want = [[c.text for c in t.cells] for t in tables.html_tables(text, nested=True)]
        assert [[c.text for c in g.own] for g in rules.Page(text).grids] == want
