"""Every query with SQL gives the rows that DuckDB gives for it; the others run."""

from __future__ import annotations

import math
from decimal import Decimal

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = [q for q in QUERIES if not q.startswith("op") or q.startswith(("op_", "oper"))]
OWN = [q for q in OWN if q != "pipeline"]


def norm(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [q for q in OWN if q in ORACLES])
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = con.sql(ORACLES[name])
    assert sorted(sql.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted((tuple(map(norm, r)) for r in con.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()), key=repr)


@pytest.mark.parametrize("name", [q for q in OWN if q not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bold_words_of_odd_titles(spark, tmp_path):
    """The first word of a title may stand in any text that is in bold: "And", "re" and "a" stood in "and more"."""
    titles = ["And so", "Re the be", "a", "thus", "Andthus", " lead", "\nnext", "\u00a0a x", "\u3000", "\n", " \n and", "end\n", "a\u00a0b", "x\ny", "C\\+\\+", "[x]{2}", "**", "_and_", "", None]
    rows = [(3 * i + j, None if t is None else f"<title>{t}</title>") for i, t in enumerate(titles) for j in range(3)] + [(-1, "<title>And</title>"), (None, "<title>And</title>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = c.sql(f"SELECT page_id, bold, not_bold FROM ({ORACLES['rule_is_bold']})").fetchall()
    got = [(r["page_id"], r["bold"], r["not_bold"]) for r in QUERIES["rule_is_bold"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def on_pages(spark, path, name: str, pages: list[str | None]) -> tuple[list, list]:
    """A query's rows of page_id and passed over odd pages, each on an even and an odd id, and its SQL's."""
    rows = [(2 * i + j, p) for i, p in enumerate(pages) for j in range(2)] + [(None, pages[0])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
        want = c.sql(f"SELECT page_id, passed FROM ({ORACLES[name]})").fetchall()
    got = [(r["page_id"], r["passed"]) for r in QUERIES[name](spark, str(path)).collect()]
    return sorted(got, key=repr), sorted(want, key=repr)


def test_first_headings_of_odd_pages(spark, tmp_path):
    """Headings without a Latin letter are none of the SQL's; others have several lines, tags inside, or nothing before one that says something."""
    heads = ["<h1>One</h1>", "<h1>Ç Ç</h1>", "<h1>É</h1><p>x</p><h1>é</h1>", "<h1>two\nlines</h1>", "<h1>r\r\nn\u2028x</h1>", "<h1 id='a'><em>marked</em> <i>up</i></h1>", "<h1> </h1><h1>Next</h1>", "<h1>\u212a</h1>", "<h2>none</h2>", "<H1>Large</H1>", "<h1>open", "", None]
    got, want = on_pages(spark, tmp_path, "rule_is_title", heads)
    assert got == want


def test_fuzzy_titles_of_odd_pages(spark, tmp_path):
    """Titles too short for a change, of marks or spaces only, and with marks that others of the page make a pair with."""
    titles = ["A title", "a", "ab", "abc", "abcd", " ", "**", "....", "²", "__", "-- --", "a_b_c", "ab_cd", "#hash", "Ç", "x\ny", ""]
    got, want = on_pages(spark, tmp_path, "rule_present_fuzzy", [f"<html><meta name='x_y'><title>{t}</title><p>and _more_ * of it</p></html>" for t in titles] + ["<p>none</p>", "<title>", None])
    assert got == want


def test_words_are_shuffled_once(spark):
    """The words of a document are counted for both bags at once: one exchange by document and word, one by document."""
    df = QUERIES["word_bag_rules"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
