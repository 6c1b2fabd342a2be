"""Queries over tables generated from nations, regions and parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators import tables as T
from .catalog import query, read

CELLS_SQL = """SELECT n_regionkey::BIGINT AS region, 0 AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row, 0 AS col, n_name AS text, false AS header FROM nation
    UNION ALL SELECT n_regionkey, 0, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 1, (n_nationkey * 37 % 100)::VARCHAR, false FROM nation
    UNION ALL SELECT r_regionkey, 0, 0, 0, 'Nation', true FROM region UNION ALL SELECT r_regionkey, 0, 0, 1, 'Value', true FROM region"""


def region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, html: a table of its nations, and pred: the same with a row missing, a header renamed or columns swapped."""
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("region"), "n_nationkey", "n_name", (F.col("n_nationkey") * 37 % 100).cast("string").alias("v"))

    def table(first: str, second: str, head: tuple[str, str], keep: F.Column | None = None) -> F.Column:
        row = F.concat(F.lit("<tr><td>"), F.col(first), F.lit("</td><td>"), F.col(second), F.lit("</td></tr>"))
        own = F.array_sort(F.collect_list(F.when(F.lit(True) if keep is None else keep, F.struct("n_nationkey", row.alias("r")))))
        return F.concat(F.lit(f"Before.\n<table><tr><th>{head[0]}</th><th>{head[1]}</th></tr>"), F.array_join(F.transform(own, lambda x: x["r"]), ""), F.lit("</table>"))

    g = n.groupBy("region").agg(table("n_name", "v", ("Nation", "Value")).alias("html"), table("n_name", "v", ("Nation", "Value"), F.col("n_nationkey") % 5 != 0).alias("p0"), table("n_name", "v", ("Nation", "Worth")).alias("p1"), table("v", "n_name", ("Value", "Nation")).alias("p2"))
    return g.select("region", "html", F.element_at(F.array("p0", "p1", "p2"), (F.col("region") % 3 + 1).cast("int")).alias("pred"))


def region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cells(region_tables(spark, sf_dir), "region", "html")


@query(CELLS_SQL)
def table_cells_from_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_cells(spark, sf_dir).select("region", "table_id", "row", "col", "text", "header")


@query(f"WITH c AS ({CELLS_SQL}) SELECT region, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, true AS even FROM c GROUP BY 1")
def table_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dimensions(region_cells(spark, sf_dir), ["region", "table_id"]).drop("table_id")


@query(f"WITH c AS ({CELLS_SQL}), w AS (SELECT *, lag(text) OVER (PARTITION BY region, row ORDER BY col) AS left_text, lead(text) OVER (PARTITION BY region, row ORDER BY col) AS right_text, lag(text) OVER (PARTITION BY region, col ORDER BY row) AS up, lead(text) OVER (PARTITION BY region, col ORDER BY row) AS down FROM c) SELECT region, row, col, text, left_text, right_text, up, down FROM w")
def table_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.neighbours(region_cells(spark, sf_dir), ["region", "table_id"]).select("region", "row", "col", "text", F.col("left").alias("left_text"), F.col("right").alias("right_text"), "up", "down")


@query("SELECT r_regionkey::BIGINT AS region, bool_or(n_name = 'NATION_2') AS passed FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def table_adjacent_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.lit(str(2 * 37 % 100))
    return T.adjacent(region_cells(spark, sf_dir), ["region", "table_id"], F.lit("NATION_2"), "right", value).drop("table_id")


@query(f"WITH c AS ({CELLS_SQL}), w AS (SELECT *, lag(text) OVER (PARTITION BY region, col ORDER BY row) AS up FROM c) SELECT region, bool_or(text = 'Nation' AND up IS NULL) AS passed FROM w GROUP BY 1")
def table_no_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.at_border(region_cells(spark, sf_dir), ["region", "table_id"], F.lit("Nation"), "up").drop("table_id")


@query(f"WITH c AS ({CELLS_SQL}) SELECT region, count(CASE WHEN text = 'NATION_2' THEN 1 END) > 0 AS passed FROM c GROUP BY 1")
def table_header_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.header_chain(region_cells(spark, sf_dir), ["region", "table_id"], F.lit("NATION_2"), ["Nation"]).drop("table_id")


@query(f"WITH c AS ({CELLS_SQL}), p AS (SELECT DISTINCT a.region FROM c a JOIN c b ON a.region = b.region AND a.row = b.row AND a.text = 'NATION_2' AND b.text = '74') SELECT r.region, p.region IS NOT NULL AS passed FROM (SELECT DISTINCT region FROM c) r LEFT JOIN p ON r.region = p.region")
def table_same_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shares(region_cells(spark, sf_dir), ["region", "table_id"], F.lit("NATION_2"), F.lit("74")).drop("table_id")


@query(f"WITH c AS ({CELLS_SQL}) SELECT region, bool_or(text = 'Nation') AS passed FROM c GROUP BY 1")
def table_colspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spans(region_cells(spark, sf_dir), ["region", "table_id"], F.lit("Nation"), "colspan", 1).drop("table_id")


@query("SELECT n_regionkey::BIGINT AS region, 0 AS table_id, false AS ambiguous FROM nation WHERE n_name IN ('NATION_2', 'NATION_7') GROUP BY 1")
def table_anchor_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.anchored(region_cells(spark, sf_dir), "region", ["NATION_2", "NATION_7"])


@query()
def table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.document_metrics(region_tables(spark, sf_dir), "region", "html", "pred")


VALUE_SQL = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '$' || p_size::VARCHAR || ',000' WHEN 1 THEN '(' || p_size::VARCHAR || ')' WHEN 2 THEN p_size::VARCHAR || '%' WHEN 3 THEN p_size::VARCHAR || ' million' ELSE 'none' END AS t, CASE p_partkey % 5 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN NULL WHEN 2 THEN p_size WHEN 3 THEN p_size * 1e6 END::DOUBLE AS number FROM part"


def part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    t = F.when(k == 0, F.concat(F.lit("$"), s, F.lit(",000"))).when(k == 1, F.concat(F.lit("("), s, F.lit(")"))).when(k == 2, F.concat(s, F.lit("%"))).when(k == 3, F.concat(s, F.lit(" million"))).otherwise("none")
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", t.alias("t"))


@query(f"SELECT p_partkey, t, number FROM ({VALUE_SQL})")
def number_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_values(spark, sf_dir).select("p_partkey", "t", C.to_number(F.col("t")).alias("number"))


@query("SELECT p_partkey, round(CASE WHEN p_size = 0 THEN (p_partkey % 60 = 0)::INT ELSE greatest(0, 1 - abs(p_size - p_partkey % 60) / p_size) END::DOUBLE, 9) AS similarity, abs(p_size - p_partkey % 60) <= 0.01 * p_size AS matched FROM part")
def numeric_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(C.similarity(a, b), 9).alias("similarity"), C.number_match(a, b).alias("matched"))


@query("SELECT r_regionkey::BIGINT AS region, r_regionkey = 2 AS passed FROM region")
def chart_data_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of one nation, which stands in its region's table only."""

    @F.pandas_udf("boolean")
    def point(h: pd.Series) -> pd.Series:
        return h.map(lambda x: C.data_point(x, "74", ["NATION_2"]))

    return region_tables(spark, sf_dir).select("region", point("html").alias("passed"))


@query(f"WITH c AS ({CELLS_SQL}) SELECT region, bool_or(text = 'NATION_2') AS passed FROM c GROUP BY 1")
def table_top_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some header above the cell is the wanted one."""
    h = T.headers(region_cells(spark, sf_dir), ["region", "table_id"])
    return h.groupBy("region").agg(F.bool_or((F.col("text") == "NATION_2") & F.array_contains("top", "Nation")).alias("passed"))


@query(f"WITH c AS ({CELLS_SQL}), w AS (SELECT *, lead(text) OVER (PARTITION BY region, row ORDER BY col) AS nxt FROM c) SELECT region, bool_or(text = 'Value' AND nxt IS NULL) AS passed FROM w GROUP BY 1")
def table_no_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.at_border(region_cells(spark, sf_dir), ["region", "table_id"], F.lit("Value"), "right").drop("table_id")


@query(f"WITH c AS ({CELLS_SQL}), p AS (SELECT DISTINCT a.region FROM c a JOIN c b ON a.region = b.region AND a.col = b.col AND a.text = 'Nation' AND b.text = 'NATION_2') SELECT r.region, p.region IS NOT NULL AS passed FROM (SELECT DISTINCT region FROM c) r LEFT JOIN p ON r.region = p.region")
def table_same_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shares(region_cells(spark, sf_dir), ["region", "table_id"], F.lit("Nation"), F.lit("NATION_2"), "col").drop("table_id")


@query("SELECT r_regionkey::BIGINT AS region, r_regionkey % 2 = 1 AS passed FROM region")
def table_rowspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell that reaches over two rows in every second region's table."""
    k = F.col("r_regionkey")
    html = F.concat(F.lit("<table><tr><td rowspan="), (1 + k % 2).cast("string"), F.lit(">total</td><td>b</td></tr><tr><td>c</td></tr></table>"))
    d = read(spark, sf_dir, "region").select(k.cast("long").alias("region"), html.alias("html"))
    return T.spans(T.cells(d, "region", "html"), ["region", "table_id"], F.lit("total"), "rowspan", 2).drop("table_id")


@query("SELECT r_regionkey::BIGINT AS region, CASE r_regionkey WHEN 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM region")
def chart_data_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's values against a prediction with another header, with columns swapped, or with rows missing (all of region 0)."""
    from ..functions import tables as K

    @F.pandas_udf("double")
    def score(h: pd.Series, p: pd.Series, r: pd.Series) -> pd.Series:
        rule = lambda x, n: {"type": "chart_data_array_data", "data": K.tables(x)[0].grid().tolist(), "x_axis_shuffle": n % 3 == 2, "y_axis_shuffle": n % 3 == 0}
        return pd.Series([C.array_score(rule(x, n), K.tables(y))[0] for x, y, n in zip(h, p, r, strict=True)])

    return region_tables(spark, sf_dir).select("region", F.round(score("html", "pred", "region"), 6).alias("score"))
