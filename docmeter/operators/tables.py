"""Table operators: cells of documents, rule predicates over cells, and table metrics per document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers, trees
from ..functions import tables as T
from ..functions.kernels import indel_ratio

CELLS = "table_id int, row int, col int, text string, header boolean, rowspan int, colspan int"
METRICS = (
    "tables_expected", "tables_actual", "tables_paired", "structural_consistency", "grits_con", "table_record_match", "trm_perfect", *trees.VARIANTS,
    *(f"header_{k}" for k in (*headers.SUBMETRICS, "perfect", "composite", "generous")), "grits_trm_composite", "table_composite", "table_composite_harmonic",
)


def cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and the cells of all tables of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, c.row, c.col, T.cell_text(c.text), c.header, c.rowspan, c.colspan) for i, x in enumerate(b.column(1).to_pylist()) for t, table in enumerate(T.tables(x)) for c in table.cells]
            if rows:
                cols = list(zip(*rows, strict=True))
                types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=[key, "table_id", "row", "col", "text", "header", "rowspan", "colspan"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {CELLS}")


def document_metrics(docs: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """key and METRICS. A document's tables are aligned within one row, so nothing is shuffled; a failure leaves nulls and an error."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for e, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    own = T.document_scores(e or "", a or "")
                    out.append((*(own[m] for m in METRICS), None))
                except Exception as x:  # one document must not end the job
                    out.append((*[None] * len(METRICS), f"Evaluation error: {type(x).__name__}: {x}"[:300]))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names=[key, *METRICS, "error"])

    return docs.select(key, expected, actual).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{m} double" for m in METRICS) + ", error string")


def neighbours(c: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the texts up, down, left and right of them; null at the border."""
    across, down = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")
    return c.withColumns({"left": F.lag("text").over(across), "right": F.lead("text").over(across), "up": F.lag("text").over(down), "down": F.lead("text").over(down)})


def adjacent(c: DataFrame, keys: list[str], cell: Column, side: str, other: Column) -> DataFrame:
    """keys, passed: some cell with the text has the other text at a side."""
    return neighbours(c, keys).groupBy(*keys).agg(F.coalesce(F.bool_or((F.col("text") == cell) & F.coalesce(F.col(side) == other, F.lit(False))), F.lit(False)).alias("passed"))


def at_border(c: DataFrame, keys: list[str], cell: Column, side: str) -> DataFrame:
    """keys, passed: some cell with the text has nothing at a side."""
    return neighbours(c, keys).groupBy(*keys).agg(F.bool_or((F.col("text") == cell) & F.col(side).isNull()).alias("passed"))


def spans(c: DataFrame, keys: list[str], cell: Column, kind: str, wanted: int) -> DataFrame:
    """keys, passed: some cell with the text has the row or column span."""
    return c.groupBy(*keys).agg(F.bool_or((F.col("text") == cell) & (F.col(kind) == wanted)).alias("passed"))


def shares(c: DataFrame, keys: list[str], a: Column, b: Column, by: str = "row") -> DataFrame:
    """keys, passed: a cell with text a and another with text b lie in one row (or column), spans counted."""
    size = F.col(f"{by}span")
    x = c.where(F.col("text") == a).select(*keys, F.col(by).alias("a0"), (F.col(by) + size).alias("a1"))
    y = c.where(F.col("text") == b).select(*keys, F.col(by).alias("b0"), (F.col(by) + size).alias("b1"))
    hit = x.join(y, keys).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))).select(*keys).distinct().withColumn("passed", F.lit(True))
    return c.select(*keys).distinct().join(hit, keys, "left").fillna(False, ["passed"])


def headers(c: DataFrame, keys: list[str]) -> DataFrame:
    """Data cells with the header texts above them (top first) and left of them."""
    top = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(F.col("header"), F.col("text"))
    return c.withColumns({"top": F.collect_list(head).over(top), "side": F.collect_list(head).over(left)}).where(~F.col("header"))


def header_chain(c: DataFrame, keys: list[str], cell: Column, chain: list[str]) -> DataFrame:
    """keys, passed: some data cell with the text stands under exactly these headers."""
    return headers(c, keys).groupBy(*keys).agg(F.bool_or((F.col("text") == cell) & (F.col("top") == F.array(*map(F.lit, chain)))).alias("passed"))


def dimensions(c: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and columns of each table, and whether its rows are equally wide."""
    wide = c.groupBy(*keys, "row").agg(F.sum("colspan").alias("w"))
    return c.groupBy(*keys).agg(F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("col") + F.col("colspan")).alias("n_cols")).join(wide.groupBy(*keys).agg((F.count_distinct("w") == 1).alias("even")), keys)


def anchored(c: DataFrame, doc: str, anchors: list[str]) -> DataFrame:
    """doc, table_id, ambiguous: the table in which most anchors occur; ambiguous if several tie."""
    votes = c.where(F.col("text").isin(*anchors)).groupBy(doc, "table_id").agg(F.count_distinct("text").alias("votes"))
    best = votes.withColumn("most", F.max("votes").over(Window.partitionBy(doc))).where("votes = most")
    return best.groupBy(doc).agg(F.min("table_id").alias("table_id"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def fuzzy_cell(c: DataFrame, keys: list[str], text: str, least: float = 0.8) -> DataFrame:
    """Cells whose text is similar from `least` on."""

    @F.pandas_udf("double")
    def score(t):
        return t.map(lambda x: indel_ratio(x or "", text))

    return c.withColumn("score", score("text")).where(F.col("score") >= least)
