"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources, ordered by code point with null last, have the weights 5, 2, 1, repeating, and share all words; a
target stops at `most` times its source's size, and the excess is shared again by weight among the others.

Each source's documents are shuffled by a hash of their id and laid end to end, over and over: an endless stream of words, cut
into blocks of `block` words. Slot i of the schedule has the point frac((i + 1) * golden ratio); the interval of the cumulative
targets in which it falls is the slot's source, and the slot's rank among its source's slots is the block that it takes.
The points are spread so evenly that any stretch of the schedule holds each source in proportion. Slots whose rank is past the
source's target are passed over, and the last block is cut at the target; ranks that the points did not reach have slots after
all others, so each source gives its target to the word.

The places of documents in their streams are prefix sums in two levels: a source's documents fall into many hash ranges, whose
sizes are summed first, so a source with a third of all rows is spread over all tasks.

Defined cases: null text is empty; null source is a source; a source without words has the target 0 and its documents
take 0; rows that are alike in id, text and source are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        w = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / w >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def source_table(sized: DataFrame, most: float) -> list[dict]:
    """One row for each source: the driver holds as many rows as there are sources."""
    rows = [r.asDict() for r in sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()]
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    got = targets([r["source_size"] for r in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], most)
    return [r | {"sid": i, "target": t} for i, (r, t) in enumerate(zip(rows, got, strict=True))]


def streams(sized: DataFrame, sources: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """sized rows with sid and start: the words before the row in its source's shuffled order."""
    ranges = max(256, n_rows // 20_000)
    rows = sized.join(sources.select(F.col("source").alias("s_source"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    # The text takes part: rows without an id are spread, too.
    h = F.xxhash64("id", "text_hash", F.lit(seed))
    rows = rows.withColumn("h", h).withColumn("range", F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * ranges).cast("int"))
    sums = rows.groupBy("sid", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("sid").alias("b_sid"), F.col("range").alias("b_range"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "range").orderBy("h", "id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, (F.col("sid") == F.col("b_sid")) & (F.col("range") == F.col("b_range"))).withColumn("start", F.col("base") + F.col("inner")).drop("b_sid", "b_range", "base", "inner", "h", "range", "text_hash")


def schedule(spark, rows: list[dict], block: int) -> DataFrame:
    """slot, sid, rank: which block of which source each slot takes, in the order of the mix."""
    total = sum(r["target"] for r in rows)
    cumulative, at = [], 0.0
    for r in rows:
        at += r["target"]
        cumulative.append(at / total if total else 1.0)
    # Some slots more than words, for the deviation of the points: it grows with the logarithm of their number. A source
    # with few blocks may still lack its last ones: those follow at the end.
    n_slots = int(total / block * 1.01) + 64 * (len(rows) + 1) if total else 0
    shared = spark.sparkContext.broadcast(np.array(cumulative))  # 8 bytes for each source

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = (slot + 1) * GOLDEN % 1
            sid = np.minimum(np.searchsorted(shared.value, point, side="right"), len(shared.value) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sid.astype(np.int32))], ["slot", "sid"])

    slots = spark.range(n_slots).mapInArrow(dealt, "slot long, sid int")
    # Ranks in two levels, as a source may own most slots.
    span = 4096
    slots = slots.withColumn("span", F.floor(F.col("slot") / span))
    counts = slots.groupBy("sid", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("sid").alias("c_sid"), F.col("span").alias("c_span"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "span").orderBy("slot")
    slots = slots.withColumn("r", F.row_number().over(inside) - 1)
    given = {r["sid"]: r["n"] for r in slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).collect()}
    more, at = [], n_slots
    for r in rows:
        have, asked = given.get(r["sid"], 0), -(-int(r["target"] + 0.5) // block)
        if have < asked:
            more.append((at, r["sid"], have, asked))
            at += asked - have
    out = slots.join(counts, (F.col("sid") == F.col("c_sid")) & (F.col("span") == F.col("c_span"))).select("slot", "sid", (F.col("r") + F.col("base")).alias("rank"))
    if not more:
        return out
    late = spark.createDataFrame(more, "slot long, sid int, have long, asked long").withColumn("rank", F.explode(F.sequence("have", F.col("asked") - 1)))
    return out.unionByName(late.select((F.col("slot") + F.col("rank") - F.col("have")).alias("slot"), "sid", "rank"))


def block_words(rows: list[dict], largest: int = 4096, per_source: int = 500) -> int:
    """Words in a block: so few that the smallest target is per_source blocks, but not more slots than 4 for each document and 1000 for each source."""
    wanted = [r["target"] for r in rows if r["target"] > 0]
    if not wanted:
        return 1
    least = sum(wanted) / (4 * sum(r["n"] for r in rows) + 1000 * len(rows))
    return max(1, min(largest, int(max(min(wanted) / per_source, least))))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): documents has id, source, sid, size, source_size and target of every row and its key;
    pieces has slot, key, copy, first and words: in that slot the mix takes so many words of the copy, from its word `first`.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    sized = stored(sized)
    rows = source_table(sized, most)
    sources = spark.createDataFrame([(r["source"], r["sid"], r["source_size"], float(r["target"])) for r in rows], "source string, sid int, source_size long, target double")
    if len(rows) <= 10_000:
        sources = F.broadcast(sources)
    placed = streams(sized, sources, sum(r["n"] for r in rows), seed)
    placed = stored(placed.withColumn("key", F.monotonically_increasing_id()))
    block = block_words(rows)
    # The stream of a source is its documents again and again; a copy of a document covers these blocks.
    asked = F.round("target").cast("long")
    copies = placed.where("size > 0").select("key", "sid", "size", "start", "source_size", asked.alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    copies = copies.withColumn("begin", F.col("start") + F.col("copy") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), "asked")).where("begin < end")
    pieces = copies.select("key", "sid", "copy", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("rank"))
    lo, hi = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    pieces = pieces.select("key", "sid", "copy", "rank", (lo - F.col("begin")).alias("first"), (hi - lo).alias("words"))
    slots = schedule(spark, rows, block)
    return placed, slots.join(pieces, ["sid", "rank"]).select("slot", "key", "copy", "first", "words")


def taken(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, size, source_size, target and taken of every row."""
    placed, pieces = mix(docs, id_col=id_col, **options)
    sums = pieces.groupBy("key").agg(F.sum("words").alias("taken"))
    return placed.join(sums, "key", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
