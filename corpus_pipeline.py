"""Corpus pipeline: language, toxicity, near-duplicates, mix, packing. Each stage reads what its predecessor wrote.

Filtering stages take away the rejected ids, which are few: they are broadcast up to ID_LIMIT rows, and joined by shuffle beyond. What a
stage wrote is deleted when the next but one has read what came after it.

Defined cases: a null or empty text has no language and goes in the first stage; rows without an id are kept by near-duplicates, each by
itself, and mixed by a key of their own; of several rows with one id, one stays after near-duplicates, that of the smallest text by hash; null languages
and sources are groups of their own; further columns, whatever their names, are left out by the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm import dedup, langid, mixing, packing, toxicity
from docmeter.llm.common import crc_mod, discard, scratch, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ID_LIMIT = 500_000
#: A text this far from every language profile is in none of the known languages.
LEAST_SCORE = 0.2


def by_size(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most ID_LIMIT rows."""
    return F.broadcast(ids) if ids.count() <= ID_LIMIT else ids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that are near no language."""
    profiles = langid.fit(docs, learn=crc_mod("doc_id", 5) != 0)
    out = langid.predict(docs.select(COLUMNS), profiles)
    return out.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are predicted toxic."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=crc_mod("doc_id", 4) != 2)
    return toxicity.score(docs.select(COLUMNS), machine).where("predicted = 0").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of rows with one id, one."""
    verdict = stored(dedup.near_duplicates(docs).select("doc_id", "kept"))
    out = docs.select(COLUMNS).join(by_size(stored(verdict.where("not kept").select("doc_id").distinct())), "doc_id", "left_anti")
    if not verdict.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        first = F.min_by(F.struct(*COLUMNS), F.struct(F.xxhash64("text"), "text", "lang", "source", "n_chars"))
        out = out.where("doc_id is null").unionByName(out.where("doc_id is not null").groupBy("doc_id").agg(first.alias("r")).select("r.*"))
    return out.select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole copies: 0 to 3. Documents without an id are known by a row key."""
    docs = docs.select(COLUMNS)
    # The key is given once and stored, with the texts of these rows only.
    nameless = stored(docs.where("doc_id is null").withColumn("row", F.monotonically_increasing_id()))
    keyed = docs.where("doc_id is not null").withColumn("row", F.lit(None).cast("long")).unionByName(nameless)
    took = mixing.taken(keyed.withColumn("name", F.struct("doc_id", "row")), id_col="name").where("size > 0")
    took = took.groupBy(F.col("name.doc_id").alias("doc_id"), F.col("name.row").alias("row")).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies"))
    took = stored(took.where("copies > 0"))
    rows = docs.join(by_size(took.where("doc_id is not null").select("doc_id", "copies")), "doc_id").select(*COLUMNS, "copies")
    rows = rows.unionByName(nameless.join(by_size(took.where("doc_id is null").select("row", "copies")), "row").select(*COLUMNS, "copies"))
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mix", mixed), ("packing", packed)]
#: No stage is expressible in SQL: each is held against a plain version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        written.append(path)
        if len(written) > 1:
            discard(spark, written.pop(0))
    return STAGES[-1][1](spark, docs, sf_dir)
