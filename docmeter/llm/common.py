"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: what does not belong to a word `[^\x20\x09-\x0D]+`.
SPACE = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


_clear: dict[str, object] = {}
_owner: list[str] = []


def register(name: str, clear) -> None:
    """A cache that Python workers keep between tasks, and how to empty it."""
    _clear[name] = clear


def claim(name: str) -> None:
    """Called by a worker's task: workers are used again by other operators, whose caches go, back to the system, when the owner changes."""
    if _owner != [name]:
        for other, clear in _clear.items():
            if other != name:
                clear()
        _owner[:] = [name]
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Only where it is unset, as in tests on one machine, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="docmeter-")
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what was written under a scratch path, by the file system that the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(col: str, by: int) -> Column:
    """crc32(id as text) mod by; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(by)


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def schema_with(df: DataFrame, cols: list[str], extra: list[tuple[str, str]]) -> T.StructType:
    """Types of cols in df, then of extra (name, type). A later name replaces an equal earlier one."""
    new = {n for n, _ in extra}
    fields = [T.StructField(c, df.schema[c].dataType) for c in cols if c not in new]
    return T.StructType(fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in extra])
