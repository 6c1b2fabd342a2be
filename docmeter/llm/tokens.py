"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

A text falls apart into units that the byte-level tokenizer never merges across (bpe.UNITS), so its number of tokens
is the sum over its units. Tier 1 is a broadcast table of the lengths of frequent units, of at most `frequent` entries;
it is seeded from a sample of about `seed_rows` texts and changes the speed only, never a count. Tier 2 is a cache of
each Python worker: a pre-token missed by tier 1 is encoded by the library once and kept, at most `cached` of them.
Texts for which the units don't hold (Unicode white space beyond ASCII, the end-of-text string) are encoded whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BYTE_PARTS, ODD_SPACE, UNIT_CHARS, UNITS, Units, load
from .common import claim, register

END = "<|endoftext|>"

_tables: dict[tuple, Units] = {}
register("tokens", _tables.clear)


def lengths(tokenizer, frequent: dict[str, int], most: int) -> Units:
    return Units(tokenizer, BYTE_PARTS, len, 0, frequent, most)


def tokens_of(text: str, table: Units) -> int:
    if END in text or not text.isascii() and ODD_SPACE.search(text):
        return table.whole(text)
    return sum(map(table.__getitem__, UNITS.findall(text)))


def pack(table: dict[str, int]) -> bytes:
    """The broadcast table: how many, the token numbers and the sizes as two-byte numbers, the units as UTF-8."""
    units = [u.encode() for u in table]
    sizes = np.array([len(u) for u in units], "<u2").tobytes()
    return len(units).to_bytes(4, "little") + np.array(list(table.values()), "<u2").tobytes() + sizes + b"".join(units)


def unpack(blob: bytes) -> dict[str, int]:
    n = int.from_bytes(blob[:4], "little")
    tokens, sizes = np.frombuffer(blob, "<u2", n, 4), np.frombuffer(blob, "<u2", n, 4 + 2 * n)
    ends = np.cumsum(sizes, dtype=np.int64) + 4 + 4 * n
    return {blob[e - s : e].decode(): k for e, s, k in zip(ends.tolist(), sizes.tolist(), tokens.tolist(), strict=True)}


def frequent_units(docs: DataFrame, text: str, seed_rows: int, frequent: int) -> list[str]:
    """The most frequent units of about seed_rows texts. Each task sends the driver one bounded summary."""
    share = min(1.0, seed_rows / max(1, docs.count()))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(u for u in UNITS.findall(t or "") if len(u) <= UNIT_CHARS)
                if len(seen) > 8 * frequent:
                    seen = Counter(dict(seen.most_common(frequent)))
        if top := seen.most_common(frequent):
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top]), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])

    rows = docs.select(F.col(text).alias("text"))
    total: Counter = Counter()
    for batch in rows.sample(share, seed=11).mapInArrow(summary, "unit string, n long").toArrow().to_batches():
        total.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    return [u for u, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:frequent]]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, frequent: int = 32768, seed_rows: int = 2048, cached: int = 500_000) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    spark, table = docs.sparkSession, lengths(load(vocabulary), {}, frequent)
    shared = spark.sparkContext.broadcast(pack({u: table[u] for u in frequent_units(docs, text, seed_rows, frequent)}))
    key = (vocabulary, spark.sparkContext.applicationId, shared._jbroadcast.id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        if key not in _tables:
            _tables.clear()
            _tables[key] = lengths(load(vocabulary), unpack(shared.value), cached)
        units = _tables[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [tokens_of(t, units) for t in texts]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
