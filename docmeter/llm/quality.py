"""Quality rules with adaptive thresholds, from mergeable quantile sketches per language and source.

Each text is measured once. Of the documents that pass the fixed base rules, every group (language, source) gets a sketch of
each measured ratio: counts in buckets of a fixed relative width (a bucket's bounds are within `ACCURACY` of each other),
which merge by adding, in any order and with the same result. A sketch of fewer than `least` rows is filled up to that weight with the
merged sketch of its language, and that with the sketch of all documents in the same way, so each group has thresholds of its own.

A threshold is a fence read off the sketch, RATIOS says for each ratio where: at a high quantile, plus `reach` times its distance from the median;
where both tails are judged, also at the mirrored low quantile, less `reach` times its distance. A distance counts as `slack` at least, the
resolution of the ratio, so that groups without any spread do not reject the first row that differs. There are no fixed cutoffs. The
fences, one row for each group, are joined back, and a document outside any of its group's is not kept.

Defined cases: null and empty texts have no words and fail the base rules; null languages and sources are groups of
their own; repeated rows are measured each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, register, schema_with, stored

SYMBOLS = b"#*$%&|<>"
NO_POINT = bytes(range(0x80, 0xC0))
WINDOW = 8
ACCURACY = 0.002
#: Number of the bucket that begins at 1.
ONE = 20_000
#: Ratios that are judged: numerator, denominator, quantile of the fence, reach, slack, and whether the low tail is judged, too.
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 0.75, 5.0, 0.01, False),
    "repeats": ("n_repeat_words", "n_words", 0.95, 2.0, 0.10, False),
    "lines": ("n_dup_lines", "n_lines", 0.95, 3.0, 0.10, False),
    "letters": ("word_chars", "n_words", 0.75, 8.0, 0.02, True),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: The weight of a row in a sketch: parts of rows are borrowed in whole units.
UNIT = 10_000


class Hashes(dict):
    """Word -> 64-bit hash, kept for the words of a worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


_hashes = Hashes()
register("quality", _hashes.clear)
#: Odd multipliers, from a fixed seed.
MIX = (np.random.default_rng(5).integers(0, 1 << 63, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * MIX[j]
    return out


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words that occurs at least twice, first occurrences included."""
    if len(words) <= WINDOW:
        return 0
    w = window_hashes(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)), WINDOW)
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    start = np.flatnonzero(np.isin(w, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8."""
    b = text or b""
    words = b.split()
    if not words:
        return 0, 0, len(b) - len(b.translate(None, SYMBOLS)), 0, 0, 0
    chars = len(b.translate(None, NO_POINT + b" \t\n\x0b\x0c\r"))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def measured(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if None) and MEASURES of every row."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    out = schema_with(docs, keep, [(m, "long") for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            rows = [measure(t) for t in batch.column(len(keep)).to_pylist()]
            cols = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(cols[:, j]) for j in range(len(MEASURES)))], names=[*keep, *MEASURES])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("binary").alias("__text")).mapInArrow(run, out)


def ratio(name: str) -> Column:
    a, b = RATIOS[name][:2]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def bucket(x: Column) -> Column:
    """Number of x's bucket: 0 for 0, else ONE + floor(log x / log(1 + ACCURACY))."""
    return F.when(x <= 0, 0).otherwise(F.greatest(F.floor(F.log(x) / F.lit(float(np.log1p(ACCURACY)))) + ONE, F.lit(1))).cast("int")


def bucket_value(b: Column) -> Column:
    """The upper bound of a bucket."""
    return F.when(b == 0, 0.0).otherwise(F.exp((b - (ONE - 1)) * F.lit(float(np.log1p(ACCURACY)))))


def sketches(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group, ratio and bucket: the weight n of its rows. The sketches of two tables merge by adding n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), bucket(ratio(k)).alias("bucket")) for k in RATIOS)))
    return rows.select(*group, pairs.alias("p")).groupBy(*group, "p.ratio", "p.bucket").agg((F.count(F.lit(1)) * UNIT).alias("n"))


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    return sketch.groupBy(*group, "ratio", "bucket").agg(F.sum("n").alias("n"))


def filled(sketch: DataFrame, group: list[str], wider: DataFrame, shared: list[str], least: int) -> DataFrame:
    """sketch, where groups of fewer than `least` rows have the wider sketch of their `shared` columns added, up to that weight. Whole numbers only."""
    few = sketch.groupBy(*group, "ratio").agg((F.lit(least * UNIT) - F.sum("n")).alias("lack")).where("lack > 0")
    total = wider.groupBy(*shared, "ratio").agg(F.sum("n").alias("total"))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    part = wider.alias("w").join(total.alias("t"), same("w", "t", [*shared, "ratio"])).select("w.*", "t.total")
    more = few.alias("f").join(part.alias("p"), same("f", "p", [*shared, "ratio"]))
    more = more.select(*(F.col(f"f.{c}") for c in group), "f.ratio", "p.bucket", F.floor(F.col("p.n") * (F.col("lack") / F.col("total"))).alias("n"))
    return merged(sketch.select(*group, "ratio", "bucket", "n").unionByName(more), group)


def quantiles(sketch: DataFrame, group: list[str], at: dict[str, list[float]]) -> DataFrame:
    """group, ratio and q (array): bucket bounds at the shares asked for each ratio. A group has at most some thousand buckets, however many rows."""
    own = Window.partitionBy(*group, "ratio")
    cells = sketch.withColumn("sum", F.sum("n").over(own.orderBy("bucket"))).withColumn("total", F.sum("n").over(own))
    shares = F.element_at(F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in at.items() for x in kv)), F.col("ratio"))
    cells = cells.withColumn("at", shares)
    first = [F.min(F.when(F.col("sum") >= F.ceil(F.col("at")[i] * F.col("total")), F.col("bucket"))) for i in range(len(next(iter(at.values()))))]
    return cells.groupBy(*group, "ratio").agg(F.array(*map(bucket_value, first)).alias("q"))


def thresholds(sketch: DataFrame, *, least: int) -> DataFrame:
    """lang, source, and for each ratio k a fence t_k, and b_k where the low tail is judged, for all groups in the sketch."""
    by_all = merged(sketch, [])
    by_lang = filled(merged(sketch, ["lang"]), ["lang"], by_all, [], least)
    own = filled(sketch, ["lang", "source"], by_lang, ["lang"], least)
    q = quantiles(own, ["lang", "source"], {k: [1 - r[2], 0.5, r[2]] for k, r in RATIOS.items()})
    fences = []
    for k, (_, _, _, reach, slack, low) in RATIOS.items():
        a, mid, b = (F.col("q")[i] for i in range(3))
        fences.append(F.max(F.when(F.col("ratio") == k, b + reach * F.greatest(b - mid, F.lit(slack)))).alias(f"t_{k}"))
        if low:
            fences.append(F.max(F.when(F.col("ratio") == k, a - reach * F.greatest(mid - a, F.lit(slack)))).alias(f"b_{k}"))
    return q.groupBy("lang", "source").agg(*fences)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_words: int = 20, max_repeats: int = 30, least: int = 200) -> DataFrame:
    """id_col, MEASURES, base_failed, kept and the fences of every row's group (null where no row of the group passed the base rules).

    base_failed: fewer than min_words words, or more than max_repeats hundredths of the words in repeated windows.
    The measured rows, without texts, are stored once: the sketches and the filter both read them.
    """
    named = docs.select(F.col(id_col).alias(id_col), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("__t"))
    rows = measured(named, text="__t", keep=[id_col, "lang", "source"])
    rows = stored(rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeats * F.col("n_words"))))
    # A group's fences are a function of its sketch; the table has a row for each group and is joined by size.
    limits = stored(thresholds(stored(sketches(rows.where(~F.col("base_failed")), ["lang", "source"])), least=least))
    names = [c for c in limits.columns if c[:2] in ("t_", "b_")]
    limits = limits.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *names)
    both = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    # With more groups than that, AQE splits those that hold a large share of the rows.
    rows = rows.join(F.broadcast(limits) if limits.count() <= 100_000 else limits, both, "left")
    out = F.lit(False)
    for k, r in RATIOS.items():
        out = out | F.coalesce(ratio(k) > F.col(f"t_{k}"), F.lit(False))
        if r[5]:
            out = out | F.coalesce(ratio(k) < F.col(f"b_{k}"), F.lit(False))
    return rows.select(id_col, *MEASURES, "base_failed", (~F.col("base_failed") & ~out).alias("kept"), *names)
