"""Language identification by rank-order profiles: out-of-place distance of a document's most frequent n-grams.

A profile is a language's `top` most frequent n-grams of 1 to 3 letters, in order; words are padded by a boundary,
case is dropped, and everything but letters separates words. A document's own `top` n-grams are ranked the same way,
and its distance to a language is the sum of rank differences, `top` for an n-gram that the profile lacks.

Profiles are fitted on a bounded sample: about `fit_rows` rows of each language (drawn with a fixed seed), from rows
with a text and a language that `learn` admits. Every text is scored as a whole; a very long one in slices cut
between words, whose counts are added.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text if nothing could be learned;
ties between languages go to the smaller name, ties between n-grams to the smaller code; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, register, schema_with

TOP, BITS, SLICE = 300, 18, 1 << 20
#: A gram is 2 bits for its length over up to 3 symbols; the document's number stands above, so DOCS are counted at a time.
GRAM = 3 * BITS + 2
DOCS = 1 << (63 - GRAM)
UND = "und"


def symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, else the number of its lower-case letter among all of them, from 1."""
    points = np.array([cp for cp in range(0x110000) if chr(cp).isalpha()], np.int32)
    low = np.array([ord(chr(cp).lower()[0]) for cp in points.tolist()], np.int32)
    letters = np.unique(low)
    assert len(letters) < 1 << BITS
    out = np.zeros(0x110000, np.int32)
    out[points] = np.searchsorted(letters, low) + 1
    return out


_tables: list[np.ndarray] = []
register("langid", _tables.clear)


def symbols() -> np.ndarray:
    if not _tables:
        _tables.append(symbol_table())
    return _tables[0]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, each after a separator, and of each the text's number."""
    cps = np.frombuffer("".join("\0" + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return cps, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def grams(marks: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """doc << GRAM | n << 3 * BITS | symbols, for the 1- to 3-grams of each text, unsorted."""
    keep = marks > 0
    keep[1:] |= marks[:-1] > 0
    keep[:1] = True
    s, d = np.append(marks[keep], 0), np.append(doc[keep], doc[-1] if len(doc) else 0)
    a, b, mid = s[:-1], s[1:], s > 0
    one = d[mid] << GRAM | 1 << 3 * BITS | s[mid]
    pair = (a > 0) | (b > 0)
    two = np.where(a > 0, d[:-1], d[1:])[pair] << GRAM | 2 << 3 * BITS | (a << BITS | b)[pair]
    m = mid[1:-1]
    three = d[1:-1][m] << GRAM | 3 << 3 * BITS | (s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:])[m]
    return np.concatenate([one, two, three])


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first) if len(first) else first
    return keys[first], n


def slices(text: str) -> list[str]:
    """A text in parts of about SLICE characters, cut after something that is no letter: a longer run of letters stays whole."""
    out, at = [], 0
    while len(text) - at > SLICE:
        end = at + SLICE
        cut = next((i for i in range(end, at, -1) if not text[i - 1].isalpha()), None)
        if cut is None:
            cut = next((i + 1 for i in range(end, len(text)) if not text[i].isalpha()), len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def counts_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counted() of the grams of texts; a long text by slices."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    group: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            cps, which = points([t for _, t in group])
            parts.append(counted(grams(table[cps].astype(np.int64), np.array([i for i, _ in group])[which])))
        group, size = [], 0

    for i, text in enumerate(texts):
        for part in slices(text):
            group.append((i, part))
            size += len(part)
            if size >= SLICE:
                flush()
    flush()
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


@dataclass
class Profiles:
    langs: list[str] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    top: int = TOP

    def score(self, texts: list[str], table: np.ndarray) -> tuple[list[str], list[float]]:
        """Names and scores of at most DOCS texts."""
        n_docs = len(texts)
        lang, score = np.full(n_docs, len(self.langs)), np.zeros(n_docs)
        if self.langs and n_docs:
            keys, n = counts_of(texts, table)
            doc = keys >> GRAM
            keys = keys[np.lexsort((keys, -n, doc))]  # keys were in order of doc, so doc stays as it is
            if len(keys):
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                rank = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(doc))))
                keep = rank < self.top
                code, doc, rank = keys[keep] & ((1 << GRAM) - 1), doc[keep], rank[keep]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                at = np.searchsorted(self.codes, code)
                at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == code), at, len(self.codes))
                far = np.stack([np.add.reduceat(np.where(r[at] < self.top, np.abs(r[at] - rank), self.top), first) for r in self.ranks])
                used = np.diff(np.append(first, len(doc)))
                best = far.argmin(axis=0)
                lang[doc[first]] = best
                score[doc[first]] = 1 - far[best, np.arange(len(used))] / (self.top * used)
        names = [*self.langs, UND]
        return [names[i] for i in lang], np.clip(score, 0, 1).tolist()


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", learn: Column | None = None, fit_rows: int = 1500, top: int = TOP, seed: int = 7) -> Profiles:
    """Profiles from a sample of about fit_rows rows of each language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    rows = rows.sampleBy("lang", {k: min(1.0, fit_rows / v) for k, v in n.items()}, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                texts, langs = (whole.column(i).slice(at, DOCS).to_pylist() for i in (0, 1))
                keys, times = counts_of(texts, symbols())
                name = np.array(langs, object)[keys >> GRAM]
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(keys & ((1 << GRAM) - 1)), pa.array(times, pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < top)
    profiles: dict[str, dict[int, int]] = {}
    for r in ranked.collect():  # top rows for each language
        profiles.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    langs = sorted(profiles)
    codes = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.full((len(langs), len(codes) + 1), top, np.int64)
    for i, name in enumerate(langs):
        ranks[i, np.searchsorted(codes, list(profiles[name]))] = list(profiles[name].values())
    return Profiles(langs, codes, ranks, top)


def predict(docs: DataFrame, profiles: Profiles, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if None) of every row, then lang_pred and score; these replace equal names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    out = schema_with(docs, keep, [("lang_pred", "string"), ("score", "double")])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                names, score = model.score([t or "" for t in batch.column(len(keep)).to_pylist()], symbols())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("__text")).mapInArrow(label, out)
