"""Toxicity by a factorization machine over hashed terms.

A document's terms are its lower-cased words (`\\w+`) and the first 3 to 6 letters of longer ones, hashed into 2^20 places, and for each
place, whether at least 1, 2, 4 or 8 of its distinct words fall there. Score: sigmoid of bias + sum of term weights + sum over all pairs of terms of
the inner product of their factors, so that two terms that are harmless alone can be toxic together. Only terms that tell something take
part, a few hundred, so the pairs of a long document don't drown in noise, and the same terms count in fitting and in scoring.

Terms are chosen twice: by themselves, where their share of toxic documents differs from that of all by a Chernoff bound of `p_max`, and by
their pairs, as the largest entries of the leading eigenvectors of sum over documents of (label - mean) x x^T without its diagonal: that is
the slope of the pair terms where all factors are 0. The eigenvectors are also the factors' starting point, which small random numbers
are not: at 0 the pair terms have no gradient. Weights and factors are then fitted together by mini-batch AdaGrad with L1 shrinkage, the
model is the average over the last third of the steps.

It is fitted on a bounded sample: the `fit_rows` labelled rows that come first by a hash of their id, of those that `learn` admits, with at
most `fit_terms` terms of each (the first by a hash; longer documents only). Whole texts are scored.

Defined cases: a null or empty text gets the score of a document without terms; several labels of one document count as
the largest, a null label as none; without labels, scores are 0; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, register, schema_with

PLACES = 1 << 20
WORDS = re.compile(r"\w+")
CACHED = 150_000
STEPS = 560
#: A place is a term of its own for at least so many distinct words.
LEVELS = (1, 2, 4, 8)


def places(word: str) -> list[int]:
    """Hashed places of a lower-cased word."""
    terms = [word, *(f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & (PLACES - 1) for t in terms]


def terms_of(text: str | None) -> np.ndarray:
    """The terms of a text in order: place * 4 + level."""
    at = [p for w in set(WORDS.findall((text or "").lower())) for p in places(w)]
    place, n = np.unique(np.array(at, np.int64), return_counts=True)
    return np.sort(np.concatenate([place[n >= least] * 4 + i for i, least in enumerate(LEVELS)]))


class Rows:
    """Documents as rows of terms, one after another."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.n = len(docs)
        self.ends = np.cumsum([0] + [len(d) for d in docs])
        self.at = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.ends))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each document, the sum of x over its terms; x has a column for each factor."""
        return np.stack([np.bincount(self.row, c[self.at], self.n) for c in x.T], axis=1)

    def back(self, x: np.ndarray, n_terms: int) -> np.ndarray:
        """Of each term, the sum of x over its documents."""
        return np.stack([np.bincount(self.at, c[self.row], n_terms) for c in x.T], axis=1)

    def raw(self, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each document's sum of factors. The pair sum takes time linear in the terms."""
        s = self.sums(v)
        return bias + np.bincount(self.row, w[self.at], self.n) + 0.5 * (s**2 - self.sums(v**2)).sum(axis=1), s


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Machine:
    bias: float = -30.0
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """docs: of each document, the numbers of its terms in `terms`."""
        return sigmoid(Rows([np.asarray(d, np.int64) for d in docs]).raw(self.bias, self.weights, self.factors)[0])

    def known(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of those terms that the machine has."""
        i = np.searchsorted(self.terms, terms)
        return i[np.append(self.terms, -1)[i] == terms]


def by_themselves(positive: np.ndarray, seen: np.ndarray, share: float, p_max: float) -> np.ndarray:
    """Whether a term's share of toxic documents has a probability of at most p_max (a Chernoff bound) if it tells nothing."""
    f = np.clip(positive / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    return seen * (f * np.log(f / share) + (1 - f) * np.log((1 - f) / (1 - share))) >= -np.log(p_max)


def by_pairs(parts: list[Rows], r: list[np.ndarray], seen: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """Leading eigenvectors of sum r x x^T without its diagonal, terms divided by the root of their documents; by subspace iteration.

    parts: the documents, some thousand at a time, so that what is made on the way stays small; r: of each part.
    """
    m, d = len(seen), 1 / np.sqrt(seen)[:, None]
    diagonal = sum(np.bincount(x.at, w[x.row], m) for x, w in zip(parts, r, strict=True))[:, None] * d * d

    def times(q: np.ndarray) -> np.ndarray:
        z = d * q
        return d * sum(x.back(w[:, None] * x.sums(z), m) for x, w in zip(parts, r, strict=True)) - diagonal * q

    q = np.linalg.qr(np.random.default_rng(1).normal(size=(m, rank)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(q) + q)[0]  # the shift favours positive eigenvalues
    e, u = np.linalg.eigh(q.T @ times(q))
    return q @ u[:, e.argsort()[::-1]]


def train(docs: list[np.ndarray], labels: np.ndarray, *, rank: int = 4, p_max: float = 1e-3, by_pair: int = 16, start: float = 0.5, batch: int = 128, rate: float = 0.3, pair_rate: float = 0.1, l1: float = 1e-4, seed: int = 3) -> Machine:
    """A machine for documents given as sorted sets of terms. by_pair: terms that each eigenvector chooses."""
    y = np.asarray(labels, float)
    if not len(docs) or not y.any():
        return Machine()
    share = float(y.mean())
    if share == 1:
        return Machine(bias=5.0)
    n_docs = len(docs)
    seen, positive = np.zeros(4 * PLACES, np.int32), np.zeros(4 * PLACES, np.int32)
    for d, hit in zip(docs, y, strict=True):  # a document holds a term once
        seen[d] += 1
        if hit:
            positive[d] += 1
    number = np.full(4 * PLACES, -1, np.int32)

    def only(terms: np.ndarray, own: list[np.ndarray]) -> list[np.ndarray]:
        """The documents with these terms alone, as their numbers."""
        number[:] = -1
        number[terms] = np.arange(len(terms), dtype=np.int32)
        return [x[x >= 0] for x in (number[d] for d in own)]

    chosen = np.flatnonzero(by_themselves(positive, seen, share, p_max) & (seen >= 2))
    # A rare term has no pairs to speak of, and a pair with a term of nearly all documents is the other term.
    often = np.flatnonzero((seen >= max(3, n_docs // 400)) & (seen <= max(n_docs * 4 // 5, 3)))
    start_v = np.zeros((0, rank))
    if len(often) > rank:
        at = range(0, n_docs, 1000)
        u = by_pairs([Rows(only(often, docs[i : i + 1000])) for i in at], [y[i : i + 1000] - share for i in at], seen[often].astype(float), rank)
        start_v = u / np.sqrt(seen[often])[:, None]
        chosen = np.union1d(chosen, [often[j] for k in range(rank) for j in np.argsort(-np.abs(u[:, k]), kind="stable")[:by_pair]])
    v, i = np.zeros((len(chosen), rank)), np.searchsorted(often, chosen)
    known = np.append(often, -1)[i] == chosen
    v[known] = start_v[i[known]]
    v *= start / np.maximum(np.abs(v).max(axis=0, initial=0), 1e-12)
    own, m = only(chosen, docs), len(chosen)
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    # Small samples get smaller batches and more epochs, so that there are as many steps as for a large one.
    batch = min(batch, max(16, n_docs // 40))
    epochs = max(6, -(-STEPS * batch // n_docs))
    steps, done, kept, mean = epochs * -(-n_docs // batch), 0, 0, (0.0, np.zeros_like(w), np.zeros_like(v))
    gb, gw, gv = 1.0, np.full(m, 0.1), np.full((m, rank), 0.1)
    rng = np.random.default_rng(seed)
    shrink = lambda z, by: np.sign(z) * np.maximum(np.abs(z) - by, 0)
    for _ in range(epochs):
        order = rng.permutation(n_docs)
        for at in range(0, n_docs, batch):
            rows = order[at : at + batch]
            part = Rows([own[i] for i in rows])
            raw, s = part.raw(b, w, v)
            g = (sigmoid(raw) - y[rows]) * (32 / len(rows))
            db, dw = g.sum(), np.bincount(part.at, g[part.row], m)
            dv = part.back(g[:, None] * s, m) - dw[:, None] * v
            gb += db * db
            gw += dw * dw
            gv += dv * dv
            b -= rate * db / np.sqrt(gb)
            w = shrink(w - rate / np.sqrt(gw) * dw, rate / np.sqrt(gw) * l1 * 32)
            v = shrink(v - pair_rate / np.sqrt(gv) * dv, pair_rate / np.sqrt(gv) * l1 * 32)
            done += 1
            if 3 * done > 2 * steps:
                kept += 1
                mean = (mean[0] + (b - mean[0]) / kept, mean[1] + (w - mean[1]) / kept, mean[2] + (v - mean[2]) / kept)
    b, w, v = mean
    on = (w != 0) | (v != 0).any(axis=1)
    return Machine(b, chosen[on].astype(np.int64), w[on], v[on])


def labelled(labels: DataFrame, *, id_col: str = "doc_id", label: str = "toxic", learn: Column | None = None, fit_rows: int = 12_000) -> DataFrame:
    """id, y of the sampled labels."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, fit_rows: int = 12_000, fit_terms: int = 8192, **options) -> Machine:
    """A machine from the sampled labels' documents. The sample has a fixed bound in rows and terms, so it is broadcast and its terms are collected."""
    ids = labelled(labels, id_col=id_col, label=label, learn=learn, fit_rows=fit_rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                own = terms_of(t)
                if len(own) > fit_terms:
                    own = np.sort(own[np.argsort(own * 2654435761 % (1 << 32), kind="stable")[:fit_terms]])
                rows.append(own.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["id", "y", "terms"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").select("text", "y", F.col("id").cast("string").alias("id"))
    got = rows.mapInArrow(terms, "id string, y int, terms array<int>").toArrow()
    if not got.num_rows:
        return Machine()
    lists = got.column("terms").combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    own = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    # The order of rows, which the plan does not fix, is that of ids and terms: fits agree.
    ids, y = got.column("id").to_pylist(), got.column("y").to_numpy()
    order = sorted(range(len(own)), key=lambda i: (ids[i], len(own[i]), zlib.crc32(own[i])))
    del got, lists
    return train([own[i] for i in order], y[order], **options)


_worker: dict[int, tuple] = {}
register("toxicity", _worker.clear)


def score(docs: DataFrame, machine: Machine, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """The columns keep (all, if None) of every row, then score and predicted; these replace equal names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    out = schema_with(docs, keep, [("score", "double"), ("predicted", "int")])
    mark = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        if mark not in _worker:
            m = shared.value
            levels: dict[int, list[tuple[int, int]]] = {}  # of a place: (distinct words it takes, number of the term)
            for i, t in enumerate(m.terms.tolist()):
                levels.setdefault(t >> 2, []).append((LEVELS[t & 3], i))
            _worker.clear()
            _worker[mark] = (m, levels, {})
        m, levels, known = _worker[mark]

        def active(text: str | None) -> list[int]:
            n: dict[int, int] = {}
            for w in set(WORDS.findall((text or "").lower())):
                got = known.get(w)
                if got is None:
                    got = tuple(p for p in places(w) if p in levels)
                    if len(w) <= 64:
                        if len(known) >= CACHED:
                            known.clear()
                        known[w] = got
                for p in got:
                    n[p] = n.get(p, 0) + 1
            return sorted(i for p, c in n.items() for least, i in levels[p] if c >= least)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                scores = m.scores([active(t) for t in batch.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("__text")).mapInArrow(run, out)
