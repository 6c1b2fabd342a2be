"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a fingerprint of that set and a signature: for each of
   128 hash functions the low byte of the set's minimum. Texts with equal fingerprints are one class; from here on each class is one node.
2. A tree of the forest orders all signatures after its own permutation of the 128 bytes. Each order is sorted by ranges, so
   a region of any size is spread over tasks, and read as a stream. A node meets its `window` neighbours on each side: those with which it
   shares the longest prefixes. How deep the window reaches differs by region: where rows are sparse it holds all that share `shallow`
   bytes, where they are dense, only those that share more. The depth is measured for each node and tree, and with it
   the probability that a partner of exactly the asked similarity was missed: the product over trees of 1 - percent^depth.
   A pair is a candidate if the set sizes allow the similarity and the signatures agree in at least `agree` bytes (4.7 standard deviations
   below what it asks for).
3. The forest grows in two steps. A few seed trees with a window of 1 join large groups of copies; in all other trees only pairs of
   different components count, so a group that is joined already gives no pairs. Candidates are confirmed on the full sets.
4. Nodes whose probability of a missed partner is above `miss` are open: their regions are too dense for the windows. Open nodes meet each
   other exactly. Those that candidates hold together (a cluster) are compared within the cluster, block by block, by matrix
   products of their sets; those of different clusters by a prefix filter: two sets as similar as asked share one of the first
   n - ceil(p n) + 1 shingles in any one order of all shingles, here the rarest first, so that a passage that thousands share is no key.
   A pair with a node that is not open has been met in the trees but for `miss`.
5. Links make components: union-find within tasks, in one task while they are at most `one_task`, else with joins from root to
   root until nothing changes.

A node has at most 2 * window partners in a tree, so no key of the forest is hot and no group is expanded into pairs. A large cluster is
dealt over tasks in cells of two blocks, as is a key of the prefix filter with many nodes; cells give links that span what they
found, not pairs. The comparison inside a cluster of N open nodes costs N^2 / 2 products of sets.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; fewer words than a shingle are one shingle; null
texts and those without words have an empty set and link with nothing; each row is a document, rows with one id and different texts, too:
they are linked by their texts only; a null id links with nothing and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, register, stored

SIZE = 128
#: Bytes of a prefix that are looked at, at most.
DEEPEST = 32
#: Rows that a broadcast side may have.
FEW = 500_000
_rng = np.random.default_rng(20)
MUL = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64)
MIX = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[word] = h
        return h


_hashes = Hashes()
register("dedup", _hashes.clear)


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(31))) * MIX[j]
    return np.unique(out)


def fingerprint(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signature(s: np.ndarray) -> bytes:
    """For each hash function, the low byte of the set's minimum."""
    low = np.full(SIZE, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[None, at : at + 2048] * MUL[:, None] + ADD[:, None]) >> np.uint64(32)).min(axis=1))
    return (low & np.uint64(0xFF)).astype(np.uint8).tobytes()


def signed(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """id, n (set size), fp (fingerprint) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("dedup")
        for batch in batches:
            n, fp, sig = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, k)
                n.append(len(s))
                fp.append(fingerprint(s))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "fp", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "id long, n long, fp binary, sig binary")


def by_size(rows: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most FEW rows."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def tasks_of(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def forest(nodes: DataFrame, *, trees: int, seed: int, window: int, shallow: int, agree: int, percent: int, with_notes: bool = True) -> DataFrame:
    """a, b: neighbours in the sorted orders of a forest. nodes: node, n, sig and comp; only pairs of different comp are given.

    Rows with a null b say how deep the window of node a reached in some tree, where it did not hold all that share `shallow` bytes:
    depth is the shortest prefix with which every node was met, or DEEPEST + 1 where a task's border cut it.
    """
    order = np.random.default_rng(seed)
    orders = [order.permutation(SIZE) for _ in range(trees)]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SIZE)
            ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * SIZE)
            for t, p in enumerate(orders):
                keys = pa.Array.from_buffers(pa.binary(), len(sig), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(sig[:, p]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), keys, batch.column(0), batch.column(1), batch.column(3)], ["tree", "key", "node", "n", "comp"])

    def pairs(node: np.ndarray, n: np.ndarray, comp: np.ndarray, key: np.ndarray, adjacent: np.ndarray, new: int) -> Iterator[pa.RecordBatch]:
        """Candidates whose later row is at `new` or beyond."""
        a, b = [], []
        shared = adjacent
        for off in range(1, min(window, len(node) - 1) + 1):
            if off > 1:  # the shortest of the prefixes that lie between
                shared = np.minimum(shared[:-1], adjacent[off - 1 :])
            i = np.arange(max(0, new - off), len(node) - off)
            j = i + off
            i = i[(shared[i] >= shallow) & (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))]
            i = i[np.count_nonzero(key[i] == key[i + off], axis=1) >= agree]
            a.append(np.minimum(node[i], node[i + off]))
            b.append(np.maximum(node[i], node[i + off]))
        if a and (m := sum(map(len, a))):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.nulls(m, pa.int32())], ["a", "b", "depth"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window + 1
        held, start, first = None, 0, True
        # Of the run (rows that share `shallow` bytes) that is not over yet: its least and largest component and its notes. A run of
        # one component needs no notes, unless it may go on in another task.
        least, most, waiting = -1, 0, []

        def notes(node: list[np.ndarray], depth: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if m := sum(map(len, node)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.nulls(m, pa.int64()), pa.array(np.concatenate(depth).astype(np.int32))], ["a", "b", "depth"])

        def noted(node: np.ndarray, comp: np.ndarray, depth: np.ndarray, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
            """begins: whether a run begins with the row."""
            nonlocal least, most, waiting
            starts = np.flatnonzero(begins)
            if not len(starts) or starts[0] > 0:
                starts = np.append(0, starts)
            low, high = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
            deep = np.flatnonzero(depth > shallow)
            run = np.searchsorted(starts, deep, side="right") - 1
            out = []
            for k in (0, len(starts) - 1) if len(starts) > 1 else (0,):  # the first may go on from before, the last is left open
                if k or begins[0]:
                    if least != most:
                        out += waiting
                    least, most, waiting = low[k], high[k], []
                else:
                    least, most = min(least, low[k]), max(most, high[k])
                if (run == k).any():
                    waiting.append((node[deep[run == k]], depth[deep[run == k]]))
            inner = deep[(run > 0) & (run < len(starts) - 1) & (low != high)[run]]
            out.append((node[inner], depth[inner]))
            yield from notes([x for x, _ in out], [x for _, x in out])

        def finish(lo: int, hi: int, last: bool) -> Iterator[pa.RecordBatch]:
            """Notes of rows lo to hi, whose windows are known."""
            if hi <= lo or not with_notes:
                return
            tree, node, n, comp, key = held
            m = len(node)
            far = np.zeros(m + width, np.int64)  # by the later row: the prefix shared with the row `width` before
            far[:width] = DEEPEST if first else 0
            far[m:] = DEEPEST if last else 0
            if m > width:
                s = adjacent
                for off in range(2, width + 1):
                    s = np.minimum(s[:-1], adjacent[off - 1 :])
                far[width:m] = s
            at = np.arange(lo, hi)
            reach = np.maximum(far[at], far[at + width])
            begins = np.zeros(hi - lo, bool)
            inner = at[at > 0]
            begins[inner - lo] = adjacent[inner - 1] < shallow
            yield from noted(node[lo:hi], comp[lo:hi], np.where(reach >= shallow, reach + 1, shallow), begins)

        for batch in batches:
            tree, node, n, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SIZE)
            new = 0
            if held is not None:  # the last rows of the batch before
                new = len(held[1])
                tree, node, n, comp, key = (np.concatenate([x, y]) for x, y in zip(held, (tree, node, n, comp, key), strict=True))
            same = key[1:, :DEEPEST] == key[:-1, :DEEPEST]
            adjacent = np.where(tree[1:] != tree[:-1], 0, np.where(same.all(axis=1), DEEPEST, same.argmin(axis=1)))
            yield from pairs(node, n, comp, key, adjacent, new)
            held = (tree, node, n, comp, key)
            # Rows with a whole window behind them; the others wait for the next batch.
            ready = max(start, len(node) - width)
            yield from finish(start, ready, False)
            first = first and ready < width
            keep = min(len(node), 2 * width + 2)
            held = tuple(x[len(node) - keep :] for x in held)
            adjacent = adjacent[len(adjacent) - keep + 1 :]
            start = ready - (len(node) - keep)
        if held is not None:
            yield from finish(start, len(held[1]), True)
            yield from notes([x for x, _ in waiting], [x for _, x in waiting])

    grown = nodes.select("node", "n", "sig", "comp").mapInArrow(grow, "tree int, key binary, node long, n long, comp long")
    return grown.repartitionByRange(tasks_of(nodes), "tree", "key", "node").sortWithinPartitions("tree", "key", "node").mapInArrow(meet, "a long, b long, depth int")


def sets_of(docs: DataFrame, wanted: DataFrame, *, id_col: str, text: str, k: int) -> DataFrame:
    """node, s (sorted shingles as bytes) of each wanted (node, rep, fp), once or more often if rows are repeated."""
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text).cast("binary").alias("text")).join(by_size(wanted), "rep").select("node", "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("dedup")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                node, out = [], []
                for one, fp, t in zip(*(batch.column(i).slice(at, 512).to_pylist() for i in range(3)), strict=True):
                    s = shingles(t, k)
                    if fingerprint(s) == fp:  # else another text with this id
                        node.append(one)
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "s"])

    return rows.mapInArrow(run, "node long, s binary")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, *, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(classes.select("node", "rep", "fp").join(by_size(stored(ids)), "node", "left_semi"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    s = sets_of(docs, wanted, id_col=id_col, text=text, k=k).groupBy("node").agg(F.min("s").alias("s"))
    both = pairs.join(s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return stored(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))


class Union:
    """Union-find; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def components(links: DataFrame, *, one_task: int = 2_000_000) -> DataFrame:
    """node, comp for every node in the stored links (a, b): comp is the smallest node of its component; nodes that are their own comp are left out."""

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = Union()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u.join(x, y)
        own = list(u.up)
        for at in range(0, len(own), 10_000):
            ids = own[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([u.root(x) for x in ids], pa.int64())], ["node", "comp"])

    edges = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("comp"))
    if links.count() <= one_task:
        return stored(edges.repartition(1).mapInArrow(join_up, "node long, comp long"))
    while True:
        edges = stored(edges.repartition(tasks_of(links), "node").mapInArrow(join_up, "node long, comp long").distinct())
        # A root that points further, or a node with several roots, is not done.
        further = edges.groupBy("node").agg(F.min("comp").alias("next"), F.count(F.lit(1)).alias("n"))
        inner = edges.select(F.col("comp").alias("node")).distinct().join(further, "node", "left_semi")
        if further.where("n > 1").isEmpty() and inner.isEmpty():
            return edges
        steps = stored(inner.join(further, "node").select(F.col("node").alias("comp"), "next"))
        jumped = edges.join(by_size(steps), "comp", "left")
        # Both what a node pointed to and where that leads: nothing that held together falls apart.
        edges = jumped.select("node", F.coalesce("next", "comp").alias("comp")).union(steps.select(F.col("comp").alias("node"), F.col("next").alias("comp"))).where("node != comp").distinct()


def labelled(nodes: DataFrame, labels: DataFrame, name: str = "comp") -> DataFrame:
    """nodes with the label of each, itself where it has none."""
    own = labels.select("node", F.col("comp").alias("__l"))
    return nodes.drop(name).join(by_size(own), "node", "left").withColumn(name, F.coalesce("__l", "node")).drop("__l")


def shared_counts(a: np.ndarray, row_a: np.ndarray, n_rows: int, often: int = 16, width: int = 4096) -> np.ndarray:
    """How many shingles each two rows share. a, row_a: (shingle, row), in the order of shingles.

    Shingles of at most `often` rows are counted pair by pair, the others by matrix products of `width` columns.
    """
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(first, len(a)))
    out = np.zeros(n_rows * n_rows)
    rare = np.repeat(size <= often, size)
    x, r = a[rare], row_a[rare].astype(np.int64)
    for off in range(1, often):
        i = np.flatnonzero(x[:-off] == x[off:]) if len(x) > off else []
        if not len(i):
            break
        out += np.bincount(r[i] * n_rows + r[i + off], minlength=n_rows * n_rows)
    out = out.reshape(n_rows, n_rows)
    out = out + out.T
    col = np.cumsum(size > often) - 1
    c, r = np.repeat(col, size)[~rare], row_a[~rare]
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(c, [at, at + width])
        m = np.zeros((n_rows, width), np.float32)
        m[r[lo:hi], c[lo:hi] - at] = 1
        out += m @ m.T
    return out


def cluster_links(rows: DataFrame, *, percent: int, block: int = 256) -> DataFrame:
    """a, b: links that span the components within each cluster. rows (stored): node, cluster, comp, s."""
    sizes = rows.groupBy("cluster").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("m")).where("least < most")
    sizes = stored(sizes.select("cluster", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    cells = rows.join(by_size(sizes), "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "comp", "s")

    def links(node: list[int], comp: list[int], sets: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(node) < 2 or min(comp) == max(comp):
            return
        flat = np.frombuffer(b"".join(sets), np.uint64)
        n = np.array([len(s) // 8 for s in sets], np.int64)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(flat, kind="stable")
        both = shared_counts(flat[order], row[order], len(n))
        i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
        u = Union()
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if u.join(comp[x], comp[y]):
                yield node[x], node[y]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [], [])

        def done() -> Iterator[pa.RecordBatch]:
            if found := list(links(*held)):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *this, node, comp, s in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if this != cell:
                    yield from done()
                    cell, held = this, ([], [], [])
                held[0].append(node)
                held[1].append(comp)
                held[2].append(s)
        yield from done()

    return stored(cells.repartition(tasks_of(rows), "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(meet, "a long, b long"))


def prefix_candidates(rows: DataFrame, *, agree: int, percent: int, common: int = 32, most_common: int = FEW, cell: int = 1024) -> DataFrame:
    """a, b: all pairs of rows (stored: node, n, sig, group, s) of different groups that can be as similar as asked and agree in `agree` bytes.

    The order of shingles, by number of rows for the `most_common` ones after all others, decides the cost only, never the result.
    """
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                key, n = np.unique(np.frombuffer(b"".join(batch.column(0).slice(at, 256).to_pylist()), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    often = rows.select("s").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= common).orderBy(F.desc("n"), "key").limit(most_common).toArrow()
    key = often.column("key").to_numpy().view(np.uint64)
    by_key = np.argsort(key)
    shared = spark.sparkContext.broadcast((np.append(key[by_key], np.uint64(0)), np.append(often.column("n").to_numpy()[by_key], 0)))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_rows = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = []
                for one in part.column(2).to_pylist():
                    s = np.frombuffer(one, np.uint64)
                    place = np.searchsorted(known[:-1], s)
                    rank = np.where(known[place] == s, n_rows[place], 0)
                    keys.append(s[np.lexsort((s, rank))][: len(s) + percent * -len(s) // 100 + 1] if len(s) else s)
                sizes = list(map(len, keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), sizes)) for i in (0, 1))], ["key", "node", "group"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(node: np.ndarray, n: np.ndarray, group: np.ndarray, own: np.ndarray, one: bool, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            for i in range(len(node) - 1):
                j = np.arange(i + 1, len(node))
                j = j[(group[j] != group[i]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))]
                if not one:
                    j = j[own[j] != own[i]]
                j = j[np.count_nonzero(sig[j] == sig[i], axis=1) >= agree]
                a.append(np.minimum(node[i], node[j]))
                b.append(np.maximum(node[i], node[j]))
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            cols.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, SIZE))
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            key, lo, hi, own, node, n, group, sig = cols
            cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for x, y in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=False):
                yield from pairs(node[x:y], n[x:y], group[x:y], own[x:y], lo[x] == hi[x], sig[x:y])
            held = [x[cut[-1] if len(cut) else 0 :] for x in cols]
        if held is not None:
            key, lo, hi, own, node, n, group, sig = held
            yield from pairs(node, n, group, own, lo[0] == hi[0], sig)

    keys = stored(rows.select("node", "group", "s").mapInArrow(firsts, "key long, node long, group long"))
    met = keys.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.count(F.lit(1)).alias("m")).where("least < most")
    met = stored(met.select("key", F.ceil(F.col("m") / cell).cast("int").alias("blocks")))
    keys = keys.select("key", "node").join(by_size(met), "key")
    keys = keys.join(rows.select("node", "n", "group", "sig"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = keys.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "group", "sig")
    return cells.repartition(tasks_of(rows), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(meet, "a long, b long").distinct()


def open_nodes(notes: DataFrame, *, trees: int, shallow: int, percent: int, miss: float) -> DataFrame:
    """node of those that miss a partner at the asked similarity with a probability above miss. notes: a, depth of windows that were not whole."""
    p = percent / 100
    whole = float(np.log1p(-(p**shallow)))
    lost = F.when(F.col("depth") > DEEPEST, 0.0).otherwise(F.log1p(-F.pow(F.lit(p), F.col("depth"))))
    sums = notes.groupBy(F.col("a").alias("node")).agg(F.sum(lost - F.lit(whole)).alias("more"))
    return sums.where(F.col("more") + F.lit(trees * whole) > F.lit(float(np.log(miss)))).select("node")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 85, seeds: int = 2, trees: int = 16, window: int = 4, shallow: int = 3, miss: float = 1e-6) -> DataFrame:
    """id_col, n_shingles, component_id and kept of every row."""
    p = percent / 100
    agree = int(SIZE * p - 4.7 * (SIZE * p * (1 - p)) ** 0.5) if p < 1 else SIZE
    rows = stored(signed(docs, id_col, text, k))
    # Equal sets have equal sizes and signatures, so either stands for all.
    classes = rows.where("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("m"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = classes.select("node", "n", "sig", F.col("node").alias("comp"))
    options = {"shallow": shallow, "agree": agree, "percent": percent}
    read = {"id_col": id_col, "text": text, "k": k}

    pairs = stored(forest(nodes, trees=seeds, seed=1, window=1, with_notes=False, **options).where("b is not null").select("a", "b").distinct())
    links = confirmed(docs, classes, pairs, percent=percent, **read)
    labels = components(links)
    grown = stored(forest(labelled(nodes, labels), trees=trees, seed=2, window=window, **options))
    more = stored(grown.where("b is not null").select("a", "b").distinct())
    links = links.union(confirmed(docs, classes, more, percent=percent, **read))
    labels = components(links)
    # What the windows did not hold.
    unsure = stored(open_nodes(grown.where("b is null"), trees=trees, shallow=shallow, percent=percent, miss=miss)) if p < 1 else None
    if unsure is not None and not unsure.isEmpty():
        left = stored(labelled(classes.join(by_size(unsure), "node", "left_semi"), labels))
        clusters = components(stored(pairs.union(more).union(labels.select("node", "comp"))))
        own = labelled(left, clusters, "cluster").select("node", "n", "sig", "comp", "cluster")
        sets = sets_of(docs, left.select("node", "rep", "fp"), **read).groupBy("node").agg(F.min("s").alias("s"))
        own = stored(own.join(sets, "node"))
        links = links.union(cluster_links(own.select("node", "cluster", "comp", "s"), percent=percent))
        apart = stored(prefix_candidates(own.withColumnRenamed("cluster", "group"), agree=agree, percent=percent))
        links = links.union(confirmed(docs, classes, apart, percent=percent, **read))
        labels = components(stored(links))
    # The smallest id of each component; only classes of several rows or in a link can have another than their own.
    linked = labelled(classes.select("node", "fp", "rep", "m"), labels)
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("nodes"), F.sum("m").alias("docs")).where("docs > 1").select("comp", "component_id")
    changed = stored(linked.join(least, "comp").select("fp", "component_id"))
    out = rows.select("id", "n", "fp").join(by_size(changed), "fp", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
