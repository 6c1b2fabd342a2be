"""Rule predicates over (rule, document) for text: presence, order, baseline, sentence, word and digit bags.

A document's features are computed once, before rules join them. Exact forms stay in Catalyst; the fuzzy ones are
Arrow functions that see only the rows that the exact form leaves undecided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T


def scoped(text: Column, first_n: int | None = None, last_n: int | None = None) -> Column:
    """The first and last characters of a text, or all of it."""
    head = F.substring(text, 1, first_n) if first_n else F.lit("")
    tail = F.when(F.length(text) <= last_n, text).otherwise(F.substring(text, -last_n, last_n)) if last_n else F.lit("")
    return F.concat(head, tail) if first_n or last_n else text


def occurrences(text: Column, query: Column) -> Column:
    """Non-overlapping occurrences of query."""
    return F.when(F.length(query) > 0, (F.length(text) - F.length(F.replace(text, query, F.lit("")))) / F.length(query)).otherwise(0).cast("long")


def present_exact(text: Column, query: Column, count: int | None = None) -> Column:
    return occurrences(text, query) == count if count else F.contains(text, query)


def passages_in(docs: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str, *, few: int = 100_000) -> DataFrame:
    """key, item of every passage that stands in a text, once; both with single spaces between words.

    Passages of five words or more meet texts by their second to fourth word, which stand whole in any text that holds the passage;
    shorter ones are looked for one by one. Up to `few` passages are shipped to the texts, which are read once and shuffled nowhere; beyond,
    keys are joined.
    """
    q = passages.where(F.col(passage).isNotNull()).select(F.col(item).alias("__i"), F.col(passage).alias("__q"))
    texts = docs.where(F.col(text).isNotNull())
    if (got := q.limit(few + 1).toArrow()).num_rows <= few:
        by_key: dict[str, list[tuple]] = {}
        for i, p in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            w = p.split(" ")
            by_key.setdefault(" ".join(w[1:4]) if len(w) >= 5 else "", []).append((i, p))
        shared = docs.sparkSession.sparkContext.broadcast(by_key)
        kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema, *passages.schema] if f.name in (key, item)}
        item_type = got.schema.field(0).type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                row, hit = [], []
                for n, t in enumerate(batch.column(1).to_pylist()):
                    w = t.split(" ")
                    near = {" ".join(x) for x in zip(w, w[1:], w[2:], strict=False)} & known.keys()
                    own = [i for k in (*near, "") for i, p in known.get(k, ()) if p in t]
                    row += [n] * len(own)
                    hit += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(hit, item_type)], names=[key, item])

        return texts.select(key, text).mapInArrow(run, f"{key} {kinds[key]}, {item} {kinds[item]}")
    q = q.withColumn("__w", F.split("__q", " "))
    long = q.where(F.size("__w") >= 5).select("__i", "__q", F.concat_ws(" ", F.slice("__w", 2, 3)).alias("__key"))
    keys = texts.select(key, F.split(F.col(text), " ").alias("__w"))
    keys = keys.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("__w", i, 3))))).alias("__key"))
    met = keys.join(long.select("__i", "__key"), "__key").select(key, "__i").distinct()
    hits = met.join(long.select("__i", "__q"), "__i").join(docs.select(key, text), key).where(F.contains(F.col(text), F.col("__q"))).select(key, F.col("__i").alias(item))
    short = q.where(F.size("__w") < 5).groupBy("__q").agg(F.collect_list("__i").alias("__items"))
    found = docs.join(short, F.contains(F.col(text), F.col("__q"))).select(key, F.explode("__items").alias(item))
    return hits.unionByName(found)


def threshold(max_diffs: float, query: str, floor: float = 0.7) -> float:
    return max(floor, min(1.0, 1 - max_diffs / max(1, len(query))))


def presence_udf():
    """(text, query, max_diffs, count, absent) -> passed, for normalised text."""

    @F.pandas_udf("boolean")
    def run(text: pd.Series, query: pd.Series, max_diffs: pd.Series, count: pd.Series, absent: pd.Series) -> pd.Series:
        out = []
        for t, q, d, c, a in zip(text, query, max_diffs, count, absent, strict=True):
            d = 0 if d is None or d != d else d
            if not a and c and c == c:
                n = t.count(q) if d == 0 else len(K.near_matches(q, t, int(min(d, 15))))
                out.append(n == c)
                continue
            least = threshold(d, q)
            found = q in t or least < 1 and K.partial_ratio(q, t) >= least
            out.append(found != bool(a))
        return pd.Series(out)

    return run


def baseline(text: Column, *, max_length: int | None = None, skip_images: bool = False, check_characters: bool = True) -> Column:
    """Passes if a blank page is blank, or else a text has letters or digits, does not repeat a character or two throughout, and has no foreign script."""
    count = lambda t: F.length(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}]", ""))
    if max_length is not None:
        return count(F.regexp_replace(text, r"!\[.*?\]\(.*?\)", "") if skip_images else text) <= max_length
    n = F.length(text)
    size = F.least(F.lit(200), n)
    samples = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(n / F.greatest(size, F.lit(1))))).cast("int")
    step = F.when(samples > 1, F.greatest(F.lit(1), F.floor((n - size) / F.greatest(samples - 1, F.lit(1))))).otherwise(0).cast("int")
    dull = F.size(F.filter(F.sequence(F.lit(0), samples - 1), lambda i: F.size(F.array_distinct(F.split(F.substring(text, i * step + 1, size), ""))) < 3))
    ok = (count(text) > 0) & ~((n > 50) & (dull > F.floor(samples / 2)))
    return ok & ~text.rlike("[一-鿿぀-ヿ\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}]") if check_characters else ok


def order_exact(text: Column, before: Column, after: Column) -> Column:
    """The first `before` comes earlier than the last `after`; null if either is not there exactly."""
    first = F.position(before, text)
    last = F.length(text) - F.position(F.reverse(after), F.reverse(text)) - F.length(after) + 2
    return F.when(F.contains(text, before) & F.contains(text, after), first < last)


def order_udf():
    """order for rows that the exact form leaves open: near matches within a twentieth of the length, 15 edits at most."""

    @F.pandas_udf("boolean")
    def run(text: pd.Series, before: pd.Series, after: pd.Series, max_diffs: pd.Series) -> pd.Series:
        def spots(q: str, t: str, d: float, last: bool) -> list[int]:
            at = t.rfind(q) if last else t.find(q)
            return [at] if at >= 0 else [m[0] for m in K.near_matches(q, t, int(min(max(len(q) // 20, d or 0), 15)))]

        out = []
        for t, b, a, d in zip(text, before, after, max_diffs, strict=True):
            x, y = spots(b, t, d, False), spots(a, t, d, True)
            out.append(bool(x and y) and min(x) < max(y))
        return pd.Series(out)

    return run


def bag(docs: DataFrame, key: str, items: Column) -> DataFrame:
    """key, item, n: how often each item occurs in a document. Counted on the map side first, so a frequent item is no hot key."""
    return docs.select(F.col(key), F.explode(items).alias("item")).groupBy(key, "item").agg(F.count(F.lit(1)).alias("n"))


def bag_scores(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """From bags (key, item, n) of both sides: missing, unexpected and too-many scores with their passes."""
    return both_scores(expected.select(key, "item", F.col("n").alias("e")).join(actual.select(key, "item", F.col("n").alias("a")), [key, "item"], "full_outer").fillna(0, ["e", "a"]), key)


def both_scores(j: DataFrame, key: str) -> DataFrame:
    """bag_scores of items (key, item) that hold the counts e and a of both sides: bags of one source are counted, and shuffled, once."""
    wanted, known = F.col("e") > 0, (F.col("e") > 0) & (F.col("a") > 0)
    g = j.groupBy(key).agg(
        F.sum("e").alias("required"), F.sum("a").alias("observed"), F.sum(F.least("e", "a")).alias("covered"), F.sum(F.when(known, F.col("a")).otherwise(0)).alias("known"),
        F.sum(F.when(wanted, F.greatest(F.col("a") - F.col("e"), F.lit(0))).otherwise(0)).alias("excess"), F.sum(F.when(wanted, F.greatest("a", "e")).otherwise(0)).alias("ceiling"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return g.select(
        key, share("covered", "required").alias("missing_percent"), share("known", "observed").alias("unexpected_percent"), F.when(F.col("ceiling") > 0, 1 - F.col("excess") / F.col("ceiling")).otherwise(1.0).alias("too_many_percent"),
        (F.col("covered") == F.col("required")).alias("missing"), (F.col("known") == F.col("observed")).alias("unexpected"), (F.col("excess") == 0).alias("too_many"),
    )


def extra_content(scores: DataFrame) -> DataFrame:
    """The older rule: nothing unexpected and nothing too often."""
    return scores.withColumn("extra_content", F.col("unexpected") & F.col("too_many"))


def digit_score(expected: Column, actual: Column) -> Column:
    """Sum of the smaller counts of each digit over the expected ones."""
    add = lambda a, b: a + b
    total = F.aggregate(expected, F.lit(0), add)
    return F.when(total > 0, F.aggregate(F.zip_with(expected, actual, lambda a, b: F.least(a, b)), F.lit(0), add) / total).otherwise(1.0)


def contains_sentence(text: Column, sentence: Column) -> Column:
    """Occurrences: plain from 20 characters on, between word boundaries below."""
    quoted = F.regexp_replace(sentence, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.when(F.length(sentence) >= 20, occurrences(text, sentence)).otherwise(F.regexp_count(text, F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)"))))


def rotation(expected: Column, first_page: Column, raw: Column) -> Column:
    """The first page's angle, from the output and else from the raw answer; a missing one fails."""
    return F.coalesce(F.coalesce(first_page, raw) == expected, F.lit(False))


def sentence_bags(docs: DataFrame, key: str, text: str) -> DataFrame:
    return bag(docs, key, T.sentences_udf(F.col(text)))
