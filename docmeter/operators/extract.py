"""Extraction and question answering: JSON comparison, typed values, field and record scores, answer matching, paths and rule ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

# Date patterns in the order they are tried, tick marks, and tolerances.
DATES = ("%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%B %d %Y", "%b %d %Y", "%A %B %d %Y", "%a %b %d %Y", "%A %b %d %Y", "%a %B %d %Y", "%d %B %Y", "%d %b %Y")
SPARK_DATES = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")
DAY_FIRST = ("%d/%m/%Y", "%d-%m-%Y")
TRUE, FALSE = {"true", "yes", "y", "1", "on", "checked", "☑", "☒", "✓", "✔", "x"}, {"false", "no", "n", "0", "off", "unchecked", "☐", ""}
NUMERIC, STRING = 1e-6, 0.90
PATH = re.compile(r"[^.\[\]]+|\[\d+\]")


def iso_date(t: str) -> str | None:
    """The day that a text of 4 to 50 characters names: numbers with the year first, or the month first (the day, if it can't be a month), or month names."""
    t = t.strip() if isinstance(t, str) else ""
    if not 4 <= len(t) <= 50 or t.isdigit() or re.search(r"\d{10,}", t):
        return None
    t = re.sub(r"\s+", " ", t.replace(",", " ").replace(".", " ")).strip()
    for f in (*DATES, *DAY_FIRST):
        try:
            return datetime.strptime(t, f).date().isoformat()
        except ValueError:
            continue
    return None


def date_column(t: Column) -> Column:
    """The first date pattern that fits, as ISO text; weekday names are passed over, and a day stands first only where it can't be a month."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, "[,.]", " "), r"\s+", " "))
    bare = F.regexp_replace(bare, r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)? ", "")
    day = F.coalesce(*(F.try_to_date(bare, f) for f in (*SPARK_DATES, "d/M/yyyy", "d-M-yyyy")))
    return F.when(F.length(F.trim(t)).between(4, 50) & ~t.rlike(r"^\d+$|\d{10,}"), F.date_format(day, "yyyy-MM-dd"))


def steps(path: str) -> list[str | int]:
    return [int(x[1:-1]) if x[0] == "[" else int(x) if x.isdigit() else x for x in PATH.findall(path or "")]


def get_path(value, path: str):
    """The value at `a[0].b` or `a.0.b`; the root for an empty path, None where there is nothing."""
    for s in steps(path):
        try:
            value = value[s]
        except (KeyError, IndexError, TypeError):
            return None
    return value


def put_path(root, path: str, value) -> dict:
    node, keys = root, steps(path)
    for k, nxt in zip(keys, [*keys[1:], None], strict=True):
        new = value if nxt is None else [] if isinstance(nxt, int) else {}
        if isinstance(k, int):
            node.extend([None] * (k + 1 - len(node)))
            node[k] = new if nxt is None or node[k] is None else node[k]
        else:
            node[k] = new if nxt is None else node.get(k, new)
        node = node[k]
    return root


def inflate(fields: dict[str, object]) -> dict:
    """Flat paths to a nested value."""
    root: dict = {}
    for path in sorted(fields, key=lambda p: [(isinstance(s, int), str(s).zfill(9)) for s in steps(p)]):
        put_path(root, path, fields[path])
    return root


def leaves(value, path: str = "") -> dict[str, object]:
    if isinstance(value, dict):
        return {p: v for k, x in value.items() for p, v in leaves(x, f"{path}.{k}" if path else k).items()}
    if isinstance(value, list):
        return {p: v for i, x in enumerate(value) for p, v in leaves(x, f"{path}[{i}]").items()}
    return {path: value}


def drift(fields: dict[str, object], expected) -> list[str]:
    """Paths where rules and the expected output differ."""
    own = leaves(expected)
    return sorted(p for p in {*fields, *own} if fields.get(p) != own.get(p))


def unwrap(value):
    """A list-rooted output in the shape of a document: a single document, rows of items, or documents merged key by key."""
    if not isinstance(value, list):
        return value
    if len(value) == 1 and isinstance(value[0], dict):
        return value[0]
    if value and all(isinstance(x, dict) and len(x) == 1 and isinstance(next(iter(x.values())), list) for x in value):
        out: dict = {}
        for x in value:
            for k, v in x.items():
                out.setdefault(k, []).extend(v)
        return out
    return {"items": value}


def same_text(a, b) -> bool:
    x, y = (" ".join(str(v).split()).lower() for v in (a, b))
    return x == y or (d := iso_date(x)) is not None and d == iso_date(y)


def subset_score(expected, actual) -> tuple[float, int]:
    """(matched leaves, leaves): what is expected, in what is there; lists by index, dates in any form. Nothing more is asked of the rest."""
    if isinstance(expected, dict):
        parts = [subset_score(v, actual.get(k) if isinstance(actual, dict) else None) for k, v in expected.items()]
    elif isinstance(expected, list):
        parts = [subset_score(v, actual[i] if isinstance(actual, list) and i < len(actual) else None) for i, v in enumerate(expected)]
    elif expected is None:
        return float(actual in (None, "")), 1
    elif isinstance(expected, bool) or isinstance(actual, bool):
        return float(expected is actual), 1
    elif isinstance(expected, (int, float)) and isinstance(actual, (int, float)):
        return float(abs(expected - actual) <= NUMERIC * max(1.0, abs(expected))), 1
    else:
        return float(actual is not None and same_text(expected, actual)), 1
    return sum(p for p, _ in parts), sum(n for _, n in parts)


def accuracy(expected, actual) -> float:
    hit, n = subset_score(expected, unwrap(actual))
    return hit / n if n else 1.0


def number(t) -> float | None:
    """Currency signs, thousands commas and brackets for a loss."""
    if isinstance(t, (int, float)) and not isinstance(t, bool):
        return float(t)
    s = re.sub(r"[$€£¥\s]", "", str(t))
    neg = s.startswith("(") and s.endswith(")")
    s = s.strip("()").replace(",", "")
    try:
        return -float(s) if neg else float(s)
    except ValueError:
        return None


def truth(t) -> bool | None:
    s = str(t).strip().lower()
    return True if s in TRUE else False if s in FALSE else None


def same_value(expected, actual, kind: str | None = None, fuzzy: bool = True) -> bool:
    """Typed comparison: null, boolean, number, date, and text, equal or (if fuzzy) by Jaro-Winkler from 0.90."""
    if expected is None or actual is None:
        return expected is None and actual is None
    kind = kind or ("boolean" if isinstance(expected, bool) else "number" if isinstance(expected, (int, float)) else "date" if iso_date(str(expected)) else "string")
    if kind == "boolean":
        return truth(expected) is not None and truth(expected) == truth(actual)
    if kind in ("number", "integer"):
        a, b = number(expected), number(actual)
        return a is not None and b is not None and abs(a - b) <= max(NUMERIC, NUMERIC * abs(a))
    if kind == "date":
        a, b = iso_date(str(expected)), iso_date(str(actual))
        return a is not None and a == b
    x, y = (re.sub(r"\s+", " ", str(v)).strip().casefold() for v in (expected, actual))
    return x == y or fuzzy and K.jaro_winkler(x, y) >= STRING


def anls(expected: list[str], actual: str) -> float:
    """Best similarity to an accepted answer; below a half it counts 0."""
    best = max((K.similarity(e.strip().lower(), actual.strip().lower()) for e in expected), default=0.0)
    return best if best >= 0.5 else 0.0


def accuracy_udf():
    """(expected JSON, actual JSON) -> accuracy; what is no JSON scores 0."""

    @F.pandas_udf("double")
    def run(e: pd.Series, a: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return accuracy(json.loads(x), json.loads(y) if y is not None else None)
            except (TypeError, ValueError):
                return 0.0

        return pd.Series([one(x, y) for x, y in zip(e, a, strict=True)])

    return run


def pattern(path: Column) -> Column:
    """A path with [*] for every index."""
    return F.regexp_replace(path, r"\[\d+\]", "[*]")


def value_scores(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """pattern, tp, fp, fn, precision, recall, f1 of fields (key, path, value): under one pattern a value counts wherever its index is, each used once."""
    side = lambda d, n: d.where("value is not null").groupBy(key, pattern(F.col("path")).alias("pattern"), "value").agg(F.count(F.lit(1)).alias(n))
    j = side(expected, "e").join(side(actual, "a"), [key, "pattern", "value"], "full_outer").fillna(0, ["e", "a"])
    g = j.groupBy("pattern").agg(F.sum(F.least("e", "a")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    g = g.withColumn("precision", p).withColumn("recall", r)
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def record_scores(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, record_precision, record_recall, record_f1: whole records that agree in every field, each used once."""
    side = lambda d, n: d.groupBy(key, F.xxhash64(*fields).alias("h"), *fields).agg(F.count(F.lit(1)).alias(n))
    j = side(expected, "e").join(side(actual, "a"), [key, "h", *fields], "full_outer").fillna(0, ["e", "a"])
    g = j.groupBy(key).agg(F.sum(F.least("e", "a")).alias("hit"), F.sum("e").alias("e"), F.sum("a").alias("a"))
    p, r = F.coalesce(F.try_divide("hit", "a"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "e"), F.lit(0.0))
    return g.select(key, p.alias("record_precision"), r.alias("record_recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("record_f1"))


def null_hallucination(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, rate: values given where null is expected."""
    return expected.where("value is null").select(key, "path").join(actual.select(key, "path", F.col("value").alias("got")), [key, "path"], "left").groupBy(key).agg(F.avg(F.col("got").isNotNull().cast("double")).alias("rate"))


def index_tolerant(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, path, got_path: under one pattern, values equal at the same place first, then in order of places."""
    e = expected.select(key, "path", pattern(F.col("path")).alias("p"), F.col("value").alias("v"))
    a = actual.select(key, F.col("path").alias("got_path"), pattern(F.col("path")).alias("p"), F.col("value").alias("v"))
    same = e.join(a, [key, "p", "v"]).where("path = got_path").select(key, "path", "got_path", "p", "v")
    w = lambda c: F.row_number().over(Window.partitionBy(key, "p", "v").orderBy(c))
    rest = e.join(same.select(key, "path"), [key, "path"], "left_anti").withColumn("__k", w("path")).join(a.join(same.select(key, "got_path"), [key, "got_path"], "left_anti").withColumn("__k", w("got_path")), [key, "p", "v", "__k"])
    return same.select(key, "path", "got_path").unionByName(rest.select(key, "path", "got_path"))


def array_length(value: Column, op: str, n: int) -> Column:
    return {"eq": F.size(value) == n, "gt": F.size(value) > n, "lt": F.size(value) < n, "gte": F.size(value) >= n, "lte": F.size(value) <= n}[op]


def array_head(value: Column, wanted: Column) -> Column:
    return (F.size(value) >= F.size(wanted)) & (F.slice(value, 1, F.size(wanted)) == wanted)


def array_tail(value: Column, wanted: Column) -> Column:
    return (F.size(value) >= F.size(wanted)) & (F.slice(value, F.greatest(F.size(value) - F.size(wanted) + 1, F.lit(1)), F.size(wanted)) == wanted)


def answer_match(kind: Column, expected: Column, actual: Column, tolerance: float = 1e-6) -> Column:
    """single: the first letter; multiple: the set of letters; numerical: within the tolerance; free: the set between commas."""
    letters = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"\b([A-Z])\b"), 1)))
    num = lambda c: F.regexp_extract(F.regexp_replace(c, r"[,$%]", ""), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
    items = lambda c: F.array_sort(F.array_distinct(F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x))))
    a, b = num(expected), num(actual)
    return F.coalesce(
        F.when(kind == "single", F.get(letters(expected), 0) == F.get(letters(actual), 0)).when(kind == "multiple", letters(expected) == letters(actual)).when(kind == "numerical", F.abs(a - b) <= F.greatest(F.lit(tolerance), F.abs(a) * tolerance)).otherwise(items(expected) == items(actual)),
        F.lit(False),
    )


def stray(value: Column, tags: Column) -> Column:
    """Rules that expect no value: null, or a tag stray, no_value or one that ends in :stray. They stay out of value and record scores."""
    return value.isNull() | F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin("stray", "no_value") | t.endswith(":stray"))


def rule_id(rule: dict, page: str = "", hash_len: int = 16) -> str:
    """First digits of SHA-256 over the page, a NUL and the rule's compact JSON with sorted keys and without its id."""
    body = json.dumps({k: v for k, v in rule.items() if k != "id"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(f"{page}\0{body}".encode()).hexdigest()[:hash_len]


def rule_id_column(page: Column, signature: Column, hash_len: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(page, F.lit("\0"), signature), 256), 1, hash_len)


def bag_overlap(a: list[str], b: list[str]) -> int:
    return sum((Counter(a) & Counter(b)).values())
