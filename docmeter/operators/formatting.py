"""Formatting rules: styles, mark colours, formulas, code blocks, titles and page sections."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

def quote(text: Column) -> Column:
    """A text as a pattern: its characters as they are, any white space for a space."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\\[\](){}.*+?^$|])", r"\\$1"), r"\s+", r"\\s+")


def style_exact(text: Column, query: Column, style: str) -> Column:
    """query stands inside the style, in Catalyst: the first look of has_style, without marks inside the query."""
    sides = [p.replace("{{", "{").replace("}}", "}").split("{}") for p in R.SPANS[style]]
    hit = [F.regexp_like(text, F.concat(F.lit("(?is)" + a), quote(F.trim(query)), F.lit(b))) for a, b in sides]
    return functools.reduce(lambda x, y: x | y, hit)


def has_style(text: Column, query: Column, style: str) -> Column:
    """query stands inside the style. Where the exact form decides, no Python runs on more than the undecided rows of a batch."""

    @F.pandas_udf("boolean")
    def run(t: pd.Series, q: pd.Series, sure: pd.Series) -> pd.Series:
        return pd.Series([bool(s) or bool(a and b and R.has_style(a, b, style)) for a, b, s in zip(t, q, sure, strict=True)])

    return run(text, query, style_exact(text, query, style))


def lacks_style(text: Column, query: Column, style: str) -> Column:
    """The negative rule; it passes if the text is absent."""
    return ~has_style(text, query, style)


def mark_color(text: Column, query: Column, color: str) -> Column:
    return F.regexp_like(text, F.concat(F.lit(rf"(?is)<mark\b[^>]*\b{color}\b[^>]*>(?:(?!</mark>).)*?"), quote(query), F.lit(r"(?:(?!</mark>).)*?</mark>")))


def is_latex(text: Column, formula: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(formula, r"^(\$\$?|\\\[|\\\()|(\$\$?|\\\]|\\\))$", ""), r"\s+", "")
    return F.array_contains(T.formulas(text), bare)


def is_code_block(text: Column, language: str | None, code: Column) -> Column:
    """A fenced block of the language (any, if none is given) holds the code."""
    return F.exists(T.code_blocks(text), lambda b: (F.lit(True) if not language else F.lower(F.trim(b["language"])) == language.lower()) & F.contains(b["code"], code))


def title_events(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, level, title: markdown headings (1 to 6), HTML headings, and bold lines (7), by line; equal events once."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "t"))
    md = F.regexp_extract("t", r"^\s*(#{1,6})\s+(.*?)\s*#*\s*$", 1)
    tag = F.regexp_extract_all("t", F.lit(r"(?i)<h([1-6])\b[^>]*>.*?</h\1>"), 1)
    body = F.regexp_extract_all("t", F.lit(r"(?i)<h([1-6])\b[^>]*>(.*?)</h\1>"), 2)
    bold = F.regexp_extract("t", r"^\s*(?:\*\*|<b>)(.+?)(?:\*\*|</b>)\s*$", 1)
    e = F.concat(
        F.when(md != "", F.array(F.struct(F.length(md).alias("level"), F.regexp_extract("t", r"^\s*#{1,6}\s+(.*?)\s*#*\s*$", 1).alias("title")))).otherwise(F.array().cast("array<struct<level:int,title:string>>")),
        F.transform(F.arrays_zip(tag.alias("a"), body.alias("b")), lambda x: F.struct(x["a"].cast("int").alias("level"), x["b"].alias("title"))),
        F.when(bold != "", F.array(F.struct(F.lit(7).alias("level"), bold.alias("title")))).otherwise(F.array().cast("array<struct<level:int,title:string>>")),
    )
    out = lines.select(key, "line", F.inline(e))
    return out.select(key, "line", "level", F.trim(T.normalize(F.regexp_replace("title", r"<[^>]+>", ""))).alias("title")).where("title <> ''").distinct()


def is_title(events: DataFrame, rules: DataFrame, key: str, title: str = "wanted") -> DataFrame:
    """rules (key, wanted) with passed; the level does not count."""
    found = events.select(key, F.col("title").alias(title)).distinct().withColumn("passed", F.lit(True))
    return rules.join(found, [key, title], "left").fillna(False, ["passed"])


def hierarchy_py(events: list[tuple[int, int, str]], wanted: dict) -> float:
    """Share of the nested titles, and of their parent, child and sibling edges, that hold: an edge holds if the child comes later and deeper, siblings in order and at one level."""
    first: dict[str, tuple[int, int]] = {}
    for line, level, title in sorted(events):
        first.setdefault(title, (line, level))
    ok = total = 0

    def walk(node: dict, parent: str | None) -> None:
        nonlocal ok, total
        before = None
        for raw, below in node.items():
            t = T.normalize_py(raw).strip()
            total += 1
            ok += t in first
            if parent is not None:
                total += 1
                ok += t in first and parent in first and first[t][0] > first[parent][0] and first[t][1] > first[parent][1]
            if before is not None:
                total += 1
                ok += t in first and before in first and first[t][0] > first[before][0] and first[t][1] == first[before][1]
            before = t
            if isinstance(below, dict):
                walk(below, t)

    walk(wanted, None)
    return ok / total if total else 1.0


def title_hierarchy(events: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """rules (key, wanted: JSON) with score and passed (from 0.999). A document's titles are few."""
    own = events.groupBy(key).agg(F.collect_list(F.struct("line", "level", "title")).alias("e"))

    @F.pandas_udf("double")
    def score(e: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([hierarchy_py([(x["line"], x["level"], x["title"]) for x in (a if a is not None else [])], json.loads(b)) for a, b in zip(e, w, strict=True)])

    out = rules.join(own, key, "left").withColumn("score", score("e", "wanted"))
    return out.drop("e").withColumn("passed", F.col("score") >= 0.999)


def in_sections(sections: Column, query: Column) -> Column:
    """A page header or footer (array of texts) holds the text, both normalised."""
    return F.exists(sections, lambda s: F.contains(T.normalize(s), F.trim(T.normalize(query))))


def html_sections(html: Column, tag: str) -> Column:
    """Texts of all elements of a tag."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), T.html_text)
