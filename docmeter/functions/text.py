"""Text normalisers and tokenisers, as Spark columns where Catalyst can say it and as Arrow functions where Unicode tables are needed."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as the same, and the marks that markup uses.
SINGLE_QUOTES = "‘’‚‛`´ʼʹ＇′‵ʻˊˋ"
DOUBLE_QUOTES = "“”„‟〝〞＂″‶ˮ"
WIDE_MARKS = {"，": ",", "．": ".", "：": ":", "；": ";", "！": "!", "？": "?", "（": "(", "）": ")", "、": ",", "。": "."}
QUOTES = {**dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **WIDE_MARKS}
DASHES = "–—‑‒−"
BULLETS = "●○◦∙⦁·"
CROSSES = "⮾ⓧ⨂"
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni")
SUBSCRIPTS = ("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", "0123456789+-=()aehijklmnoprstuvx")
AUTOLINK = r"(?i)<((?:https?://|mailto:)[^>\s]+|[^>@\s]+@[^>@\s]+\.[^>@\s]+)>"
FORMATTING = r"(?i)</?(?:b|i|u|s|em|strong|del|strike|mark|ins)>"
SPAN = r"(?i)</?span\b[^>]*>"
DOT_LEADER = r"\.{2,}\s*$"

SAME = {**QUOTES, **dict.fromkeys(DASHES, "-"), **dict.fromkeys(BULLETS, "•"), **dict.fromkeys(CROSSES, "⊗"), "µ": "μ"}


def latin_accents() -> tuple[str, str]:
    """Latin letters with an accent, and the letters without it, up to U+024F."""
    pairs = [(c, b) for c in map(chr, range(0xC0, 0x250)) if (b := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) != c and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = latin_accents()


def arrow(f, kind: str):
    """An Arrow function of one text column, made when it is first used: workers import this module without a session."""

    def apply(text: Column) -> Column:
        @F.pandas_udf(kind)
        def run(t: pd.Series) -> pd.Series:
            return t.map(f)

        return run(text)

    apply.__doc__ = f.__doc__
    return apply


def replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def unaccent(text: Column) -> Column:
    """Without the accents of precomposed Latin letters; other scripts need normalize_udf."""
    return F.translate(text, ACCENTED, PLAIN)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def normalize(text: Column) -> Column:
    """Comparison text of Latin-script markdown, inside Catalyst; null becomes empty."""
    text = replace_all(F.coalesce(text, F.lit("")), [(AUTOLINK, "$1"), (r"<br\s*/?>", " ")])
    text = collapse(F.translate(text, "".join(QUOTES), "".join(QUOTES.values())))
    text = replace_all(text, [(r"\*\*(.*?)\*\*", "$1"), (r"__(.*?)__", "$1"), (r"</?[bi]>", ""), (r"\*(.*?)\*", "$1"), (r"_(.*?)_", "$1"), ("_", " ")])
    text = unaccent(text)
    text = F.translate(F.replace(text, F.lit("…"), F.lit("...")), "".join(SAME) + "＿", "".join(SAME.values()) + "_")
    text = replace_all(text, [(r"</?(?:ins|u|mark)>|~~|\$\$", ""), (r"(?i)</?(?:s|del|strike)>", ""), (SPAN, ""), (r"(?i)<su[pb][^>]*>.*?</su[pb]>", ""), (r"[¹²³⁰⁴-⁹₀-₉]+", ""), (r"-{2,}", "-"), (DOT_LEADER, "")])
    return F.lower(text)


def normalize_light(text: Column) -> Column:
    """Keeps styling and case; null becomes empty."""
    text = replace_all(F.coalesce(text, F.lit("")), [(AUTOLINK, "$1"), (r"<br/?>", " "), (SPAN, "")])
    text = collapse(F.translate(text, "".join(QUOTES), "".join(QUOTES.values())))
    text = F.translate(F.replace(unaccent(text), F.lit("…"), F.lit("...")), "".join(SAME) + "＿", "".join(SAME.values()) + "_")
    return F.trim(F.regexp_replace(text, r"-{2,}", "-"))


def normalize_cell(text: Column) -> Column:
    """A table cell's text: sub- and superscripts kept as text, formatting dropped, case kept, a cell of dashes is one dash."""
    text = replace_all(F.coalesce(text, F.lit("")), [(r"(?i)<su[pb][^>]*>(.*?)</su[pb]>", "$1")])
    text = F.translate(text, SUPERSCRIPTS[0] + SUBSCRIPTS[0], SUPERSCRIPTS[1] + SUBSCRIPTS[1])
    text = replace_all(text, [(FORMATTING, ""), (SPAN, ""), (r"\*\*(.*?)\*\*", "$1"), (r"__(.*?)__", "$1"), (r"(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", "$1"), (r"(?<!_)_(?!_)(.*?)(?<!_)_(?!_)", "$1"), (r"~~(.*?)~~", "$1")])
    text = F.translate(text, "".join(SAME), "".join(SAME.values()))
    text = F.trim(collapse(F.regexp_replace(text, DOT_LEADER, "")))
    return F.when(text.rlike(r"^[-\s]+$"), "-").otherwise(text)


# Scripts without spaces between words, and those whose letters keep their combining marks.
CJK = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF)]
MARKED = [*CJK, (0x1100, 0x11FF), (0x0B80, 0x0BFF), (0x0C80, 0x0CFF)]


def is_cjk(c: str) -> bool:
    return any(lo <= ord(c) <= hi for lo, hi in CJK)


def keeps_marks(c: str) -> bool:
    return any(lo <= ord(c) <= hi for lo, hi in MARKED)


def strip_marks(text: str, keep_cjk: bool = True) -> str:
    """Without combining marks, but for those on letters of scripts that keep them."""
    if text.isascii():
        return text
    out: list[str] = []
    base = ""
    for c in unicodedata.normalize("NFD", text):
        mark = unicodedata.category(c) == "Mn"
        if not mark:
            base = c
        if not mark or keep_cjk and base and keeps_marks(base):
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


_QUOTES, _SAME = str.maketrans(QUOTES), str.maketrans({**SAME, "＿": "_"})
# Patterns, what stands for their matches, and texts of which a match holds one (none: not ASCII).
_BEFORE = [(re.compile(p), by, "<") for p, by in ((AUTOLINK, r"\1"), (r"<br\s*/?>", " "))]
_MARKS = [(re.compile(p), by, k) for p, by, k in ((r"\*\*(.*?)\*\*", r"\1", "*"), (r"__(.*?)__", r"\1", "_"), (r"</?[bi]>", "", "<"), (r"\*(.*?)\*", r"\1", "*"), (r"_(.*?)_", r"\1", "_"))]
_AFTER = [(re.compile(p), by, k) for p, by, k in ((r"</?(?:ins|u|mark)>|~~|\$\$", "", "<~$"), (r"(?i)</?(?:s|del|strike)>", "", "<"), (SPAN, "", "<"), (r"(?i)<sup[^>]*>.*?</sup>|<sub[^>]*>.*?</sub>", "", "<"), ("[¹²³⁰⁴-⁹₀-₉]+", "", ""), (r"-{2,}", "-", "-"), (DOT_LEADER, "", "."))]


def _replace(t: str, steps: list[tuple[re.Pattern, str, str]]) -> str:
    """Each pattern's matches replaced; no pattern is looked for where nothing that begins it stands."""
    for pattern, by, needs in steps:
        if (any(c in t for c in needs) if needs else not t.isascii()):
            t = pattern.sub(by, t)
    return t


def _normalize(t: str) -> str:
    t = re.sub(r"\s+", " ", _replace(t, _BEFORE).translate(_QUOTES))
    t = strip_marks(_replace(t, _MARKS).replace("_", " ")).replace("…", "...").translate(_SAME)
    return _replace(t, _AFTER).lower()


_short = functools.lru_cache(50_000)(_normalize)


def normalize_py(text: str | None) -> str:
    """normalize() for any script; short texts, as of cells, are remembered."""
    t = text or ""
    return _short(t) if len(t) <= 200 else _normalize(t)


def nfc(t: str | None) -> str | None:
    """NFC form, for joins on file names."""
    return None if t is None else unicodedata.normalize("NFC", t)


def grounding_text(t: str | None) -> str | None:
    """NFKC, without zero-width characters, case-folded, white space collapsed."""
    zero = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    return None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(zero).casefold().split())


normalize_udf, nfc_udf, grounding_udf = arrow(normalize_py, "string"), arrow(nfc, "string"), arrow(grounding_text, "string")


def attribution_text(t: str | None) -> str:
    """Text for token attribution: tags, links and marks dropped, ligatures and accents folded, words broken at line ends joined."""
    t = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", t or "")
    t = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", t)
    t = re.sub(r"<[^>]+>", " ", t)
    t = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t)
    t = strip_marks(unicodedata.normalize("NFKC", t), keep_cjk=False)
    return " ".join(t.lower().split())


def attribution_tokens(text: Column) -> Column:
    """Tokens `[a-z0-9]+` of a text, without tags."""
    return F.regexp_extract_all(unaccent(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "))), F.lit("([a-z0-9]+)"), 1)


def words(text: Column, least: int = 2) -> Column:
    """Unicode words of at least `least` characters; scripts without spaces need words_udf."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), 1), lambda w: F.length(w) >= least)


def words_py(text: str, least: int = 2) -> list[str]:
    """Words, where runs of CJK letters are words of their own, of any length."""
    out = []
    for token in re.findall(r"\w+", text):
        if token.isascii():
            if len(token) >= least:
                out.append(token)
            continue
        for run in re.findall(r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]+|[^぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]+", token):
            if is_cjk(run[0]) or len(run) >= least:
                out.append(run)
    return out


words_udf = arrow(lambda t: words_py(t or ""), "array<string>")


SENTENCE_END = r"\n|(?<!\d)\.|\.(?!\d)|[!?。！？]"


def sentences(text: Column) -> Column:
    """Chunks between line breaks, periods that belong to no number, and other end marks; normalised, at least 7 characters."""
    chunks = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(normalize(s)))
    return F.filter(chunks, lambda s: F.length(s) >= 7)


def sentence_fragment(t: str) -> str:
    """A chunk without list marks, tags and outer punctuation; empty below 7 characters."""
    t = re.sub(r"\.(?:\s*\.)+", " ", normalize_py(t).strip().strip("."))
    t = re.sub(r"</?[^>]+>", " ", t)
    t = re.sub(r"^(?:\s*(?:#{1,6}\s+|>\s+|[*+-]\s+|\d+[.)]\s+))+", "", t).strip()
    t = re.sub(r"\s+", " ", re.sub(r"^[^\w]+|[^\w]+$", "", t)).strip()
    return t if len(t) >= 7 else ""


def sentences_py(text: str | None) -> list[str]:
    """Sentences where a chunk that is too short is carried into the next one."""
    merged, carry = [], ""
    for chunk in re.split(SENTENCE_END, re.sub(r"\.(?:\s*\.)+", " ", text or "")):
        if not (chunk := chunk.strip()):
            continue
        chunk = f"{carry} {chunk}" if carry else chunk
        carry = ""
        if sentence_fragment(chunk):
            merged.append(chunk)
        else:
            carry = chunk
    if carry:
        merged[-1:] = [f"{merged[-1]} {carry}" if merged else carry]
    return [s for s in map(sentence_fragment, merged) if s]


sentences_udf = arrow(sentences_py, "array<string>")


def digits(text: Column) -> Column:
    """How often each digit occurs outside tags, as an array of ten."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", "")
    return F.array(*(F.regexp_count(bare, F.lit(str(d))) for d in range(10)))


def html_text(html: Column) -> Column:
    """Text of an HTML page without scripts, styles and tags."""
    bare = replace_all(F.coalesce(html, F.lit("")), [(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " ")])
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def strip_fences(text: Column) -> Column:
    """Without fenced blocks of diagrams and descriptions."""
    return F.regexp_replace(text, r"(?ms)^```(?:mermaid|description)\b.*?^```[^\n]*$", "")


def strip_tables(text: Column) -> Column:
    """Without HTML tables, and a table that never ends."""
    return replace_all(text, [(r"(?is)<table\b.*?</table>", " "), (r"(?is)<table\b.*$", " ")])


def code_blocks(text: Column) -> Column:
    """(language, code) of each fenced block."""
    n = F.lit(r"(?ms)^```([^\n`]*)\n(.*?)^```")
    return F.arrays_zip(F.regexp_extract_all(text, n, 1).alias("language"), F.regexp_extract_all(text, n, 2).alias("code"))


def formulas(text: Column) -> Column:
    """Delimited formulas, without white space."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\$[^$\n]+?\$)"), 1)
    return F.transform(found, lambda f: replace_all(f, [(r"^(\$\$?|\\\[|\\\()|(\$\$?|\\\]|\\\))$", ""), (r"\s+", "")]))
