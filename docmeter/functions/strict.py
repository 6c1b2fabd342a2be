"""Strict comparison of an expected value with text read from a page: the first equivalence that holds decides, none is fuzzy.

String equivalences are pairs of a fold and a gate: both sides are folded, and equal results agree if the gate lets the pair through. Numbers, dates
and booleans have a comparison of their own, after which nothing else is tried. What does not agree gets a Jaro-Winkler similarity.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from . import kernels as K

# Placeholders, outer marks, suffixes of column heads, glyphs and letters with a plainer form, words and marks for yes and no.
EMPTY = re.compile(r"^[\s—–−\-]*$")
TRAILING = re.compile(r"[.,;:!?*†‡§°™®©•·\]\|/]+\s*$")
SUFFIX = re.compile(r"(?i)\s*(?:Monthly|Weekly|Annual|Quarterly|Daily|Bi-?Weekly|Semi-?Monthly|Hourly)\s*$")
GLYPHS = str.maketrans({"µ": "u", "μ": "u", "Μ": "M", "×": "x", "÷": "/", **dict(zip("¹²³⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "12304567890123456789", strict=True)), **dict.fromkeys("—–−‐‑‒", "-"), **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("‘’‚‛", "'")})
LOSSY = str.maketrans({"þ": "b", "Þ": "P", "ð": "d", "Ð": "D", "á": "a", "Á": "A", "é": "e", "É": "E", "í": "i", "Í": "I", "ó": "o", "Ó": "O", "ú": "u", "Ú": "U", "ý": "y", "Ý": "Y", "ö": "o", "Ö": "O", "æ": "ae", "Æ": "AE", "&": "8"})
NUMBER = re.compile(r"^[\s$€£¥]*([-+]?)[\s$€£¥]*(\(?)\s*(\d{1,3}(?:[, ]\d{3})*(?:\.\d+)?|\.\d+|\d+(?:\.\d+)?)\s*(\)?)\s*[$€£¥%]*\s*$")
GROUPS = re.compile(r"^\d+(?: \d+)* \d{2}$")
ISO = re.compile(r"^\d{4}-\d{2}-\d{2}$")
YES = {"true", "yes", "y", "1", "x", "✓", "✗", "✘", "☒", "[x]", "checked"}
NO = {"false", "no", "n", "0", "", "[ ]", "☐", "unchecked"}
NOISE, LEAST, DIGITS = 4, 10, 4
DAY_FORMS = ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%d-%m-%y")
MONTH_FORMS = ("%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y", "%m/%d/%y", "%m-%d-%y")
NAMED_FORMS = ("%Y-%m-%d", "%Y/%m/%d", "%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%A %B %d %Y", "%a %b %d %Y", "%B %dth %Y", "%Y %B %d")


@dataclass(frozen=True)
class Verdict:
    verified: bool
    how: str
    similarity: float | None = None


def one_space(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def bare(text: str) -> str:
    return TRAILING.sub("", text).rstrip()


def glyphs(text: str) -> str:
    return bare(unicodedata.normalize("NFKC", text).translate(GLYPHS))


def no_suffix(text: str) -> str:
    return SUFFIX.sub("", text).rstrip()


def alnum(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]+", "", text).casefold()


def number(text) -> float | None:
    """Currency, signs, brackets, thousands; runs of digits whose last has two are money without its marks."""
    if isinstance(text, bool):
        return None
    if isinstance(text, (int, float)):
        return float(text)
    t = bare(str(text))
    if m := NUMBER.match(t):
        x = float(re.sub("[, ]", "", m[3]))
        return -x if m[1] == "-" or m[2] and m[4] else x
    t = t.strip().replace(",", "")
    return float(f"{''.join(t.split()[:-1])}.{t.split()[-1]}") if GROUPS.match(t) else None


def dates(text: str) -> set[date]:
    """All days that a text can mean: with the day or the month first."""
    t, out = re.sub(r"\s+", " ", text.replace(",", " ").replace(". ", " ")).strip(), set()
    for f in (*NAMED_FORMS, *DAY_FORMS, *MONTH_FORMS):
        try:
            out.add(datetime.strptime(t, f).date())
        except ValueError:
            continue
    return out


def truth(text: str, guess: bool = False) -> bool | None:
    """guess: a text of up to NOISE characters that says neither is an empty box."""
    forms = {text, text.casefold(), re.sub(r"[^\w]", "", text).casefold()}
    if forms & YES and (re.sub(r"[^\w]", "", text) or text in YES):
        return True
    return False if forms & NO or guess and len(text) <= NOISE else None


Fold = Callable[[str], str]
#: Name, fold, and when equal folds agree: e and x are the whole texts, a and b the folds, ocr says that the text was read from an image.
FOLDS: list[tuple[str, Fold, Callable[[str, str, str, str, bool], bool]]] = [
    ("case_insensitive", str, lambda e, x, a, b, ocr: True),
    ("trailing_punct_fold", bare, lambda e, x, a, b, ocr: bool(a)),
    ("unicode_compat_fold", glyphs, lambda e, x, a, b, ocr: bool(a) and (a != e or b != x)),
    ("footer_text_trim", no_suffix, lambda e, x, a, b, ocr: bool(a) and (a != e or b != x)),
]
LATER: list[tuple[str, Fold, Callable[[str, str, str, str, bool], bool]]] = [
    ("ocr_punctuation_fold", alnum, lambda e, x, a, b, ocr: ocr and bool(a)),
    ("alnum_text_fold", alnum, lambda e, x, a, b, ocr: len(a) >= 8 and sum(c.isdigit() for c in a) >= DIGITS),
    ("icelandic_diacritic_fold", lambda t: t.translate(LOSSY), lambda e, x, a, b, ocr: ocr and bool(a)),
]


def compare(expected, kind: str, text: str, *, ocr: bool = False) -> Verdict:
    """kind: string, number, date or boolean."""
    x = one_space(text or "")
    e = "" if expected is None else one_space(str(expected))
    if EMPTY.match(e) and EMPTY.match(x):
        return Verdict(True, "null_empty")
    if expected is None:
        return Verdict(False, "none")
    if e == x:
        return Verdict(True, "identity")

    def folded(rules) -> Verdict | None:
        for name, fold, gate in rules:
            a, b = fold(e), fold(x)
            if a.casefold() == b.casefold() and gate(e, x, a, b, ocr):
                return Verdict(True, name)
        return None

    def failed() -> Verdict:
        if kind not in ("string", "number") or not e:
            return Verdict(False, "none")
        a, b = (re.sub(r"[\s,$€£¥%()]+", "", t) if kind == "number" else t for t in (e, x))
        return Verdict(False, "none", K.jaro_winkler(a.casefold(), b.casefold()) if a and b else float(a == b))

    if kind == "string" and (v := folded(FOLDS)):
        return v
    if kind == "number" or isinstance(expected, (int, float)) and not isinstance(expected, bool):
        a, b = number(expected), number(x)
        return Verdict(True, "numeric") if a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6) else failed()
    if kind in ("string", "date") and ISO.match(e):
        return Verdict(True, "date") if dates(e) & dates(x) else failed()
    if kind == "boolean":
        a, b = expected if isinstance(expected, bool) else truth(e), truth(x, guess=True)
        return Verdict(True, "boolean") if a is not None and a == b else Verdict(False, "none")
    if kind == "string":
        if v := folded(LATER):
            return v
        a, b = alnum(e), alnum(x)
        if len(a) >= LEAST and len(b) > len(a) and b.startswith(a):
            return Verdict(True, "annotation_truncated")
        if len(a) >= LEAST and 1 <= len(b) - len(a) <= 2 and b.endswith(a):
            return Verdict(True, "ocr_noise_prefix")
    return failed()


def partial(expected: str, text: str) -> bool:
    """The text is a fragment of the value, at most three quarters of it: a diagnosis, no match."""
    a, b = alnum(expected), alnum(text)
    return len(b) >= 2 and b in a and len(b) <= int(0.75 * len(a))
