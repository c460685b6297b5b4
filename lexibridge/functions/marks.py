"""Quotation marks and automatic numbering as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexibridge.functions.text import normalize_text
from lexibridge.operators.numbers import numeral_value

# The marks by kind, and the signs and labels of numbering.
DOUBLE = {"half": '"', "full": "＂", "left": "“", "right": "”"}
SINGLE = {"half": "'", "full": "＇", "left": "‘", "right": "’"}
NUMERALS = "零〇一二三四五六七八九十百千万两壹贰叁肆伍陆柒捌玖拾佰仟"
FORMAL, PLAIN = "壹贰叁肆伍陆柒捌玖拾佰仟", "一二三四五六七八九十百千"
LABELS = {"章": "Chapter", "节": "Section", "条": "Article", "款": "Clause"}
SEPARATORS = "[:：\\-–—]"
TIGHT = "[、。．.)）\\]】]$"
BEFORE_TEXT = [
    r"[(（]\s*\d+(?:\.\d+)*\s*[)）]",
    r"\d+(?:\.\d+)*[.)、]?",
    r"[A-Za-z][.)、]?",
    r"(?i:[ivxlcdm]+[.)、])",
    r"(?i:(?:chapter|section|article|clause)\s+\d+[.)]?)",
    rf"(?=.*[0-9{NUMERALS}])(?=.*[.．。)、）\]】\-第章节条款]).*",
]
#: What stands before a text counts as numbering, if it is one of these and of at most 40 characters.
NUMBERING = rf"^(?=.{{1,40}}$)(?:{'|'.join(BEFORE_TEXT)})$"
#: Numbering with a number, and how a translation may write it; # is the number.
WRITTEN = [
    *((rf"^第\s*[0-9{NUMERALS}]+\s*{sign}$", f"{label} #") for sign, label in LABELS.items()),
    (rf"^[0-9{NUMERALS}]+\s*[、．。.]$", "#."),
    (rf"^[（(]\s*[0-9{NUMERALS}]+\s*[)）]$", "(#)"),
]
#: Signs that a translation may write otherwise, each kind by itself.
NARROWED = {"、": ".", "．。": "..", "（）": "()"}


def quotes(c: Column | str, target: str = "curly", width: str = "all", shape: str = "all", target_width: str = "half", curly_is_half: bool = False) -> Column:
    """The text with its quotation marks converted to `target`: curly, or straight of `target_width`.

    width (all, half, full) and shape (all, straight, curly) say which marks are converted; curly marks count as
    half or full as `curly_is_half` says. A straight mark opens where the last mark of its kind closed, or where there
    was none; curly marks that stay take part in that, straight ones that stay do not.
    """
    out = F.col(c) if isinstance(c, str) else c
    widths = [w for w in ("half", "full") if width in ("all", w) and shape in ("all", "straight")]
    curly = shape in ("all", "curly") and (width == "all" or (width == "half") == curly_is_half)
    for kind in (DOUBLE, SINGLE):
        left, right = kind["left"], kind["right"]
        straight = "".join(kind[w] for w in widths)
        if target == "straight":
            found = straight + (left + right if curly else "")
            out = F.translate(out, found, kind[target_width] * len(found)) if found else out
        elif straight:
            between = f"([^{straight}{left}{right}]*)"
            # The mark after an opening one closes; then pairs; what is left over opens.
            out = F.regexp_replace(out, f"{left}{between}[{straight}]", f"{left}$1{right}")
            out = F.regexp_replace(out, f"[{straight}]{between}[{straight}]", f"{left}$1{right}")
            out = F.regexp_replace(out, f"[{straight}]", left)
    return out


def numbering_prefix(display: Column, source: Column) -> Column:
    """What a displayed text has before its source, if that looks like numbering; else null."""
    shown, own = normalize_text(display), normalize_text(source)
    before = F.rtrim(F.left(shown, F.length(shown) - F.length(own)))
    return F.when((own != "") & F.endswith(shown, own), F.nullif(F.regexp_extract(before, NUMBERING, 0), F.lit("")))


def written_forms(numbering: Column) -> Column:
    """A numbering as it is and as a translation may write it; null entries where a form does not apply."""
    token = F.regexp_extract(numbering, f"[0-9{NUMERALS}]+", 0)
    number = F.when(token.rlike(r"^\d+$"), token.cast("long")).when(~token.rlike(r"\d"), numeral_value(F.translate(token, FORMAL, PLAIN)).cast("long")).cast("string")
    return F.array(
        numbering,
        *[F.when(numbering.rlike(looks), F.replace(F.lit(form), F.lit("#"), number)) for looks, form in WRITTEN],
        *[F.translate(numbering, signs, narrow) for signs, narrow in NARROWED.items()],
    )


def opening(form: Column) -> Column:
    """The pattern of a text that opens with a form of numbering: up to a separator, blanks, or where the form itself ends the number."""
    literal = F.replace(F.regexp_replace(form, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(" "), F.lit(r"\s+"))
    closed = F.when(form.rlike(rf"{TIGHT}|第\s*.+[章节条款]$"), r"|(?!(?<=\.)\d)").otherwise("")
    return F.concat(F.lit(r"(?i)^\s*"), literal, F.lit(rf"(?:{SEPARATORS}\s*|\s+"), closed, F.lit(")"))


def without_numbering(text: Column, source: Column, display: Column, numbering: Column) -> Column:
    """A translation without the automatic numbering that its source is displayed with.

    The first form that the text opens with is taken off, if text remains: of the numbering itself, then of the one that
    `display` shows before `source`, each as it is or as a translation may write it (第三章: Chapter 3). A null text is empty.
    """
    text = F.coalesce(text, F.lit(""))
    known = F.array(F.nullif(normalize_text(numbering), F.lit("")), numbering_prefix(display, source))
    patterns = F.array_distinct(F.transform(F.array_compact(F.flatten(F.transform(F.array_compact(known), written_forms))), opening))
    left = F.filter(F.transform(patterns, lambda p: F.when(F.rlike(text, p), F.regexp_replace(text, p, F.lit("")))), lambda rest: normalize_text(rest) != "")
    return F.coalesce(F.get(left, F.lit(0)), text)
