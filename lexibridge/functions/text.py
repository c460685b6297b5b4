"""Text normalisation, hashing, counting and predicates as Column expressions.

All of them stay in the JVM. A null text counts as empty throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that define normalised text, match text and word counts.
INVISIBLE = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{200B}-\x{200D}\x{FEFF}]"
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BLANK = r"[ \t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts without a match are normalised but for their ends: no sign that may be a blank or invisible, no two blanks, none before a mark.
UNEVEN = r"[^ -~\x{00A1}-\x{167F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3001}-\x{FEFE}]| (?=[ 。！？!?.，,、；;：:）)\]}])"
ENDING_MARKS = r"[。！？!?.]+$"
TIGHT_MARKS = r"([。！？!?.，,、；;：:）)\]}])"
NON_CORE = r"[^\p{L}\p{N}_]+"
NUMBERING = r"^(?:[0-9]+[A-Za-z]?|[A-Za-z]|[ivxlcdmIVXLCDM]{1,4})$"
SOURCE_WORD = r"[A-Za-z0-9]+|[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}]"
EAST_ASIAN = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_text(c: Column | str) -> Column:
    """Invisible characters become blanks, runs of white space one blank, none before marks; trimmed."""
    text = _text(c)
    spaced = F.regexp_replace(F.regexp_replace(text, INVISIBLE, " "), BLANK + "+", " ")
    return F.trim(F.when(text.rlike(UNEVEN), F.regexp_replace(spaced, " +" + TIGHT_MARKS, "$1")).otherwise(text))


def normalize_lines(c: Column | str) -> Column:
    """Line feeds alone end lines, blanks within lines collapse, at most one empty line in a row."""
    unix = F.regexp_replace(_text(c), "\r\n?", "\n")
    spaced = F.regexp_replace(F.regexp_replace(unix, INVISIBLE, " "), LINE_BLANK + "+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, "\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def match_text(c: Column | str) -> Column:
    """Normalised text without its closing sentence marks."""
    return F.trim(F.regexp_replace(normalize_text(c), ENDING_MARKS, ""))


def match_or_normalized(c: Column | str) -> Column:
    """Match text, or the normalised text where that is empty."""
    return F.coalesce(F.nullif(match_text(c), F.lit("")), normalize_text(c))


def compact_core(c: Column | str) -> Column:
    """Letters, digits and underscores of the match text."""
    return F.regexp_replace(match_text(c), NON_CORE, "")


def source_hash(c: Column | str) -> Column:
    return F.sha2(normalize_text(c), 256)


def has_searchable_content(c: Column | str) -> Column:
    return match_text(c).rlike(r"[\p{L}\p{N}]")


def is_structural_fragment(c: Column | str) -> Column:
    """Numbering such as 12, 3b, IV, x: at most four characters of core."""
    core = compact_core(c)
    return (F.length(core) <= 4) & core.rlike(NUMBERING)


def source_words(c: Column | str) -> Column:
    """Runs of ASCII letters and digits, and single East Asian characters."""
    return F.regexp_count(_text(c), F.lit(SOURCE_WORD)).cast("long")


def length_band(length: Column) -> tuple[Column, Column]:
    """Lengths that a fuzzy match of a text of this length may have."""
    return F.greatest(F.lit(1), F.floor(length * 0.4) - 4).cast("long"), F.greatest(length + 12, F.floor(length * 2.2) + 12).cast("long")


def script_language(c: Column | str) -> Column:
    """struct(language, confidence) by script; nulls where no script decides.

    Kana, Hangul, Cyrillic, Arabic and Thai need three characters; Han needs four, and 18 % of the letters.
    """
    text = _text(c)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))

    def count(low: str, high: str) -> Column:
        return F.regexp_count(text, F.lit(rf"[\x{{{low}}}-\x{{{high}}}]"))

    def found(language: str, n: Column) -> Column:
        share = n / F.greatest(letters, F.lit(1))
        return F.struct(F.lit(language).alias("language"), F.round(F.least(F.lit(0.98), F.lit(0.66) + share * 0.3), 2).alias("confidence"))

    scripts = [("ja-JP", count("3040", "30FF")), ("ko-KR", count("AC00", "D7AF")), ("ru-RU", count("0400", "04FF")), ("ar-SA", count("0600", "06FF")), ("th-TH", count("0E00", "0E7F"))]
    han = count("4E00", "9FFF")
    out = F.when(letters == 0, F.lit(None))
    for language, n in scripts:
        out = out.when(n >= 3, found(language, n))
    return out.when((han >= 4) & (han / F.greatest(letters, F.lit(1)) >= 0.18), found("zh-CN", han))
