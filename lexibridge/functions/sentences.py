"""Sentences of a text as a Column expression: rules for dots, line breaks and headings, all in the JVM.

A dot is marked as part of a word or as an end by one rule after the other, the first rule that
speaks of it decides; then the text is cut after its ends. Nothing is looked at twice and no row leaves
the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexibridge.functions import text as T

# Ends of sentences, marks that may follow them, and the words by which dots are judged.
ENDINGS = "。？?!.！"
CLOSERS = "\"'”’】》〉』）)]}"
ABBREVIATIONS = "mr mrs ms dr prof sr jr vs etc inc ltd co corp st ave blvd rd dept gov gen col lt sgt rev hon pres pp vol no fig ed eds trans approx art sec cl para subpara sch app ex ref refs e.g i.e cf al et".split()
CONTINUATIONS = "administration agency agreement association bank bureau company corporation department government group holdings law limited ministry office patent regulation securities treasury".split()
STARTERS = "a an the this that these those it he she they we you however therefore accordingly meanwhile next then".split()

#: Private characters: a dot within a sentence, a dot that ends one, a cut.
INNER, FINAL, CUT = "", "", ""
_WORD = rf"[\p{{L}}\p{{N}}.{INNER}{FINAL}]"
_START = rf"(?<!{_WORD})"
_LAST = r"(?=\s*\z)"


def _next(words: list[str]) -> str:
    return rf"(?=\s*(?:{'|'.join(words)})(?![A-Za-z]))"


_ABBREVIATION = rf"(?i){_START}({'|'.join(a.replace('.', '[.]') for a in sorted(ABBREVIATIONS, key=len, reverse=True))})\."
_INITIALS = rf"{_START}((?:[A-Za-z][.{INNER}])+[A-Za-z])\."
#: In every text that `_INITIALS` matches.
_LATER_INITIAL = rf"[.{INNER}][A-Za-z]\."

#: Patterns of dots in the order of the rules; group 1 stands before the dot, the mark takes its place.
DOTS = [
    (r"\.(?<=\p{Nd}\.)(?=\p{Nd})", INNER, False),
    (rf"(?m)^([^\S\n]*{_WORD}*\p{{Nd}})\.(?=\s*\S)", INNER, True),
    (r"\.(?<=\p{Nd}\.)", FINAL, False),
    (_ABBREVIATION + _LAST, FINAL, True),
    (_ABBREVIATION + _next([w for w in STARTERS if w not in ("a", "an")]), FINAL, True),
    (_ABBREVIATION, INNER, True),
    (rf"(?=[A-Z]\.){_START}([A-Z])\.", INNER, True),
    (_INITIALS + r"(?=\p{L}\.)", INNER, True),
    (_INITIALS + _LAST, FINAL, True),
    (_INITIALS + r"(?=\s*[(\[（【])", INNER, True),
    (_INITIALS + r"(?=\s*[-–—])", FINAL, True),
    ("(?i)" + _INITIALS + _next(CONTINUATIONS), INNER, True),
    (_INITIALS + r"(?=\s*[\p{Lu}\x{3400}-\x{9FFF}])", FINAL, True),
    (_INITIALS, INNER, True),
    (rf"(?i)(?=[ivxlcdm]+\.){_START}([ivxlcdm]+)\.", INNER, True),
    (r"()\.(?=[A-Za-z0-9])", INNER, False),
    (r"()\.(?=\s+\p{Ll})", INNER, False),
]
#: A line that is a numbered heading: a sentence by itself.
HEADING = r"(?m)^(?=.{1,180}$)([^\S\n]*(?:[0-9]+(?:[." + INNER + r"][0-9]+){0,5}|[A-Z])[.)" + INNER + r"]?[^\S\n]+(?:\S+[^\S\n]+){0,23}\S*[^\s.?!。？！;；" + FINAL + r"][^\S\n]*)$"


def sentences(c: Column | str) -> Column:
    """Normalised sentences of a text in order. One line feed alone does not end a sentence, two do, and a
    numbered heading stands by itself; a null or blank text has none."""

    def marked(s: Column, rules: list) -> Column:
        for pattern, mark, keeps in rules:
            s = F.regexp_replace(s, pattern, ("$1" if keeps else "") + mark)
        return s

    # Few texts have initials; the others are not gone through for them.
    own = [i for i, rule in enumerate(DOTS) if _INITIALS in rule[0]]
    before = F.array(marked(T.normalize_lines(c), DOTS[: own[0]]))
    s = F.transform(before, lambda x: F.when(x.rlike(_LATER_INITIAL), marked(x, DOTS[own[0] : own[-1] + 1])).otherwise(x))[0]
    s = marked(s, DOTS[own[-1] + 1 :])
    s = F.regexp_replace(s, HEADING, f"{CUT}$1{CUT}")
    closers = "".join("\\" + x for x in CLOSERS)
    s = F.regexp_replace(s, rf"([{ENDINGS}{FINAL}][{ENDINGS}{FINAL}{INNER}]*[{closers}]*)", f"$1{CUT}")
    parts = F.split(F.translate(s, INNER + FINAL, ".."), rf"{CUT}|\n\s*\n")
    return F.filter(F.transform(parts, T.normalize_text), lambda x: x != "")


# Fixed values of the simpler rules for single formats.
SIMPLE_ENDINGS = "。？！!?"
SIMPLE_CLOSERS = "\"'》】）)]」』"
SIMPLE_ABBREVIATIONS = "mr mrs ms dr prof sr jr vs etc inc ltd co st ave blvd rd apt no vol pp ed eds trans fig figs approx dept est govt intl natl univ e.g i.e cf al et".split()

_BLANK = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
#: Letters and dots in a row. Of its dots only the last can end a sentence: what follows the others is no blank.
_RUN = r"[\p{L}.]"
_ENDS = rf"{_RUN}++(?<=\.)(?=[ \n\r\t]|\z)"
_SHORT = rf"(?i:{'|'.join(a.replace('.', '[.]') for a in SIMPLE_ABBREVIATIONS)})\.+(?!{_RUN})"
_COUNT = r"\p{Nd}++" + _BLANK + r"*+\.(?=[ \n\r\t])"
#: One sentence from where the last one stopped, with all blanks: what leads it, what runs through, what ends it.
SIMPLE = (
    rf"(?:{_BLANK}*+(?:\p{{Nd}}++|[A-Za-z]|[ivxIVX]++)\.(?!{_RUN})|{_COUNT})?+"
    rf"(?:{_BLANK}++|(?<={_BLANK}){_COUNT}|{_SHORT}|(?!{_ENDS}){_RUN}++|[^\s\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}\p{{L}}.{SIMPLE_ENDINGS}]++)*+"
    rf"(?:(?:{_ENDS}|[{SIMPLE_ENDINGS}])[{SIMPLE_ENDINGS}.]*+[{''.join(chr(92) + c for c in SIMPLE_CLOSERS)}]*+|\z)"
)


def simple_sentences(c: Column | str) -> Column:
    """The text cut into sentences by the simpler rules, which know no headings or line feeds; joined they are the text.

    A full-width mark, ! or ? ends a sentence, with the marks and closing signs after it. A dot does before a blank or at the text's
    end, unless it follows an abbreviation, a number standing alone, or the number or letter that the sentence begins
    with. Digits are decimal ones. Null or empty texts have no sentence.
    """
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.filter(F.regexp_extract_all(text, F.lit(SIMPLE), F.lit(0)), lambda s: s != "")
