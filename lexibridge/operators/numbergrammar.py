"""The grammar of numbers: families in order of priority, each of which takes what the ones before it have left.

A text is a list of pieces, at first one. Every family splits the free pieces at its matches; a match becomes a piece of its own
that no later family sees, so places stay in order and nothing is counted twice. Values are texts in one form for both languages: plain
numbers without separators or trailing zeros, `RMB 140600`, `2024-03-05`, `FY2023`, `2/3`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibridge.operators.numbers import numeral_value
from lexibridge.operators.quality_rules import bag_difference

# Words and signs of the families.
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "百": 10**2, "千": 10**3, "万": 10**4, "亿": 10**8, "百万": 10**6, "千万": 10**7, "百亿": 10**10, "千亿": 10**11}
CURRENCIES = {"usd": "USD", "rmb": "RMB", "eur": "EUR", "美元": "USD", "欧元": "EUR", "元人民币": "RMB", "元": "RMB", "人民币": "RMB"}
UNITS = {"微克/立方米": "μg/m3", "微克/平方米": "μg/m2", "微克": "μg", "毫克": "mg", "千克": "kg", "平方千米": "square kilometers", "立方米": "cubic meters", "千米": "kilometers", "公里": "kilometers", "千瓦时": "kWh"}
ENGLISH_UNITS = r"μg/m[²2³3]?|mg/m[²2³3]?|μg|mg|kg|square\s+kilometers?|cubic\s+meters?|kilometers?|metres?|meters?|m[²2³3]|kWh"
DIRECTIONS = {"北纬": "N", "南纬": "S", "东经": "E", "西经": "W"}
MONTHS = "january february march april may june july august september october november december".split()
WORDS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
BIG_WORDS = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9}
ORDINALS = {w: n for n, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split(), 1)} | {w: 10 * n for n, w in enumerate("twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth hundredth".split(), 2)}
PARTS = {"half": 2, "halves": 2, "third": 3, "fourth": 4, "quarter": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10}
QUARTERS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "一": 1, "二": 2, "三": 3, "四": 4}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
ROMAN_SIGNS, RINGED = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
#: Signs of amounts and other forms of numerals, and their plain forms.
FORMAL, PLAIN = "壹贰叁肆伍陆柒捌玖拾佰仟〇双", "一二三四五六七八九十百千零二"

N = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
#: No ASCII letter or digit before or after; neighbouring Han characters do not matter.
OPEN, SHUT = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
_NUMERAL = "零〇一二三四五六七八九十百千万亿两双"
_SHORT_MONTHS = tuple(m[:3] for m in MONTHS)
_MONTH = "|".join(f"{m}|{m[:3]}" for m in MONTHS) + "|sept"


def _any(words: dict) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def _least(words: dict | list) -> tuple[str, ...]:
    """The words that hold no other one: a text without them has none at all."""
    return tuple(sorted(w for w in words if not any(x in w for x in words if x != w)))


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(str(x)) for pair in values.items() for x in pair])


def _look(values: dict, key: Column, missing: object = None) -> Column:
    found = F.element_at(_table(values), F.lower(key))
    return found if missing is None else F.coalesce(found, F.lit(str(missing)))


def plain(value: Column) -> Column:
    """A decimal as text without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def _decimal(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).cast("decimal(24,6)")


def _scaled(digits: Column, scale: Column) -> Column:
    return plain((_decimal(digits) * _look(SCALES, scale, 1).cast("decimal(12,0)")).cast("decimal(38,6)"))


def _two(digits: Column) -> Column:
    return F.lpad(digits, 2, "0")


def _numerals(c: Column) -> Column:
    """Numeral characters as a number: by units, or digit by digit where there are none."""
    usual = F.translate(c, FORMAL, PLAIN)
    return F.when(usual.rlike("[十百千万亿]"), numeral_value(usual).cast("long").cast("string")).otherwise(F.regexp_replace(F.translate(usual, "零一二三四五六七八九两", "01234567892"), "^0+(?=.)", ""))


def _roman(c: Column) -> Column:
    state = lambda total, last: F.struct(total.alias("total"), last.alias("last"))
    values = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    step = lambda s, x: state(s.total + F.when(x < s.last, -x).otherwise(x), x)
    each = F.reverse(F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda x: F.element_at(values, x)))
    return F.aggregate(each, state(F.lit(0), F.lit(0)), step, lambda s: s.total.cast("string"))


def _amount(c: Column) -> Column:
    """An amount in formal numerals with its parts of a unit."""
    money = lambda mark, exponent: F.coalesce(numeral_value(F.translate(F.regexp_extract(c, f"([{FORMAL}零]+){mark}", 1), FORMAL, PLAIN)), F.lit(0.0)).cast("decimal(24,6)") * F.lit(f"1e-{exponent}").cast("decimal(6,4)")
    whole = numeral_value(F.translate(F.regexp_extract(c, f"^[{FORMAL}零万亿]+(?![角分厘])", 0), FORMAL, PLAIN)).cast("decimal(24,6)")
    return plain((whole + money("角", 1) + money("分", 2) + money("厘", 3)).cast("decimal(38,6)"))


def _month(c: Column) -> Column:
    return _look({m[:3]: n for n, m in enumerate(MONTHS, 1)}, F.substring(c, 1, 3))


@dataclass(frozen=True)
class Family:
    """What a pattern finds, the value of a match from its groups (0 is the whole match), and words of which every match holds one,
    in small letters (none: not known)."""

    name: str
    pattern: str
    value: Callable[[Callable[[int], Column]], Column]
    needs: tuple[str, ...] = ()


FAMILIES = [
    Family("unit_line", rf"单位[：:]\s*({_any(SCALES)})?\s*({_any(CURRENCIES)})", lambda g: F.concat(_look(CURRENCIES, g(2)), F.lit(" "), _look(SCALES, g(1), 1)), ("单位",)),
    Family("unit_line_en", rf"(?i)unit[：:]\s*(USD|RMB|EUR)\s*{N}?(?:\s*(million|billion|thousand))?{SHUT}", lambda g: F.concat(F.upper(g(1)), F.lit(" "), _scaled(F.when(g(2) == "", "1").otherwise(g(2)), g(3))), ("unit",)),
    Family("points", rf"(?i){N}\s*(?:percentage\s+points?|个百分点)", lambda g: plain(_decimal(g(1))), ("percentage", "百分点")),
    Family("percent", rf"(?i){N}\s*(?:percent{SHUT}|[%％])", lambda g: plain(_decimal(g(1))), ("percent", "%", "％")),
    Family("money", rf"(?i){OPEN}(USD|RMB|EUR)\s*{N}(?:\s*(million|billion|thousand))?{SHUT}", lambda g: F.concat(F.upper(g(1)), F.lit(" "), _scaled(g(2), g(3))), ("usd", "rmb", "eur")),
    Family("money_cn", rf"{N}\s*(百万|千万|百亿|千亿|万|亿)?\s*(美元|欧元|元人民币|元|人民币)", lambda g: F.concat(_look(CURRENCIES, g(3)), F.lit(" "), _scaled(g(1), g(2))), ("元", "人民币")),
    Family("place", r"""([0-9]{1,3})°([0-9]{1,2})[′']([0-9]{1,2}(?:\.[0-9]+)?)[″"']{1,2}\s*([NSEWnsew])(?![A-Za-z0-9])""", lambda g: F.concat(g(1), F.lit("°"), g(2), F.lit("'"), g(3), F.lit("'' "), F.upper(g(4))), ("°",)),
    Family("place_cn", r"""(北纬|南纬|东经|西经)\s*([0-9]{1,3})°([0-9]{1,2})[′']([0-9]{1,2}(?:\.[0-9]+)?)[″"]""", lambda g: F.concat(g(2), F.lit("°"), g(3), F.lit("'"), g(4), F.lit("'' "), _look(DIRECTIONS, g(1))), ("°",)),
    Family("fiscal_year", rf"(?i){OPEN}fiscal\s+year\s+([0-9]{{4}}){SHUT}", lambda g: F.concat(F.lit("FY"), g(1)), ("fiscal",)),
    Family("fiscal_year_cn", r"([0-9]{4})\s*财年", lambda g: F.concat(F.lit("FY"), g(1)), ("财年",)),
    Family("decade_cn", r"([0-9]{2})世纪([0-9]{2})年代", lambda g: F.concat(((g(1).cast("int") - 1) * 100 + g(2).cast("int")).cast("string"), F.lit("s")), ("世纪",)),
    Family("century", rf"(?i){OPEN}(?:the\s+)?([0-9]{{1,2}})(?:st|nd|rd|th)\s+century{SHUT}|([0-9]{{1,2}})世纪(?![0-9年])", lambda g: F.concat(g(1), g(2), F.lit("th century")), ("century", "世纪")),
    Family("decade", rf"(?i){OPEN}(?:the\s+)?([0-9]{{4}})s{SHUT}", lambda g: F.concat(g(1), F.lit("s")), tuple(f"{d}s" for d in range(10))),
    Family("before_era", rf"(?i){OPEN}([0-9]+)\s*BC{SHUT}|公元前([0-9]+)年", lambda g: F.concat(g(1), g(2), F.lit(" BC")), ("bc", "公元前")),
    Family("era", rf"(?i){OPEN}AD\s*([0-9]+){SHUT}|公元([0-9]+)年", lambda g: F.concat(F.lit("AD "), g(1), g(2)), ("ad", "公元")),
    Family("quarter", rf"{OPEN}Q([1-4]){SHUT}", lambda g: g(0), ("q",)),
    Family("quarter_word", rf"(?i){OPEN}the\s+(first|second|third|fourth)\s+quarter{SHUT}|第([一二三四])\s*季度", lambda g: F.concat(F.lit("Q"), _look(QUARTERS, F.concat(g(1), g(2)))), ("quarter", "季度")),
    Family("years", r"(?<![A-Za-z0-9])([0-9]{4})\s*[–—-]\s*([0-9]{4})(?![0-9])年?", lambda g: F.concat(g(1), F.lit("-"), g(2)), ("–", "—", "-")),
    Family("date", r"(?<![0-9])([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})(?![0-9])", lambda g: F.concat_ws("-", g(1), _two(g(2)), _two(g(3))), ("/", "-")),
    Family("date_cn", r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", lambda g: F.concat_ws("-", g(1), _two(g(2)), _two(g(3))), ("年",)),
    Family("date_numerals", r"([一二][零〇一二三四五六七八九]{3})年(?:(十[一二]|[一二三四五六七八九十])月(?:(三十一?|二十[一二三四五六七八九]?|十[一二三四五六七八九]?|[一二三四五六七八九])日)?)?", lambda g: F.concat_ws("-", _numerals(g(1)), F.when(g(2) != "", _two(_numerals(g(2)))), F.when(g(3) != "", _two(_numerals(g(3))))), ("年",)),
    Family("date_en", rf"(?i){OPEN}({_MONTH})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}){SHUT}", lambda g: F.concat_ws("-", g(3), _two(_month(g(1))), _two(g(2))), _SHORT_MONTHS),
    Family("date_day_first", rf"(?i){OPEN}([0-9]{{1,2}})\s+({_MONTH})\.?\s+([0-9]{{4}}){SHUT}", lambda g: F.concat_ws("-", g(3), _two(_month(g(2))), _two(g(1))), _SHORT_MONTHS),
    Family("sum", r"([0-9]+)\s*\+\s*([0-9]+)", lambda g: F.concat(g(1), F.lit("+"), g(2)), ("+",)),
    Family("amount", f"[{FORMAL[:12]}][{FORMAL}零万亿]*(?:元[{FORMAL}零]*)?(?:角[{FORMAL}零]*)?(?:分[{FORMAL}零]*)?(?:厘)?", lambda g: _amount(g(0)), tuple(FORMAL[:12])),
    Family("unit_cn", rf"{N}\s*(百万|千万|百亿|千亿|[万亿])?\s*({_any(UNITS)})", lambda g: F.concat(_scaled(g(1), g(2)), F.lit(" "), _look(UNITS, g(3))), _least(UNITS)),
    Family("scaled_cn", rf"{N}\s*(百万|千万|百亿|千亿|[万亿百千](?![米克瓦升焦帕牛安伏欧赫兹]))", lambda g: _scaled(g(1), g(2)), ("百", "千", "万", "亿")),
    Family("unit", rf"(?i){N}\s*(?:(million|billion|thousand)\s+)?({ENGLISH_UNITS}){SHUT}", lambda g: F.concat(_scaled(g(1), g(2)), F.lit(" "), g(3)), ("g", "m", "kwh")),
    Family("grouped", r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?", lambda g: plain(_decimal(g(0))), (",",)),
    Family("subscript", rf"(?i){OPEN}(PM|CO|NO|SO|H|O|N|C|Fe|Ca|Na|K)([0-9]+(?:\.[0-9]+)?){SHUT}", lambda g: g(0)),
    Family("fraction", r"(?<![0-9.])([0-9]+)/([0-9]+)(?![0-9])", lambda g: g(0), ("/",)),
    Family("decimal", r"(?<![0-9])[0-9]+\.[0-9]+(?![0-9])", lambda g: g(0), (".",)),
    Family("large", r"(?<![0-9])[0-9]{5,}(?![0-9])", lambda g: g(0)),
    Family("ringed", f"[{RINGED}]", lambda g: F.position(g(0), F.lit(RINGED)).cast("string")),
    Family("phase", rf"{OPEN}Phase\s+([IVX]+|[1-9]){SHUT}", lambda g: F.concat(F.lit("Phase "), F.when(g(1).rlike("[0-9]"), g(1)).otherwise(_roman(g(1)))), ("phase",)),
    Family("phase_cn", r"([一二三四五六七八九十])\s*期(?![间末初内望])", lambda g: F.concat(F.lit("Phase "), _numerals(g(1))), ("期",)),
    Family("roman", rf"{OPEN}(?=[MDCLXVI]{{2}})M{{0,4}}(?:CM|CD|D?C{{0,3}})(?:XC|XL|L?X{{0,3}})(?:IX|IV|V?I{{0,3}}){SHUT}|{OPEN}(?=[mdclxvi]{{2}})m{{0,4}}(?:cm|cd|d?c{{0,3}})(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}}){SHUT}", lambda g: _roman(g(0))),
    Family("roman_label", r"(?:(?<=^)|(?<=[(（ \t\n]))[IVXLivxl](?=[)），,]|\.(?:[^A-Za-z]|$)|[ \t][A-Za-z]|$)", lambda g: _roman(g(0))),
    Family("roman_sign", f"[{ROMAN_SIGNS}{ROMAN_SIGNS.lower()}]", lambda g: F.position(F.upper(g(0)), F.lit(ROMAN_SIGNS)).cast("string")),
    Family("fraction_word", rf"(?i){OPEN}(one|two|three|four|five|six|seven|eight|nine|ten)[-\s]({_any(PARTS)})s?{SHUT}", lambda g: F.concat(_look(WORDS, g(1)), F.lit("/"), _look(PARTS, g(2))), _least(PARTS)),
    Family("fraction_cn", r"([一二三四五六七八九十百]+)分之([一二三四五六七八九十百]+)", lambda g: F.concat(_numerals(g(2)), F.lit("/"), _numerals(g(1))), ("分之",)),
    Family("half", "一半", lambda g: F.lit("1/2"), ("一半",)),
    Family("month", rf"(?i){OPEN}({_MONTH})\.?{SHUT}", lambda g: _month(g(1)), _SHORT_MONTHS),
    Family("ordinal", rf"(?i){OPEN}({_any(ORDINALS)}){SHUT}", lambda g: _look(ORDINALS, g(1)), _least(ORDINALS)),
    Family("ordinal_number", rf"(?i){OPEN}([0-9]+)(?:st|nd|rd|th){SHUT}", lambda g: g(1), ("st", "nd", "rd", "th")),
    Family("words_point", rf"(?i){OPEN}(zero|one|two|three|four|five|six|seven|eight|nine)\s+point((?:\s+(?:zero|one|two|three|four|five|six|seven|eight|nine))+){SHUT}", lambda g: F.concat(_look(WORDS, g(1)), F.lit("."), F.array_join(F.transform(F.split(F.trim(g(2)), r"\s+"), lambda w: _look(WORDS, w)), "")), ("point",)),
    Family("words_scaled", rf"(?i){OPEN}({_any(WORDS)})\s+({_any(BIG_WORDS)}){SHUT}", lambda g: (_look(WORDS, g(1)).cast("long") * _look(BIG_WORDS, g(2)).cast("long")).cast("string"), _least(BIG_WORDS)),
    Family("word", rf"(?i){OPEN}({_any(WORDS | BIG_WORDS)}){SHUT}", lambda g: _look(WORDS | BIG_WORDS, g(1)), _least(WORDS | BIG_WORDS)),
    Family("numerals", f"[{_NUMERAL}]*[{_NUMERAL[:12]}两双][{_NUMERAL}]*", lambda g: _numerals(g(0))),
    Family("integer", r"(?<![0-9])[0-9]{1,4}(?![0-9])", lambda g: g(0)),
    Family("scale", "[百千万亿]", lambda g: _look(SCALES, g(0)), ("百", "千", "万", "亿")),
]


#: What `$` of the families' patterns means: the end, or one line end before it.
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"


def _cut(text: str, families: list[tuple[tuple[str, ...], re.Pattern]]) -> list[tuple[str, int | None]]:
    """A text's pieces. A family is tried only on a text that holds one of its words."""
    pieces: list[tuple[str, int | None]] = [(text, None)]
    low = text.lower()
    for n, (needs, pattern) in enumerate(families):
        if needs and not any(w in low for w in needs):
            continue
        out = []
        for piece in pieces:
            free, at = piece[0], 0
            if piece[1] is None:
                for m in pattern.finditer(free):
                    out += [(free[at : m.start()], None), (m[0], n)]
                    at = m.end()
            out.append((free[at:], None) if at else piece)
        pieces = [p for p in out if p[0]] if len(out) > len(pieces) else pieces
    return pieces


def _pieces(families: list[Family]) -> Callable[[Column], Column]:
    known = [(f.needs, f.pattern.replace("$", _END)) for f in families]

    @F.arrow_udf("array<struct<text:string,family:int>>")
    def pieces(texts: pa.Array) -> pa.Array:
        # ASCII: blanks and small letters as the values' patterns have them.
        compiled = [(needs, re.compile(pattern, re.ASCII)) for needs, pattern in known]
        rows = [_cut(t or "", compiled) for t in texts.to_pylist()]
        flat = [p for row in rows for p in row]
        each = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.int32())], names=["text", "family"])
        return pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), each)

    return pieces


def with_pieces(rows: DataFrame, text: str, out: str, families: list[Family] = FAMILIES) -> DataFrame:
    """`rows` with array<struct<text, family>> of a text's pieces in order; family is the number of the family that took the piece, or null.

    A null text counts as empty, and an empty one is one free piece. The cuts run on Arrow batches: as nested functions of Spark they are interpreted, family by family and piece by piece.
    """
    return rows.withColumn(out, _pieces(families)(F.col(text)))


def with_numbers(rows: DataFrame, text: str, out: str, families: list[Family] = FAMILIES) -> DataFrame:
    """`rows` with array<struct<value, family>> of the numbers of a text in order, the family by name."""

    def value(p: Column, low: int, high: int) -> Column:
        """The value by the families from low to below high, halved until one is left."""
        if high - low == 1:
            return families[low].value(lambda i: F.regexp_extract(p.text, families[low].pattern, i))
        middle = (low + high) // 2
        return F.when(p.family < middle, value(p, low, middle)).otherwise(value(p, middle, high))

    names = F.array(*[F.lit(f.name) for f in families])
    cut = with_pieces(rows, text, out, families)
    return cut.withColumn(out, F.transform(F.filter(out, lambda p: p.family.isNotNull()), lambda p: F.struct(value(p, 0, len(families)).alias("value"), F.get(names, p.family).alias("family"))))


def grammar_differences(pairs: DataFrame) -> DataFrame:
    """`pairs` (source_text, target_text) with missing and extra values, and whether the same values stand in another order."""
    own = with_numbers(with_numbers(pairs, "source_text", "_s"), "target_text", "_t")
    own = own.withColumns({c: F.transform(c, lambda x: x.value) for c in ("_s", "_t")})
    held = own.withColumns({"missing": bag_difference(F.col("_s"), F.col("_t")), "extra": bag_difference(F.col("_t"), F.col("_s"))})
    return held.withColumn("reordered", (F.size("missing") == 0) & (F.size("extra") == 0) & (F.col("_s") != F.col("_t"))).drop("_s", "_t")
