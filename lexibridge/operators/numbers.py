"""Numbers of texts, brought to one form, and how two texts' numbers differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibridge.operators.quality_rules import bag_difference, bound

# Words and signs after a number that multiply it, and numeral characters.
MULTIPLIERS = {"百": 1e2, "千": 1e3, "万": 1e4, "亿": 1e8, "hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12, "%": 1e-2, "％": 1e-2, "percent": 1e-2}
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
SECTIONS = {"万": 10_000, "亿": 100_000_000}
WORDS = "|".join(sorted(MULTIPLIERS, key=len, reverse=True))
#: A number in digits with its multiplier, or a run of numeral characters of which one is a unit.
NUMBER = rf"[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?\s*(?i:{WORDS})?|[零〇一二两三四五六七八九十百千万亿]*[十百千万亿][零〇一二两三四五六七八九十百千万亿]*"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def numeral_value(c: Column) -> Column:
    """Value of numeral characters such as 一千二百零三万: digits by units, units by sections."""
    state = lambda total, section, digit: F.struct(total.alias("total"), section.alias("section"), digit.alias("digit"))
    digits, units, sections = _map(DIGITS), _map(UNITS), _map(SECTIONS)

    def step(s: Column, x: Column) -> Column:
        unit, part = F.element_at(units, x), F.element_at(sections, x)
        # A unit without a digit before it counts once, as in 十二.
        once = F.when((s["digit"] == 0) & (s["section"] == 0) & (x == "十"), 1.0).otherwise(s["digit"])
        whole = s["total"] + s["section"] + s["digit"]
        by_section = F.when(part == 1e8, state(whole * part, F.lit(0.0), F.lit(0.0))).otherwise(state(s["total"] + (s["section"] + s["digit"]) * part, F.lit(0.0), F.lit(0.0)))
        return F.when(unit.isNotNull(), state(s["total"], s["section"] + once * unit, F.lit(0.0))).when(part.isNotNull(), by_section).otherwise(state(s["total"], s["section"], F.element_at(digits, x)))

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda s: s["total"] + s["section"] + s["digit"])


def numbers(c: Column | str) -> Column:
    """Values of all numbers of a text in order: digits with separators, times their multiplier (percent a hundredth), and numerals."""
    found = F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(f"({NUMBER})"), 1)
    factors = _map(MULTIPLIERS)

    def value(x: Column) -> Column:
        digits = F.replace(F.regexp_extract(x, r"^[0-9,]+(?:\.[0-9]+)?", 0), F.lit(","), F.lit("")).cast("double")
        word = F.lower(F.regexp_extract(x, rf"(?i)({WORDS})$", 1))
        return F.when(x.rlike("^[0-9]"), F.round(digits * F.coalesce(F.element_at(factors, word), F.lit(1.0)), 6)).otherwise(numeral_value(x))

    return F.transform(found, value)


def _compared() -> Column:
    """struct(missing, extra, reordered) of source_text and target_text, whose numbers are read once."""
    both = lambda p: F.struct(bag_difference(p.s, p.t).alias("missing"), bag_difference(p.t, p.s).alias("extra"), (p.s != p.t).alias("unlike"))
    judged = lambda d: F.struct(d.missing.alias("missing"), d.extra.alias("extra"), ((F.size(d.missing) == 0) & (F.size(d.extra) == 0) & d.unlike).alias("reordered"))
    return bound({"d": bound({"s": numbers("source_text"), "t": numbers("target_text")}, both)}, lambda p: judged(p.d))


def number_differences(pairs: DataFrame) -> DataFrame:
    """`pairs` (source_text, target_text) with missing, extra (values beyond the other side's) and reordered:
    whether both sides have the same numbers in another order."""
    return pairs.withColumn("_d", _compared()).select(*pairs.columns, "_d.*")


def number_report(pairs: DataFrame) -> DataFrame:
    """The segments with a target whose numbers differ."""
    odd = lambda d: (F.size(d.missing) > 0) | (F.size(d.extra) > 0) | d.reordered
    given = pairs.where(F.coalesce(F.trim("target_text"), F.lit("")) != "")
    # Chosen as elements: a condition on the columns would be worked out before them, with all that they are made of.
    return given.select(*pairs.columns, F.explode(F.filter(F.array(_compared()), odd)).alias("_d")).select(*pairs.columns, "_d.*")
