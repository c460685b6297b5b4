"""Rule-based checks of bilingual segments.

A rule is a Column over source_text and target_text that yields an array of findings,
struct(offset, length, detail); an empty array is no finding. `issues` applies any set of
rules in one pass and explodes their findings, so that many rules cost one scan. Only the
rules that keep a stack of open marks run in Python, on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("detail", T.StringType())]))

# Token patterns, mark classes and pairs that the rules compare.
NUMBER = r"([0-9]+(?:[.,][0-9]+)+|[0-9]+)"
PARAMETER = r"(\{[A-Za-z0-9_][\w.\-]*\}|%\([\w.]+\)[sdifxoefgc]|%[-+#0 ]?[0-9]*(?:\.[0-9]+)?[sdifxoefgcp])"
EMAIL = r"([\w.%+\-]+@[\w.\-]+\.[A-Za-z]{2,})"
LINK = r"((?:https?://|www\.)[^\s<>\"'　、。，！？]+)"
SYMBOL = "([$©®™§¶¢-¥₠-⃏])"
ENDINGS = {".": ".", "。": ".", "!": "!", "！": "!", "?": "?", "？": "?", "…": "…", "‥": "…", ";": ";", "；": ";", ":": ":", "：": ":"}
PAIRS = [("(（", ")）"), ("[【", "]】"), ("{", "}"), ("《〈", "》〉"), ("「『", "」』"), ("“„", "”"), ("‘", "’")]


def _none() -> Column:
    return F.array().cast(FINDING)


def _one(when: Column, offset: Column | int = 0, length: Column | int = 0, detail: Column | str = "") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(lit(offset).cast("int").alias("offset"), lit(length).cast("int").alias("length"), lit(detail).cast("string").alias("detail")))).otherwise(_none())


def _located(c: str, pattern: str) -> Column:
    """Findings for every match of a pattern in a text, with their places: what lies between the matches tells how far each is from the start."""
    whole = f"({pattern})"
    found, between = F.regexp_extract_all(c, F.lit(whole), F.lit(1)), F.split(c, whole, -1)
    finding = lambda at, x: F.struct(at.cast("int").alias("offset"), F.length(x).cast("int").alias("length"), x.alias("detail"))
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        at = s.at + F.length(x.free)
        return state(at + F.length(x.hit), F.concat(s.out, F.array(finding(at, x.hit))))

    pairs = F.filter(F.zip_with(between, found, lambda free, hit: F.struct(free.alias("free"), hit.alias("hit"))), lambda x: x.hit.isNotNull())
    return F.when(F.col(c).rlike(whole), F.aggregate(pairs, state(F.lit(0), _none()), step, lambda s: s.out)).otherwise(_none())


def _runs(pattern: str) -> Column:
    return _located("target_text", pattern)


def _first_of(odd: Column) -> Column:
    """Findings for words of the target, each at its first place: after what stands before the first such run of letters."""
    before = lambda x: F.split("target_text", F.concat(F.lit("(?<![A-Za-z])"), x, F.lit("(?![A-Za-z])")), 2)[0]
    return F.transform(odd, lambda x: F.struct(F.length(before(x)).cast("int").alias("offset"), F.length(x).cast("int").alias("length"), x.alias("detail"))).cast(FINDING)


def tokens(c: str, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 1)


def bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """`use` of a struct of values that are worked out once: within a function of elements they would be worked out for each of them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use)[0]


def bag_difference(a: Column, b: Column) -> Column:
    """Elements of `a` beyond their number in `b`, sorted, one for each excess copy."""
    count = lambda xs, x: F.size(xs) - F.size(F.array_remove(xs, x))
    extra = lambda p: F.flatten(F.transform(F.array_distinct(p.a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), count(p.a, x) - count(p.b, x)))))
    # Most pairs agree: then nothing is counted.
    return bound({"a": F.sort_array(a), "b": F.sort_array(b)}, lambda p: F.when(p.a == p.b, F.slice(p.a, 1, 0)).otherwise(extra(p)))


def _mismatch(pattern: str) -> Column:
    s, t = tokens("source_text", pattern), tokens("target_text", pattern)
    name = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(0).alias("offset"), F.length(x).cast("int").alias("length"), F.concat(F.lit(kind), x).alias("detail")))
    return F.concat(name("missing ", bag_difference(s, t)), name("extra ", bag_difference(t, s))).cast(FINDING)


def _words(c: str) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9]+|[一-鿿]")).cast("double")


def _ending(c: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in ENDINGS.items() for x in p]), F.right(F.rtrim(c), F.lit(1)))


def _tag_count(c: str, tag: str) -> Column:
    return F.regexp_count(F.lower(c), F.lit(rf"<{tag}\b[^>]*>"))


FORMAT_TAGS = ("b", "i", "u", "sub", "sup", "strong", "em")


def _tags_missing() -> Column:
    lost = [F.when(_tag_count("source_text", t) > _tag_count("target_text", t), F.lit(t)) for t in FORMAT_TAGS]
    kept = F.filter(F.array(*lost), lambda x: x.isNotNull())
    return F.transform(kept, lambda x: F.struct(F.lit(0).alias("offset"), F.lit(0).alias("length"), x.alias("detail"))).cast(FINDING)


def _word_case() -> Column:
    """Words of the target that differ from a source word in case alone."""
    s, t = tokens("source_text", "([A-Za-z]+)"), tokens("target_text", "([A-Za-z]+)")
    words = {"low": F.transform(F.array_distinct(s), lambda x: F.lower(x)), "other": F.array_except(t, s)}
    return _first_of(F.sort_array(bound(words, lambda p: F.filter(p.other, lambda x: F.array_contains(p.low, F.lower(x))))))


def _camel() -> Column:
    s = tokens("source_text", "([A-Za-z]+)")
    return _first_of(F.sort_array(F.array_except(F.filter(tokens("target_text", "([A-Za-z]+)"), lambda x: x.rlike("^[A-Z][a-z]+[A-Z]")), s)))


PLACEHOLDER = "⟦((?:MATH|LB)_[0-9]+)⟧"


def _placeholders_missing() -> Column:
    """Placeholders that the target has fewer of than the source, once each."""
    lost = F.array_distinct(bag_difference(tokens("source_text", PLACEHOLDER), tokens("target_text", PLACEHOLDER)))
    return F.transform(lost, lambda x: F.struct(F.greatest(F.length(F.rtrim("target_text")) - 1, F.lit(0)).cast("int").alias("offset"), F.lit(1).alias("length"), x.alias("detail"))).cast(FINDING)


def rules(threshold: float = 50.0, french: bool = False) -> dict[str, Column]:
    """Every rule that built-in functions express. threshold: percent for the word count rules. french: whether the rows
    have a target_language, of which French asks for a space before high marks."""
    s, t = F.col("source_text"), F.col("target_text")
    sw, tw = _words("source_text"), _words("target_text")
    first = lambda c: F.regexp_extract(c, "([A-Za-z])", 1)
    both = (sw > 0) & (tw > 0)
    return {
        "target_without_tag": _one(s.rlike("<[a-zA-Z/][^>]*>") & ~t.rlike("<[a-zA-Z/][^>]*>")),
        "target_tag_missing": _tags_missing(),
        "ending_punctuation_mismatch": _one(_ending("source_text").isNotNull() & ~_ending("source_text").eqNullSafe(_ending("target_text")), F.length(F.rtrim(t)) - 1, 1, F.right(F.rtrim(t), F.lit(1))),
        "target_placeholder_missing": _placeholders_missing(),
        "punctuation_leading_missing_space": F.when(F.lower(F.coalesce(F.col("target_language"), F.lit(""))).rlike("^fr"), _runs(r"[^\s\x{00A0}\x{202F}«:;!?/][!?;:](?!//)")).otherwise(_none()) if french else _none(),
        "repeated_punctuation": F.filter(_runs(r"([.,;:!?、，。；：！？])\2+"), lambda x: x["detail"] != "..."),
        "extra_space_after_punctuation": _runs("[,;:!?.] {2,}|[，。；：！？、] +"),
        "missing_space_after_punctuation": _runs("[,;:!?][A-Za-z]"),
        "space_before_punctuation": _runs(" +[,;:!?.]"),
        "multiple_spaces": _runs(" {2,}"),
        "trailing_space": _one(t.rlike("[ \t  ]$"), F.length(F.rtrim(t)), F.length(t) - F.length(F.rtrim(t))),
        "consecutive_duplicate_words": F.when(s.rlike(r"(?i)\b([a-z]+) \1\b"), _none()).otherwise(_runs(r"(?i)\b([a-z]+) \2\b")),
        "initial_case_mismatch": _one((first("source_text") != "") & (first("target_text") != "") & ((first("source_text") == F.upper(first("source_text"))) != (first("target_text") == F.upper(first("target_text")))), 0, 1, first("target_text")),
        "multiple_upper_initials": _camel(),
        "same_word_case_mismatch": _word_case(),
        "source_target_identical": _one((F.trim(s) == F.trim(t)) & t.rlike("[A-Za-z]"), 0, F.length(t)),
        "word_count_exceeds": _one(both & (tw > sw * (100 + threshold) / 100)),
        "word_count_below": _one(both & (tw < sw * (100 - threshold) / 100)),
        "word_count_gap": _one(both & (F.abs(tw - sw) * 100 > sw * threshold)),
        "number_mismatch": _mismatch(NUMBER),
        "parameter_mismatch": _mismatch(PARAMETER),
        "email_mismatch": _mismatch(EMAIL),
        "link_mismatch": _mismatch(LINK),
        "symbol_mismatch": _mismatch(SYMBOL),
    }


@F.pandas_udf(FINDING)
def unpaired_marks(texts: pd.Series) -> pd.Series:
    """Brackets and quotes that no mark closes or opens, by a stack for each pair."""

    def check(text: str | None) -> list[dict]:
        out = []
        for opening, closing in PAIRS:
            stack = []
            for i, c in enumerate(text or ""):
                if c in opening:
                    stack.append(i)
                elif c in closing:
                    if stack:
                        stack.pop()
                    elif c != "’":
                        out.append({"offset": i, "length": 1, "detail": c})
            out += [{"offset": i, "length": 1, "detail": text[i]} for i in stack]
        return sorted(out, key=lambda f: f["offset"])

    return pd.Series([check(t) for t in texts], dtype="object")


@F.pandas_udf(FINDING)
def unbalanced_tags(texts: pd.Series) -> pd.Series:
    """Format tags without their partner, by a stack of open tags."""
    tag = re.compile(r"<(/?)(b|i|u|sub|sup|strong|em)\b[^>]*>", re.IGNORECASE)

    def check(text: str | None) -> list[dict]:
        stack: list[tuple[str, int, str]] = []
        out = []
        for m in tag.finditer(text or ""):
            name = m[2].lower()
            if not m[1]:
                stack.append((name, m.start(), m[0]))
            elif stack and stack[-1][0] == name:
                stack.pop()
            else:
                out.append({"offset": m.start(), "length": len(m[0]), "detail": m[0]})
        out += [{"offset": at, "length": len(raw), "detail": raw} for _, at, raw in stack]
        return sorted(out, key=lambda f: f["offset"])

    return pd.Series([check(t) for t in texts], dtype="object")


def issues(pairs: DataFrame, enabled: list[str] | None = None, threshold: float = 50.0, french: bool = False) -> DataFrame:
    """All columns of `pairs` but the texts, with rule, offset, length, detail: one row per finding."""
    chosen = rules(threshold, french) | {"unpaired_marks": unpaired_marks("target_text"), "unbalanced_tags": unbalanced_tags("target_text")}
    chosen = {k: v for k, v in chosen.items() if enabled is None or k in enabled}
    keys = [c for c in pairs.columns if c not in ("source_text", "target_text")]
    found = pairs.select(*keys, F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("found")) for k, v in chosen.items()]).alias("all"))
    each = found.select(*keys, F.explode("all").alias("r")).select(*keys, F.col("r.rule").alias("rule"), F.explode("r.found").alias("f"))
    return each.select(*keys, "rule", F.col("f.offset").alias("offset"), F.col("f.length").alias("length"), F.col("f.detail").alias("detail"))


#: Names of rules, whether each is on, how grave it is, and the bounds of its threshold.
SEVERITIES = ("low", "medium", "high")
THRESHOLD, LEAST, MOST = 50, 1, 500


def rule_settings(given: dict | None, known: list[str]) -> dict[str, dict]:
    """One setting for every known rule: enabled, severity, threshold. What is given counts where it is of the right
    kind; thresholds are held within 1..500, unknown rules and values give way to the defaults."""
    out = {}
    for k in known:
        own = (given or {}).get(k) or {}
        own = own if isinstance(own, dict) else {"enabled": bool(own)}
        try:
            threshold = min(MOST, max(LEAST, int(own.get("threshold", THRESHOLD))))
        except (TypeError, ValueError):
            threshold = THRESHOLD
        severity = own.get("severity")
        out[k] = {"enabled": bool(own.get("enabled", True)), "severity": severity if severity in SEVERITIES else "medium", "threshold": threshold}
    return out


def term_inconsistencies(pairs: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """(keys, term_id): segments whose source holds a term (term_id, term, translation) and whose target does not hold its translation."""
    from lexibridge.operators.terms import term_matches

    # A segment is named by its keys alone; the text's words meet the terms, the targets are looked at afterwards.
    named = pairs.withColumn("text_id", F.struct(*keys))
    held = term_matches(named.select("text_id", F.col("source_text").alias("text")), terms.select("term_id", "term")).select("text_id", "term_id")
    both = held.join(terms.select("term_id", "translation"), "term_id").join(named.select("text_id", "target_text"), "text_id")
    return both.where(~F.contains(F.lower(F.coalesce("target_text", F.lit(""))), F.lower("translation"))).select("text_id.*", "term_id").distinct()


def context_variants(pairs: DataFrame, *keys: str) -> DataFrame:
    """Sources that have several different targets: their number and the segments concerned."""
    source, target = F.lower(F.trim("source_text")), F.trim("target_text")
    return pairs.where((source != "") & (target != "")).groupBy(*keys, source.alias("source_key")).agg(F.countDistinct(target).alias("targets"), F.count("*").alias("segments")).where("targets > 1")
