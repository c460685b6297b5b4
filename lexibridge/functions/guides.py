"""What client files are and ask for, as Column expressions: kinds of files, style rules, risks, names, fixed phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4E00}-\x{9FFF}]"

# Words of style guides, headers of term tables, phrases of risks and of fixed sentences.
STYLE_WORDS = ["语气", "风格", "避免", "不得使用", "应当", "请勿", "tone", "style", "avoid", "formal", "casual", "第一人称", "第三人称", "正式", "口语"]
TERM_HEADERS = [("source", "target"), ("原文", "译文"), ("english", "chinese"), ("en", "zh"), ("en", "cn"), ("术语", "翻译"), ("term", "translation")]
LEGAL = [r"shall\s+(?:not\s+)?be\s+(?:liable|responsible)", "indemnif", "warrant", "represent", "covenant", "承担.*责任", "免责", "赔偿"]
MONEY = r"[$￥]\s*[0-9,]+(?:\.[0-9]+)?|[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:美元|元|USD|RMB)"
LITERAL_ENGLISH = r"(?i)do\s+good\s+to|open\s+the\s+door\s+of|more\s+and\s+more\s+\w+er"
FIXED_PHRASES = ["hereby", "whereas", "notwithstanding", "pursuant to", "in witness whereof", "shall be deemed", "特此", "鉴于", "尽管如此", "根据", "兹证明"]


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _held(texts: Column, word: str) -> Column:
    return F.exists(texts, lambda t: F.contains(t, F.lit(word)))


def han_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN)) / F.greatest(F.length(text), F.lit(1))


def alternates(paragraphs: Column) -> Column:
    """Whether at least three tenths of the first twenty paragraphs, of four or more, change from Han to none or back."""
    first = F.slice(paragraphs, 1, 20)
    side = lambda p: F.when(han_share(p) > 0.3, 1).when(han_share(p) < 0.1, 2).otherwise(0)
    n = F.size(first)
    sides = F.transform(first, side)
    # The sum of two neighbouring sides is 3 only for one of each.
    changes = F.size(F.filter(F.zip_with(F.slice(sides, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(sides, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a + b), lambda s: s == 3))
    return F.coalesce((n >= 4) & (changes >= n * 0.3), F.lit(False))


def file_kind(headers: Column, mean_cell: Column, text: Column, paragraphs: Column) -> Column:
    """terminology, style_guide, translation_memory or unknown.

    headers: of the file's table, null for none; mean_cell: mean length of its cells, null for no rows.
    """
    lower = F.transform(headers, lambda h: F.lower(h))
    named = F.lit(False)
    for a, b in TERM_HEADERS:
        named = named | (_held(lower, a) & _held(lower, b))
    terms = (F.size(headers) > 0) & (named | ((F.size(headers) <= 3) & (mean_cell < 30)))
    hits = F.size(F.filter(F.array(*map(F.lit, STYLE_WORDS)), lambda w: F.contains(F.lower(text), w)))
    return F.when(terms, "terminology").when(hits >= 3, "style_guide").when(alternates(paragraphs), "translation_memory").otherwise("unknown")


def style_rules(text: Column) -> Column:
    """struct(tone, person, avoid, preferences) of a style guide; at most ten preferences, as the report shows them."""
    has = lambda *words: any_of(text, list(words))
    wishes = F.slice(F.regexp_extract_all(text, F.lit("([应建请].{5,30}[。\n])"), 1), 1, 10)
    return F.struct(
        F.when(has("正式", "书面"), "formal").when(has("口语", "轻松"), "casual").alias("tone"),
        F.when(has("第三人称"), "third").when(has("第一人称"), "first").alias("person"),
        F.regexp_extract_all(text, F.lit('[不禁]得?[用使]用["「](.+?)["」]'), 1).alias("avoid"),
        F.transform(wishes, lambda p: F.regexp_replace(F.trim(F.translate(p, "\n", " ")), "。+$", "")).alias("preferences"),
    )


def risks(source: Column, target: Column) -> Column:
    """array of struct(category, examples) of legal phrases, sums of money and literal English; up to five examples each."""
    both = F.concat(source, target)
    all_of = lambda pattern: F.regexp_extract_all(both, F.lit(f"({pattern})"), 1)
    legal = F.flatten(F.array(*[F.slice(all_of(f"(?i).{{0,30}}{p}.{{0,30}}"), 1, 2) for p in LEGAL]))
    english = F.slice(F.regexp_extract_all(source, F.lit(f"({LITERAL_ENGLISH})"), 1), 1, 1)
    found = [F.struct(F.lit(name).alias("category"), F.slice(examples, 1, 5).alias("examples")) for name, examples in (("legal", legal), ("number", all_of(MONEY)), ("chinglish", english))]
    return F.filter(F.array(*found), lambda r: F.size(r["examples"]) > 0)


def is_name(term: Column) -> Column:
    """Whether a term looks like a brand's or product's name: title or upper case, a mark, or one or two words with a capital first."""
    cased = r"[\p{Lu}\p{Ll}]"
    title = term.rlike(r"\p{Lu}") & ~term.rlike(rf"(?<!{cased})\p{{Ll}}|(?<={cased})\p{{Lu}}")
    upper = term.rlike(r"\p{Lu}") & ~term.rlike(r"\p{Ll}")
    return title | upper | term.rlike("[®™]") | ((F.size(F.split(F.trim(term), r"\s+")) <= 2) & term.rlike(r"^\p{Lu}"))


def is_fixed(source: Column, target: Column) -> Column:
    """Whether a pair holds a phrase that is never reworded."""
    return any_of(F.lower(F.concat(source, target)), FIXED_PHRASES)


def profile_confidence(terms: Column, pairs: Column, industry: Column, client: Column, formats: Column, abbreviations: Column) -> Column:
    """How well a client's profile is founded, 0 to 1: by numbers of terms and pairs, and by what else is known (booleans)."""
    by_terms = F.when(terms >= 20, 0.3).when(terms >= 10, 0.2).when(terms >= 5, 0.1).otherwise(0.0)
    by_pairs = F.when(pairs >= 10, 0.2).when(pairs >= 5, 0.1).otherwise(0.0)
    known = [F.when(c, points).otherwise(0.0) for c, points in ((industry, 0.2), (client, 0.15), (formats, 0.1), (abbreviations, 0.05))]
    return F.least(F.round(sum(known, by_terms + by_pairs), 2), F.lit(1.0))
