import pytest
from pyspark.sql import functions as F

from lexibridge.functions import text as T

CASES = [
    (T.normalize_text, "  a​ b ,c ", "a b,c"),
    (T.normalize_text, None, ""),
    (T.match_text, "软件架构遵循微服务模式.", "软件架构遵循微服务模式"),
    (T.match_text, "?!.", ""),
    (T.match_or_normalized, "?!.", "?!."),
    (T.compact_core, "a-b_c 中文。", "ab_c中文"),
    (T.source_words, "Été 2024 中文", 4),
    (T.source_words, None, 0),
    (T.is_structural_fragment, "1.", True),
    (T.is_structural_fragment, "IV", True),
    (T.is_structural_fragment, "MIXD", True),
    (T.is_structural_fragment, "ABCD", False),
    (T.has_searchable_content, "…!?", False),
    (T.has_searchable_content, "é", True),
    (T.normalize_lines, "a \t b\r\n\r\n\r\n\r\nc ", "a b\n\nc"),
]


@pytest.mark.parametrize("function, value, want", CASES)
def test_text_functions(spark, function, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(function("v")).first()[0] == want


def test_normalising_twice_changes_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(T.normalize_text("text").alias("n"))
    assert docs.where(T.normalize_text("n") != F.col("n")).count() == 0


@pytest.mark.parametrize("length, want", [(10, (1, 34)), (50, (16, 122))])
def test_length_band(spark, length, want):
    low, high = T.length_band(F.lit(length))
    assert tuple(spark.range(1).select(low, high).first()) == want


def test_script_language(spark):
    texts = [("ひらがなです", "ja-JP"), ("안녕하세요", "ko-KR"), ("привет мир", "ru-RU"), ("软件架构遵循", "zh-CN"), ("plain text", None), ("", None)]
    df = spark.createDataFrame(texts, "t string, want string").select("want", T.script_language("t")["language"].alias("got"))
    assert [r.want for r in df.collect()] == [r.got for r in df.collect()]


def test_languages_of_latin_texts(spark):
    from lexibridge.functions import languages

    cases = [("the cat and the dog are in the house", "en-US"), ("der Hund und die Katze sind für uns nicht zu sehen", "de-DE"), ("el coche es de la casa y los ordenador", "es-ES"), ("une maison dans la rue avec des fleurs", "fr-FR"), ("one two", None), ("", None), (None, None), ("zzz xxx qqq www kkk jjj ppp vvv", "en-US")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", languages.latin_language("t").alias("l")).collect()}
    assert [got[i].language for i in range(len(cases))] == [w for _, w in cases]
    assert (got[7].confidence, got[4].confidence) == (0.52, 0.0)
    # 5 hits of 9 tokens: the bound of 0.3, the whole margin and basic letters, held at 0.93.
    assert got[0].confidence == 0.93


def test_languages_of_long_texts_and_passes_over_them(spark):
    """No letter of a text becomes a string of its own, and a text that is cut short has the tokens of the whole one."""
    from lexibridge.functions import languages

    n = languages.HEAD
    cases = [
        ("9" * n + " und der die das", 4, "de-DE", 4),
        ("9" * (n - 2) + "eine die der und", 4, "de-DE", 4),
        ("the " * 300 + "9" * n + " und" * 50, 300, "en-US", 300),
        ("a " * 299 + "9" * (n - 599) + "dans" + " le" * 40, 300, "en-US", 299),
        ("z" * n + " zz zz zz" + "ế", 4, "vi-VN", 3),
        ("软" * n + "İ K zz zz zz zz zz", 6, None, 0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", languages.latin_language("t").alias("l"))
    got = {r.i: r.l for r in df.collect()}
    assert [(got[i].tokens, got[i].language, got[i].score) for i in range(len(cases))] == [c[1:] for c in cases]
    # Tokens alone are taken out one by one, of a text's head and of the whole text.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2


def test_difference_markup_and_comparable_text(spark):
    from lexibridge.functions import similarity

    df = spark.createDataFrame([("a red <b>", "a blue <b>"), ("x", None), ("Ａ-b_ß!", "你好")], "s string, m string")
    got = [tuple(r) for r in df.select(similarity.difference_markup("s", "m"), similarity.comparable_text("s")).collect()]
    assert got == [("a <del>red</del><ins>blue</ins> &lt;b&gt;", "aredb"), ("<del>x</del>", "x"), ("<del>Ａ-b_ß!</del><ins>你好</ins>".replace("Ａ-b_ß!", "-b!"), "abss")]


def test_hashed_embedding_by_its_definition(spark):
    from hashlib import blake2b

    import numpy as np

    from lexibridge.functions import similarity

    text = "Two words."
    core, v = "Two words", np.zeros(similarity.DIMENSIONS)
    names = [f"char:{c}" for c in "Twowords"], [f"bigram:{a}{b}" for a, b in zip("Twowords", "wowords")], ["word:Two", "word:words"], ["word_bigram:" + core]
    for group, weight in zip(names, (0.75, 1.25, 1.0, 1.1)):
        for name in group:
            d = blake2b(name.encode(), digest_size=16).digest()
            v[int.from_bytes(d[:4], "big") % len(v)] += weight if d[4] % 2 == 0 else -weight
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(similarity.hashed_embedding("t").alias("e")).collect()
    assert got[0].e == (v / np.linalg.norm(v)).round(8).tolist() and not any(got[1].e) and not any(got[2].e)


def test_even_texts_are_normalised_as_all_others(spark):
    """Texts that need no change are only trimmed; every sign in every place is as by the three replacements."""
    signs = [chr(i) for i in [*range(0x180), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), 0xD7FF, 0xE000, *range(0xFEF0, 0x10000), 0x20000]]
    texts = [x for c in signs for x in (c, f"a{c}b", f" a {c} b", f"a b{c}")] + ["a  b", "a b", " a. ", "a .", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    text = F.coalesce("t", F.lit(""))
    spaced = F.regexp_replace(F.regexp_replace(text, T.INVISIBLE, " "), T.BLANK + "+", " ")
    known = F.trim(F.regexp_replace(spaced, " +" + T.TIGHT_MARKS, "$1"))
    assert rows.where(~T.normalize_text("t").eqNullSafe(known)).collect() == []
    assert rows.where(F.col("t").isin("plain text, with marks.", "a b", " a. ") & F.col("t").rlike(T.UNEVEN)).collect() == []
