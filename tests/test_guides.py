"""Marks, numbering and client files against small cases and a plain state machine."""

import random

import pytest
from pyspark.sql import functions as F

from lexibridge.functions import guides as G
from lexibridge.functions import marks as M


def curled(text, straight='"＂', left="“", right="”"):
    opens, out = True, ""
    for x in text:
        if x in straight:
            x = left if opens else right
        opens = opens if x not in (left, right) else x == right
        out += x
    return out


def test_quotes_against_a_state_machine(spark):
    r = random.Random(3)
    texts = ["".join(r.choice('""＂“”ab') for _ in range(r.randrange(14))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.quotes("t").alias("all"), M.quotes("t", width="half").alias("half")).collect()
    assert all(x["all"] == curled(x.t) and x.half == curled(x.t, '"') for x in rows)


def test_straight_quotes_and_scopes(spark):
    one = spark.createDataFrame([("“a” ‘b’ \"c\" ＂d＂", None)], "t string, none string")
    got = one.select(M.quotes("t", "straight"), M.quotes("t", "straight", shape="curly", target_width="full"), M.quotes("t", "straight", width="half", target_width="full"), M.quotes("none")).first()
    assert list(got) == ["\"a\" 'b' \"c\" \"d\"", "＂a＂ ＇b＇ \"c\" ＂d＂", "“a” ‘b’ ＂c＂ ＂d＂", None]


CASES = [
    ("3.1 Scope", "范围", "3.1 范围", None, "Scope"),
    ("Chapter 3 Scope", "范围", "第三章 范围", None, "Scope"),
    ("(12) Scope", "范围", "（十二）范围", None, "Scope"),
    ("2. Scope", "范围", "范围", "二、", "Scope"),
    ("1.5 mm", "毫米", "1. 毫米", None, "1.5 mm"),
    ("a)- text", "x", "a) x", None, "text"),
    ("3.", "范围", "3. 范围", None, "3."),
    ("Scope", "范围", "3. 范围", None, "Scope"),
    ("Note that", "x", "Some words x", None, "Note that"),
    ("1: first", "x", None, "1", "first"),
    (None, "x", "1. x", None, ""),
    ("a.b c", None, None, None, "a.b c"),
]


@pytest.mark.parametrize("text, source, display, numbering, want", CASES)
def test_numbering_is_stripped(spark, text, source, display, numbering, want):
    df = spark.createDataFrame([(text, source, display, numbering)], "t string, s string, d string, n string")
    assert df.select(M.without_numbering(*map(F.col, "tsdn"))).first()[0] == want


def test_file_kinds(spark):
    rows = [(["English", "Chinese (CN)"], 80.0, "", []), (["a", "b"], 12.0, "", []), (["a", "b"], 90.0, "", []), (None, None, "语气 正式，请勿", ["x"]), (None, None, "", ["one", "译文", "two", "译文"]), (None, None, "", ["one", "译文", "two"]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "h array<string>, m double, t string, p array<string>")
    assert [r[0] for r in df.select(G.file_kind(*map(F.col, "hmtp"))).collect()] == ["terminology", "terminology", "unknown", "style_guide", "translation_memory", "unknown", "unknown"]


def test_style_risks_and_names(spark):
    s = spark.createDataFrame([("语气正式。使用第三人称。不得使用「你好」。应当保持术语前后一致。",)], "t string").select(G.style_rules(F.col("t")).alias("s")).first().s
    assert (s.tone, s.person, s.avoid, s.preferences) == ("formal", "third", ["你好"], ["应当保持术语前后一致"])
    r = spark.createDataFrame([("A party shall not be liable; more and more faster. $ 1,200.50", "赔偿 30 元")], "s string, t string").select(G.risks(F.col("s"), F.col("t")).alias("r")).first().r
    assert [x.category for x in r] == ["legal", "number", "chinglish"] and r[1].examples == ["$ 1,200.50", "30 元"]
    names = {"Acme Cloud Pro Suite": True, "ACME": True, "acme": False, "the acme® box of": True, "Acme box": True, "Acme box of tools": False, "": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", G.is_name(F.col("n")).alias("x")).collect()
    assert {x.n: x.x for x in got} == names
