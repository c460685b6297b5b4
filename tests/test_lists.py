"""Work lists, imports, numbers and lexicons by hand-made cases and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lexibridge.operators import imports, lexicon, numbers, search, worklists


def test_greedy_batches_equal_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(k, n // 3, n, r.choice([1, 5, 40, 200])) for k in ("a", "b", "c") for n in range(200)]
    df = spark.createDataFrame(rows, "k string, p int, n int, size long").repartition(7)

    def loop(together):
        want = {}
        for k in ("a", "b", "c"):
            items = total = batch = 0
            own = [x for x in rows if x[0] == k]
            groups = [[x for x in own if x[1] == p] for p in sorted({x[1] for x in own})] if together else [[x] for x in own]
            for g in groups:
                size = sum(x[3] for x in g)
                if len(g) <= 4 and size <= 100 and items and (items + len(g) > 4 or total + size > 100):
                    batch, items, total = batch + 1, 0, 0
                for x in g:
                    if items and (items + 1 > 4 or total + x[3] > 100):
                        batch, items, total = batch + 1, 0, 0
                    items, total = items + 1, total + x[3]
                    want[k, x[2]] = batch
        return want

    for together in (None, ["p"]):
        got = {(r.k, r.n): r.batch for r in worklists.greedy_batches(df, ["k"], ["p", "n"], "size", 4, 100, together).collect()}
        assert got == loop(together)
    assert worklists.greedy_batches(df.where("n < 0"), ["k"], ["n"], "size", 4, 100).collect() == []


def test_unknown_scopes_and_sorts_are_errors(spark):
    df = spark.createDataFrame([("none", "")], "status string, target_text string")
    with pytest.raises(KeyError):
        worklists.in_translation_scope(df, "nonsense")
    with pytest.raises(KeyError):
        search.ordering("nonsense", {}, False)


def test_pages_are_clamped(spark):
    rows, total = search.page(spark.range(10).withColumnRenamed("id", "entry_id"), search.ordering("id", {"id": "entry_id"}, False), 0, 0)
    assert ([r.entry_id for r in rows.collect()], total) == ([0], 10)


def test_numbers_of_texts(spark):
    cases = [("1,200 and 1.5 million", [1200.0, 1500000.0]), ("一千二百零三万元", [12030000.0]), ("十二个", [12.0]), ("3万 and 2亿", [30000.0, 200000000.0]), ("5% or 5 percent", [0.05, 0.05]), ("两亿三千万", [230000000.0]), ("none 一", []), (None, [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", numbers.numbers("t").alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    pairs = spark.createDataFrame([("1 2", "2 1"), ("1 1", "1"), ("3", "3 4"), ("5", "5"), ("6", " ")], "source_text string, target_text string")
    assert {(r.source_text, tuple(r.missing), tuple(r.extra), r.reordered) for r in numbers.number_report(pairs).collect()} == {("1 2", (), (), True), ("1 1", (1.0,), (), False), ("3", (), (4.0,), False)}


def test_words_are_replaced_in_their_case(spark):
    pairs = spark.createDataFrame([("colour", "color"), ("car park", "parking lot")], "source string, target string")
    texts = spark.createDataFrame([(1, "Colour, COLOUR colourful <colour> Car park."), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.text for r in lexicon.converted(texts, pairs).collect()}
    assert got == {1: "Color, COLOR colourful <colour> Parking lot.", 2: None, 3: ""}
    assert [r.text for r in lexicon.converted(texts.where("id = 1"), pairs.where(F.lit(False))).collect()] == ["Colour, COLOUR colourful <colour> Car park."]


def test_lexicons_settle(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("x", "z"), ("c", "d")], "source string, target string")
    assert {(r.source, r.enabled) for r in lexicon.enabled(rows).collect()} == {("a", True), ("b", False), ("x", False), ("c", False)}


def test_imports_meet_entries_by_hash_then_text(spark):
    existing = spark.createDataFrame([(1, "One  two", "x"), (2, "three", "y")], "entry_id long, source_text string, target_text string")
    incoming = spark.createDataFrame([(1, "One two", "old"), (2, "One two", "x"), (3, "three", "y"), (4, "new", "z"), (5, " ", "q"), (6, "w", " ")], "place long, source_text string, target_text string")
    assert {(r.source_text, r.entry_id, r.action) for r in imports.plan_import(incoming, existing).collect()} == {("One two", 1, "updated"), ("three", 2, "skipped"), ("new", None, "created")}


def test_references_and_faults(spark):
    groups = spark.createDataFrame([("h", 1, 2), ("g", 2, 1)], "source_hash string, first_segment long, copies long")
    memory = spark.createDataFrame([("h", 2, "later"), ("h", 1, "first")], "source_hash string, entry_id long, target_text string")
    spans = spark.createDataFrame([(2, [1])], "first_segment long, spans array<int>")
    assert {(r.source_hash, r.memory_target, r.spans and r.spans[0]) for r in worklists.with_references(groups, memory, spans).collect()} == {("h", "first", None), ("g", None, 1)}
    pairs = [("a", "", "empty"), ("12", "13", "numeric"), ("→ ←", "← →", "symbols"), ("⟦MATH_1⟧", "x", "formulas"), ("<b>a</b> <i>b</i>", "<i>b</i> <b>a</b>", None), ("<b>a</b>", "a", "tags"), ("a\nb", "a b", "lines"), ("ok", "gut", None)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(pairs)], "i int, source_text string, target_text string")
    assert [r.f for r in df.select("i", worklists.output_fault().alias("f")).orderBy("i").collect()] == [f for _, _, f in pairs]
    one = spark.createDataFrame([("ab ab", "ab"), ("x ab", "ab"), ("A  b", "a b"), ("x", "y"), ("x", None)], "t string, a string")
    assert [tuple(r.p) for r in one.select(worklists.anchored(F.col("t"), F.col("a")).alias("p")).collect()] == [("ambiguous", None), ("unique", 2), ("normalized", None), ("unlocatable", None), ("unlocatable", None)]


def test_scripts_and_alternating_pairs(spark):
    rows = [("zh-CN", "only latin", False), ("zh", "译文 ok", True), ("en", "译文译文 ok", False), ("fr", "译文译文 bon mot", True), ("uk", "ok", True), ("ur", "abc", False), ("ja", "訳 abc", True), ("en", None, True)]
    df = spark.createDataFrame(rows, "lang string, text string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", worklists.expected_script(F.col("lang"), F.col("text"))).collect())
    paragraphs = [(1, 0, "One line"), (1, 1, "一行"), (1, 2, "一行"), (1, 3, "Two"), (1, 4, " "), (1, 5, "二 two words")]
    got = imports.alternating_pairs(spark.createDataFrame(paragraphs, "doc_id long, place int, text string")).collect()
    assert [(r.place, r.source_text, r.target_text, r.level) for r in got] == [(0, "One line", "一行", "term")]
