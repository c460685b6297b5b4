"""Boxes, barriers, components, chains and clusters against brute force."""

import itertools
import random

import pytest

from lexibridge.operators import boxes as B
from lexibridge.operators import graphs as G
from lexibridge.plans import boxes as plans

BOX = "page long, layer string, box_id long, text string, x double, y double, width double, height double, rotation double, style string"
LINE = "page long, axis string, place double, low double, high double"
TEXTS = ["plain words", "and on,", "1.2 Title", "end.", "Label:", "1.2.3", "word-", "", "（x", "）y", "GB 50268", "的"]


def made(seed, n, pages=2, spread=400.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((r.randrange(pages), r.choice(("a", "a", "b")), i, r.choice(TEXTS + [None]), round(r.uniform(-spread, spread), 2), round(r.uniform(-spread / 4, spread / 4), 2), round(r.choice((0.0, 20.0, 90.0, 700.0)) * r.random(), 2), round(r.choice((8, 10, 14, 30, 0)) * r.uniform(0.8, 1.2), 2), r.choice((0.0, 0.0, 2.0, 358.0, 40.0)), r.choice(("x", "x", "y", ""))))
    lines = [(r.randrange(pages), r.choice("hv"), round(r.uniform(-spread, spread) / r.choice((1, 4)), 1), *sorted((round(r.uniform(-spread, spread), 1), round(r.uniform(-spread, spread), 1)))) for _ in range(n // 3)]
    return rows, lines


def test_every_near_pair_meets_once(spark):
    rows, _ = made(1, 400)
    got = [(r.a.box_id, r.b.box_id) for r in B.near_pairs(spark.createDataFrame(rows, BOX).repartition(4)).collect()]
    assert len(got) == len(set(got))
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[:2] == b[:2] and min(a[7], b[7]) > 0 and abs(a[7] - b[7]) / max(a[7], b[7]) <= 0.3:
            mean = (a[7] + b[7]) / 2
            left, right = sorted((a, b), key=lambda x: x[4])
            if abs(a[5] - b[5]) <= 3 * mean * 0.999 and right[4] - left[4] - left[6] <= 3 * mean * 0.999:
                want.add((a[2], b[2]))
    assert want and want <= set(got)


def test_pairs_score_higher_the_nearer(spark):
    rows = [(1, "a", i, "words", x, y, 40.0, 10.0, 0.0, "x") for i, (x, y) in enumerate([(0.0, 0.0), (45.0, 0.0), (110.0, 1.0), (0.0, -15.0), (300.0, 0.0), (0.5, 0.5)])]
    got = {(r.a, r.b): r for r in B.scored_pairs(spark.createDataFrame(rows, BOX)).collect()}
    assert got[0, 1].same_row and got[0, 1].score > got[1, 2].score > 0 and not got[0, 3].same_row
    # The box far away has no pair, and the one that lies on another none with it.
    assert not any(4 in k for k in got) and (0, 5) not in got


def across(lines, page, axis, start, stop, low, high):
    for p, a, place, x, y in lines:
        if (p, a) == (page, axis) and min(start, stop) <= place <= max(start, stop) and ((x <= low and y >= high) or (x <= high and y >= low and min(y, high) - max(x, low) >= 0.5 * (high - low))):
            return True
    return False


def test_blocked_equals_brute_force(spark):
    _, lines = made(3, 300)
    r = random.Random(9)
    asked = []
    for i in range(400):
        at, low = r.uniform(-400, 400), r.uniform(-400, 300)
        asked.append((i, r.randrange(2), r.choice("hv"), at, at + r.choice((1, -30, 30, 300)) * r.random(), low, low + 100 * r.random()))
    df = spark.createDataFrame(asked, "k long, page long, axis string, start double, stop double, low double, high double")
    got = {x.k for x in B.blocked(df, spark.createDataFrame(lines, LINE), "k").collect()}
    assert got == {q[0] for q in asked if across(lines, *q[1:])} and 0 < len(got) < 400
    none = spark.createDataFrame([], LINE)
    assert B.blocked(df, none, "k").collect() == [] and B.blocked(df.limit(0), none, "k").collect() == []


def test_lines_that_touch_are_one_run(spark):
    rows = [(1, "h", 0.0, 0.0, 5.0), (1, "h", 0.0, 5.0, 7.0), (1, "h", 0.0, 1.0, 2.0), (1, "h", 0.0, 8.0, 9.0), (1, "v", 0.0, 6.0, 8.0)]
    got = sorted(tuple(r) for r in B.merged_lines(spark.createDataFrame(rows, LINE)).collect())
    assert got == [(1, "h", 0.0, 0.0, 7.0), (1, "h", 0.0, 8.0, 9.0), (1, "v", 0.0, 6.0, 8.0)]


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7), (None, 3)]
    root = {i: i for e in edges for i in e if i is not None}
    for a, b in edges:
        if a is not None:
            low, high = sorted((find(root, a), find(root, b)))
            root[high] = low
    linked = {i for a, b in edges if a is not None and a != b for i in (a, b)}
    got = {x.node: x.component for x in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(root, i) for i in linked}
    assert G.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(141, None), (140, 141), (5, None), (9, 3), (3, 8), (8, 9), (60, 61), (61, None)]
    links = [x for x in links if x != (140, 141)] + [(140, 141)]
    got = {r.node: tuple(r)[1:] for r in G.chain_ranks(spark.createDataFrame(links, "node long, after long")).collect()}
    assert got[5] == (5, 0, False) and got[61] == (60, 1, False)
    assert all(got[i] == (100, i - 100, False) for i in range(100, 142))
    assert all(got[i] == (3, None, True) for i in (3, 8, 9)) and len(got) == 42 + 1 + 3 + 2


def test_clusters_of_large_pages_equal_those_of_small_ones(spark):
    rows, lines = made(8, 50, spread=100.0)
    laid = spark.createDataFrame(rows, BOX)
    pairs = G.cut(B.scored_pairs(laid))
    lines = spark.createDataFrame(lines[:6], LINE)
    whole = {r.box_id: (r.cluster, r.confidence) for r in B.clusters(laid, pairs, lines).collect()}
    rounds = {r.box_id: (r.cluster, r.confidence) for r in B.clusters(laid, pairs, lines, page_boxes=0).collect()}
    assert whole == rounds and set(whole) == {r[2] for r in rows}
    sizes = [list(whole.values()).count(v) for v in set(whole.values())]
    assert max(sizes) > 1 and all((c == i) <= (whole[c][0] == c) for i, (c, _) in whole.items())
    assert all(f == 1.0 or f >= B.Rules().least for _, f in whole.values())


def test_relation_in_python_equals_the_expression(spark):
    pairs = [(a.strip(), b.strip()) for a in TEXTS + ["a、", "b：", "c；"] for b in TEXTS + ["、x", "《y", "2) z", "A. b"]]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.r < 0 for r in df.select(B.relation(df.a, df.b).alias("r")).collect()]
    assert got == [B.starts_new(a, b) for a, b in pairs] and True in got and False in got


def test_a_pair_that_breaks_off_is_vetoed(spark):
    texts = ["one", "two", "3. three"]
    rows = [(1, "a", i, t, 45.0 * i, 0.0, 40.0, 10.0, 0.0, "x") for i, t in enumerate(texts)]
    laid = spark.createDataFrame(rows, BOX)
    given = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 2, 0.8)], "page long, a long, b long, score double")
    got = {r.box_id: (r.cluster, r.confidence) for r in B.clusters(laid, given).collect()}
    assert got == {0: (0, 0.9), 1: (0, 0.9), 2: (2, 1.0)}
    across_ = spark.createDataFrame([(1, "v", 42.0, -50.0, 50.0)], LINE)
    assert {r.box_id: r.cluster for r in B.clusters(laid, given, across_).collect()} == {0: 0, 1: 1, 2: 2}


def test_reading_order_and_spaces(spark):
    texts = [(0, "下", 0.0, 0.0, 10.0), (1, "上", 0.0, 30.0, 10.0), (2, "right", 90.0, 31.0, 30.0), (3, "文", 12.0, 29.0, 10.0), (4, "  ", 14.0, 29.0, 3.0), (5, "5 mm", 125.0, 30.0, 20.0)]
    rows = [(1, "a", i, t, x, y, w, 10.0, 0.0, "x") for i, t, x, y, w in texts]
    got = B.reading_text(spark.createDataFrame(rows, BOX), "page").first()
    assert (got.n_boxes, got.text) == (6, "上文right5 mm下")
    words = [(1, "a", 1, "one", 0.0, 0.0, 20.0, 10.0, 0.0, "x"), (1, "a", 2, "two", 40.0, 0.0, 20.0, 10.0, 0.0, "x"), (1, "a", 3, ", x", 90.0, 0.0, 20.0, 10.0, 0.0, "x")]
    assert B.reading_text(spark.createDataFrame(words, BOX), "page").first().text == "one two, x"


def test_boxes_move_once_and_marks_equal_blocked(spark):
    """Scoring moves no texts and deals boxes out once; marks carried with the pairs equal `blocked` on joined boxes."""
    rng = random.Random(5)
    rows = [(i % 3, "body", i, "some words", rng.uniform(0, 400), rng.uniform(0, 300), rng.uniform(10, 60), rng.choice([10.0, 12.0, 16.0]), 0.0, "plain") for i in range(240)]
    laid = G.cut(spark.createDataFrame(rows, BOX))
    barred = spark.createDataFrame([(rng.randrange(3), rng.choice("hv"), rng.uniform(0, 300), low := rng.uniform(0, 300), low + rng.uniform(5, 200)) for _ in range(120)], LINE)
    pairs = B.scored_pairs(laid)
    want = {(r.a, r.b) for r in B.blocked(B.between_boxes(pairs, laid), barred, "a", "b").collect()}
    got = B.marked_pairs(B.scored_pairs(laid, way=True), barred, B.line_bins(laid)).collect()
    assert want and {(r.a, r.b) for r in got if r.blocked} == want and len(got) == pairs.count()
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_breaks_found_once_equal_starts_new():
    texts = [t.strip() for t in TEXTS + ["a、", "b：", "c；", "、x", "《y", "2) z", "A. b", "1. a label of more than twelve signs:", "1.", "x:", "》", "3、"]]
    assert all(B._starts_new(B._breaks(a), B._breaks(b)) == B.starts_new(a, b) for a in texts for b in texts)


def test_pages_are_joined_once_and_over_many_batches(spark):
    """The plan of box_sentences holds one look at the pages, and pages that several batches hold come out as those of one batch."""
    plan = plans.box_sentences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapGroupsInPandas") == 1
    rows, lines = made(11, 60, pages=5, spread=100.0)
    laid, lines = spark.createDataFrame(rows, BOX), spark.createDataFrame(lines, LINE)
    pairs = G.cut(B.scored_pairs(laid))
    whole = sorted(tuple(r) for r in B.clusters(laid, pairs, lines).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(tuple(r) for r in B.clusters(laid, pairs, lines).collect()) == whole and len(whole) == 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
