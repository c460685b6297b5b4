"""Operators against hand-made cases and brute force."""

import random
import re
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexibridge.functions import sequences
from lexibridge.functions import similarity as S
from lexibridge.operators import alignment, memory, propagation, quality_rules, repetition, reports, terms
from lexibridge.operators import quality_rules as Q
from lexibridge.operators.numbers import number_report
from lexibridge.plans import catalogue


def grams(text):
    import re

    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def test_trigram_candidates_equal_brute_force(spark, data):
    bench = [r[0] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect()]
    entries = [(i, s.strip()) for i, s in enumerate(x for t in bench for x in t.split(".")) if s.strip()][:80]
    queries = [(str(i), " ".join(t.split()[1:9])) for i, t in entries if len(t.split()) > 3]
    got = memory.trigram_candidates(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(entries, "entry_id long, source_text string")).collect()
    want = set()
    for q, t in queries:
        a, scored = grams(t), []
        for e, s in entries:
            b, n = grams(s), len(t)
            low, high = max(1, int(0.4 * n) - 4), max(n + 12, int(2.2 * n) + 12)
            j = len(a & b) / len(a | b) if a | b else 0
            if low <= len(s) <= high and j >= 0.3:
                scored.append((-j, e))
        want |= {(q, e) for _, e in sorted(scored)[:3]}
    assert {(r.query_id, r.entry_id) for r in got} == want


def test_fuzzy_matches_score(spark):
    entries = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "something else entirely")], "entry_id long, source_text string")
    queries = spark.createDataFrame([("q", "the quick brown fox jumped"), ("e", "the quick brown fox jumps."), ("n", "12")], "query_id string, text string")
    got = {(r.query_id, r.entry_id): r.score for r in memory.fuzzy_matches(queries, entries).collect()}
    ratio = SequenceMatcher(None, "the quick brown fox jumped", "the quick brown fox jumps").ratio()
    assert got == {("q", 1): pytest.approx(round(ratio, 4)), ("e", 1): 1.0}


def test_embedding_is_unit_and_repeatable(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("",), (None,)], "t string").select(S.hashed_embedding("t").alias("v"))
    a, b, c, d = [r.v for r in df.collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and not any(c) and not any(d)


def test_upsert_policies(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1), ("c", 6, 2)], "k string, v long, o long")
    over = {tuple(r) for r in memory.upsert(old, new, ["k"], "o").collect()}
    keep = {tuple(r) for r in memory.upsert(old, new, ["k"], "o", keep=True).collect()}
    assert over == {("a", 1, "unchanged"), ("b", 4, "updated"), ("c", 6, "created")}
    assert keep == {("a", 1, "unchanged"), ("b", 2, "unchanged"), ("c", 5, "created")}


def test_scope_distinguishes_none_and_empty(spark):
    df = spark.createDataFrame([(1,), (2,)], "collection_id long")
    assert [memory.in_scope(df, s).count() for s in (None, [], [1])] == [2, 0, 1]


def test_covered_merges_touching_ranges(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 3, 5), (1, 8, 9), (2, 4, 4)], "k long, start long, stop long")
    assert {tuple(r) for r in repetition.covered(df, "k").collect()} == {(1, 6), (2, 0)}


def test_largest_remainder(spark):
    df = spark.createDataFrame([("new", 5), ("tm_100", 3), ("internal_repeat", 2)], "band string, words long")
    got = {r.band: r.scaled for r in repetition.largest_remainder(df, F.lit(7.0), "band").collect()}
    assert sum(got.values()) == 7 and got["new"] in (3, 4)


@pytest.mark.parametrize("score, want", [(1.0, "tm_100"), (0.95, "tm_95_99"), (0.9, "tm_85_94"), (0.8, "tm_75_84"), (0.6, "tm_50_74"), (0.4, "new"), (None, "new")])
def test_bands(spark, score, want):
    assert spark.range(1).select(repetition.band(F.lit(None), F.lit(score).cast("double"))).first()[0] == want


@pytest.mark.parametrize("done, total, want", [(3, 7, 42), (199, 200, 99), (0, 5, 0), (5, 5, 100), (0, 0, 0)])
def test_progress(spark, done, total, want):
    assert spark.range(1).select(reports.progress(F.lit(done), F.lit(total))).first()[0] == want


def test_propagation_needs_two_and_prefers_confirmed(spark):
    rows = [("k", 1, False, "manual", 9, "a"), ("k", 2, True, "tm", 1, "b"), ("x", 3, True, "tm", 1, "c")]
    df = spark.createDataFrame(rows, "key string, id long, confirmed boolean, source string, updated_at long, target_text string")
    assert [(r.key, r.id) for r in propagation.winners(df, "key").collect()] == [("k", 2)]


RULES = [
    ("repeated_punctuation", "x", "Wait.. ok... no!!", 2),
    ("multiple_spaces", "x", "a  b   c", 2),
    ("trailing_space", "x", "a ", 1),
    ("number_mismatch", "2,000.5 and 24", "24 and 25", 2),
    ("consecutive_duplicate_words", "a b", "the the end", 1),
    ("consecutive_duplicate_words", "the the", "the the end", 0),
    ("ending_punctuation_mismatch", "Ende.", "End!", 1),
    ("ending_punctuation_mismatch", "结束。", "End.", 0),
    ("parameter_mismatch", "{a} %s", "{a}", 1),
    ("email_mismatch", "x@y.org", "", 1),
    ("link_mismatch", "www.a.org/b", "www.a.org/b", 0),
    ("symbol_mismatch", "5 €", "5", 1),
    ("source_target_identical", "Same", "Same", 1),
    ("word_count_exceeds", "one two", "one two three four", 1),
    ("target_tag_missing", "<b>a</b> <i>b</i>", "<b>a</b>", 1),
    ("initial_case_mismatch", "Abc", "abc", 1),
    ("unpaired_marks", "x", "(a [b)", 1),
    ("unbalanced_tags", "x", "<b>a<i>b</i>", 1),
]


@pytest.mark.parametrize("rule, source, target, want", RULES)
def test_rules(spark, rule, source, target, want):
    df = spark.createDataFrame([(1, source, target)], "id long, source_text string, target_text string")
    assert quality_rules.issues(df, [rule]).count() == want


def test_terms_do_not_overlap(spark):
    texts = spark.createDataFrame([(1, "The data base of data bases and it"), (2, "IT and with")], "text_id long, text string")
    wanted = spark.createDataFrame([(1, "data base"), (2, "data"), (3, "IT")], "term_id long, term string")
    assert {(r.text_id, r.term_id): r.hits for r in terms.term_matches(texts, wanted).collect()} == {(1, 1): 1, (1, 2): 2, (2, 3): 1}
    spans = {r.text_id: [(s.start, s.term) for s in r.spans] for r in terms.glossary_matches(texts, wanted).collect()}
    assert spans == {1: [(4, "data base"), (17, "data")], 2: [(0, "IT")]}


def test_alignment_covers_every_unit_once(spark):
    source = ["Title", "One sentence here", "Another sentence 12", "Closing words"]
    target = ["Title", "Ein Satz hier", "Noch ein", "Satz 12", "Schluss"]
    units = [(1, "source", i, t) for i, t in enumerate(source)] + [(1, "target", i, t) for i, t in enumerate(target)] + [(2, "source", 0, "alone")]
    df = spark.createDataFrame(units, "pair_id long, side string, unit_index int, text string")
    pairs = alignment.align(df)
    assert alignment.integrity(df, pairs).count() == 0
    first = pairs.where("pair_id = 1 AND pair_order = 0").first()
    assert first.src == [0] and first.tgt == [0] and first.method == "anchor"


def test_rule_settings_are_normalised():
    from lexibridge.operators import quality_rules

    got = quality_rules.rule_settings({"a": {"enabled": False, "severity": "high", "threshold": 9999}, "b": {"severity": "odd", "threshold": "x"}, "z": {}}, ["a", "b", "c"])
    assert got == {"a": {"enabled": False, "severity": "high", "threshold": 500}, "b": {"enabled": True, "severity": "medium", "threshold": 50}, "c": {"enabled": True, "severity": "medium", "threshold": 50}}


def test_vector_scores_raise_fuzzy_scores(spark):
    from lexibridge.operators import memory

    q = spark.createDataFrame([(1, "the quick brown fox")], "query_id int, text string")
    e = spark.createDataFrame([(1, "the quick brown cat"), (2, "wholly other words")], "entry_id int, source_text string")
    plain = {r.entry_id: r.score for r in memory.fuzzy_matches(q, e, 0.3).collect()}
    v = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.99)], "query_id int, entry_id int, score double")
    raised = {r.entry_id: r.score for r in memory.fuzzy_matches(q, e, 0.3, vectors=v).collect()}
    assert raised[1] == round(0.65 * plain[1] + 0.35, 4) and 2 not in plain and 2 in raised


def test_trigrams_by_blocks_of_entries(spark, monkeypatch):
    """Entries in many blocks, some without any trigram, give the same best few; no row a trigram is joined."""
    words = "alpha beta gamma delta epsilon zeta".split()
    entries = spark.createDataFrame([(i, " ".join(words[(i * k) % 6] for k in range(1, 5))) for i in range(40)] + [(40, "..."), (41, "")], "entry_id long, source_text string")
    queries = spark.createDataFrame([(f"q{i}", " ".join(words[(i + k) % 6] for k in range(4))) for i in range(6)] + [("none", "、、"), ("number", "12")], "query_id string, text string")
    whole = sorted(map(tuple, memory.trigram_candidates(queries, entries).collect()))
    monkeypatch.setattr(memory, "ENTRY_BLOCK", 5)
    parts = memory.trigram_candidates(queries, entries)
    assert whole and sorted(map(tuple, parts.collect())) == whole
    assert "Join" not in parts._jdf.queryExecution().executedPlan().toString()


def test_ratio_from_keeps_what_reaches_the_bound(spark):
    rows = [("abcd", "abdc", 0.8), ("abcd", "abce", 0.7), ("", "", 0.5), (None, "x", 0.5), ("aab", "aba", 0.9), ("abc", "xyz", 0.2)]
    got = spark.createDataFrame(rows, "a string, b string, low double").select("low", S.sequence_ratio("a", "b").alias("whole"), S.ratio_from("a", "b", "low").alias("bounded")).collect()
    assert all(r.bounded == r.whole if r.whole >= r.low else r.bounded >= r.whole for r in got) and all(r.bounded < r.low or r.bounded == r.whole for r in got)


def test_vector_matches_of_extreme_vectors(spark):
    """Blocks of matrices scale vectors first: huge ones, whose squares overflow, are found too."""
    rows = [(1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1e-200]), (4, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "entry_id long, vector array<double>")
    got = memory.vector_matches(e.withColumnRenamed("entry_id", "query_id"), e).collect()
    assert sorted((r.query_id, r.entry_id, r["rank"]) for r in got) == [(1, 2, 1), (2, 1, 1)]


def test_words_and_numbers_of_a_segment_are_found_once(spark):
    """Work on two texts must not be done again for every word or number of them."""
    pairs = spark.createDataFrame([("Aa 1 2 bb. Cc", "aA 2 1 BB, CamelCase aA cC")], "source_text string, target_text string")
    found = pairs.select(*[Q.rules()[r].alias(r) for r in ("same_word_case_mismatch", "multiple_upper_initials", "number_mismatch")])
    assert [[(x.offset, x.length, x.detail) for x in c] for c in found.first()] == [[(7, 2, "BB"), (0, 2, "aA"), (24, 2, "cC")], [(11, 9, "CamelCase")], []]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(pairs.select(Q.rules()["same_word_case_mismatch"].alias("found"))).count("regexp_extract_all(") == 3
    report = number_report(pairs)
    assert [(r.missing, r.extra, r.reordered) for r in report.collect()] == [([], [], True)]
    assert plan(report).count("regexp_extract_all(") == 2


def test_words_of_texts_are_cut_and_counted_once(spark, data):
    """Both uses of the counts of words by file are one shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.queries()["repetition_word_intervals"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Generate explode") == 1 and "ReusedExchange" in plan


def fuzzy_brute_force(queries, entries, threshold, results, floor=0.0):
    """Every query against every entry of its length band: score, rank as `fuzzy_matches` has them, without any recall before."""
    want = set()
    for q, t in queries:
        a, scored = grams(t), []
        for e, s in entries:
            b, n = grams(s), len(t)
            if max(1, int(0.4 * n) - 4) <= len(s) <= max(n + 12, int(2.2 * n) + 12):
                likeness = len(a & b) / len(a | b)
                score = max(likeness, SequenceMatcher(None, t, s).ratio())
                if (score := round(score if t == s else min(score, 0.99), 4)) >= threshold and likeness >= floor:
                    scored.append((-score, e))
        want |= {(q, e, -score, k + 1) for k, (score, e) in enumerate(sorted(scored)[:results])}
    return want


def test_fuzzy_matches_are_not_cut_by_rank_or_trigrams(spark):
    """More than three entries of a query count, the best by ratio is found whatever its rank by trigrams, and one that shares few trigrams is found too."""
    near = [(i, f"the quick brown fox jumps over the lazy dog {w}") for i, w in enumerate("one two six ten four five nine".split())]
    entries = [*near, (20, "dog the quick brown fox jumps over the lazy"), (30, "XbcdeXghijXlmnoXqrst"), (40, "the quick brown fox jumps over the lazy dog six")]
    queries = [("many", "the quick brown fox jumps over the lazy dog six"), ("apart", "abcdefghijklmnopqrst"), ("none", "wholly other words of some length")]
    got = memory.fuzzy_matches(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(entries, "entry_id long, source_text string"))
    got = {(r.query_id, r.entry_id, r.score, r["rank"]) for r in got.collect()}
    assert got == fuzzy_brute_force(queries, entries, 0.8, 5)
    assert len([r for r in got if r[0] == "many"]) == 5 and ("apart", 30, 0.8, 1) in got


@pytest.mark.parametrize("threshold,results,block,floor", [(0.8, 5, 4096, 0.0), (0.6, 2, 30, 0.0), (0.5, 50, 4096, 0.0), (0.5, 1, 4096, 0.3)])
def test_fuzzy_matches_equal_brute_force(spark, data, monkeypatch, threshold, results, block, floor):
    """Of texts of all lengths, in one block and in many, with copies of entries beyond the number of results."""
    monkeypatch.setattr(memory, "ENTRY_BLOCK", block)
    bench = [r[0] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect()]
    texts = [" ".join(s.split()) for t in bench for s in t.replace("\n", ".").replace(",", "").split(".") if s.strip()][:110]
    texts += [" ".join(texts[i : i + 9]) for i in range(0, 60, 9)]
    entries = list(enumerate(texts + texts[:9] * 3))
    damaged = [t[: len(t) // 3] + t[len(t) // 3 + 2 :] for t in texts] + [t.upper() for t in texts[::3]] + [t.replace("e", "a") for t in texts[::2]]
    queries = [(f"q{i}", t) for i, t in enumerate(" ".join(t.split()) for t in texts[::2] + damaged) if len(t) > 4]
    got = memory.fuzzy_matches(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(entries, "entry_id long, source_text string"), threshold, results, floor=floor)
    assert {(r.query_id, r.entry_id, r.score, r["rank"]) for r in got.collect()} == fuzzy_brute_force(queries, entries, threshold, results, floor)


def test_floor_leaves_out_what_shares_few_trigrams(spark):
    q = spark.createDataFrame([(1, "abcdefghijklmnopqrst"), (2, "the quick brown fox")], "query_id int, text string")
    e = spark.createDataFrame([(1, "XbcdeXghijXlmnoXqrst"), (2, "the quick brown cat")], "entry_id int, source_text string")
    assert {(r.query_id, r.entry_id) for r in memory.fuzzy_matches(q, e, 0.5).collect()} == {(1, 1), (2, 2)}
    assert {(r.query_id, r.entry_id) for r in memory.fuzzy_matches(q, e, 0.5, floor=0.3).collect()} == {(2, 2)}


def test_bounds_of_common_subsequences():
    """Bit-parallel lengths of one word and of many equal the table method; pairs that fall short of the need stay below it."""
    import random

    import numpy as np

    from lexibridge.functions import sequences

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *step(row, x, b)]
        return row[-1]

    def step(row, x, b):
        left, out = 0, []
        for j, y in enumerate(b):
            left = row[j] + 1 if x == y else max(left, row[j + 1])
            out.append(left)
        return out

    random.seed(3)
    a = ["".join(random.choices("abcdeé€", k=random.choice([1, 5, 63, 64, 65, 127, 128, 129, 300, 330]))) for _ in range(14)]
    b = ["".join(random.choices("abcdeé€", k=random.choice([1, 7, 64, 100, 129, 290]))) for _ in range(14)]
    row, entry = (x.ravel() for x in np.indices((14, 14)))
    want = np.array([longest(a[i], b[j]) for i, j in zip(row, entry)])
    x, y = sequences.Signs(a), sequences.Signs(b)
    assert (sequences.common_lengths(x, y, row, entry, np.zeros(len(row))) == want).all()
    need = np.array([random.choice([w, w + 1, w * 1.3]) for w in want])
    got = sequences.common_lengths(x, y, row, entry, need)
    assert ((got == want) | ((want <= got) & (got < need))).all()
    # Signs of one kind count as one: never less than the true length.
    c = [t.replace("a", chr(ord("a") + 64)) for t in a]
    assert (sequences.common_lengths(sequences.Signs(c), y, row, entry, np.zeros(len(row))) >= [longest(c[i], b[j]) for i, j in zip(row, entry)]).all()


def test_chunks_are_dealt_out_evenly(spark):
    """Every partition meets one chunk of the queries, so none waits for several."""
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("some words "), "id").alias("text"))
    entries = spark.range(5).select(F.col("id").alias("entry_id"), F.concat(F.lit("some words "), "id").alias("source_text"))
    placed = memory._met(queries, entries).select("chunk", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(placed) == len({r.part for r in placed}) == len({r.chunk for r in placed}) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_first_bounds_lose_no_pair(monkeypatch):
    """Few facts, many rests: pairs that reach the score by trigrams or ratio pass, not all pairs of like lengths do."""
    monkeypatch.setattr(memory, "FACTS", 20)
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefg hij klm") for _ in range(r.randrange(12, 70))).strip() or "a" for _ in range(60)]
    changed = ["".join(r.choice("xyz") if r.random() < 0.06 else c for c in t) for t in texts]
    grams = lambda t: sorted({hash(g) for w in re.findall(r"\w+", t) for g in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))})
    batch = lambda ts: pa.record_batch({"entry_id": pa.array(range(len(ts)), pa.int64()), "text": ts, "grams": pa.array([grams(t) for t in ts], pa.list_(pa.int64())), "length": pa.array([len(t) for t in ts], pa.int64()), "low": pa.array([0] * len(ts), pa.int64()), "high": pa.array([10**6] * len(ts), pa.int64())})
    block, rows = memory._Texts([batch(texts)], 5), batch(changed)
    row, entry, _ = block.pairs(rows, sequences.Signs(changed).counts(), 0.8, 0.0)
    got = {(i, block.texts[j]) for i, j in zip(row.tolist(), entry.tolist(), strict=True)}
    like = lambda a, b: len(set(grams(a)) & set(grams(b))) / len(set(grams(a)) | set(grams(b)))
    want = {(i, t) for i, c in enumerate(changed) for t in set(texts) if like(c, t) >= 0.8 or SequenceMatcher(None, c, t).ratio() >= 0.8}
    near = sum(2 * min(len(c), len(t)) >= 0.8 * (len(c) + len(t)) for c in changed for t in set(texts))
    assert len(want) > 30 and want <= got and len(got) < near


def test_ratio_ends_early_below_what_counts():
    r = random.Random(3)
    for n in range(400):
        a = "".join(r.choice("abcde fgh"[: r.choice((2, 4, 9))]) for _ in range(r.choice((0, 3, 20, 60, 260))))
        b = "".join(r.choice("xyz ab") if r.random() < 0.1 else c for c in a) if n % 2 else "".join(r.choice("abc de") for _ in range(r.choice((0, 5, 30, 250))))
        whole = SequenceMatcher(None, a, b).ratio()
        for least in (0.0, 0.5, 0.8, whole):
            got = sequences.ratio_from(a, b, least)
            assert got == whole if whole >= least else got < least
