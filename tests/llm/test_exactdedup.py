"""Exact duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexibridge.llm import exactdedup


def brute(given):
    """Rows of (doc_id, keep_id, size, sha256) and the number of kept rows by group."""
    groups = defaultdict(list)
    for i, t in given:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for bare, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], keep, len(members), hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return out


def check(rows, given):
    order = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=order) == sorted(brute(given), key=order)
    kept = defaultdict(list)
    for r in rows:
        if r.kept:
            kept[r.text_sha256].append(r)
    assert set(kept) == {r.text_sha256 for r in rows}
    assert all(len(k) == 1 and k[0].doc_id == k[0].keep_id for k in kept.values())


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_documents(docs):
    check(exactdedup.exact_duplicates(docs).collect(), pairs(docs))


def test_awkward_and_empty_tables(awkward, nothing):
    check(exactdedup.exact_duplicates(awkward).collect(), pairs(awkward))
    assert exactdedup.exact_duplicates(nothing).collect() == []


def test_copies_that_differ_in_blanks_alone(spark):
    r = random.Random(5)
    given = []
    for i in range(300):
        words = [f"w{k % 50} é{k}" for k in range(i % 7 * 400)]
        given.append((i, "".join(w + r.choice((" ", "\n", "\t", "  ", "\r\n", "\x0b")) for w in words)))
        # A no-break space and one letter more are no blanks.
        given.append((1000 + i, " ".join(words) + r.choice(("", " ", "x"))))
    df = spark.createDataFrame(given, "doc_id long, text string")
    check(exactdedup.exact_duplicates(df).collect(), given)


def test_one_text_may_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "BLOCK_BITS", 3)
    given = [(i, "same text" if i % 3 else f"other {i}") for i in range(900)]
    check(exactdedup.exact_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect(), given)


def test_identifiers_that_two_contents_share_are_drawn_anew(spark):
    given = [(i, f"text {i % 60}") for i in range(120)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    seeds = [exactdedup.verified_seed(df, bits) for bits in (5, 6, 64)]
    assert seeds[0] > 0 and seeds[2] == 0
    check(exactdedup.exact_duplicates(df, 5).collect(), given)


@pytest.mark.parametrize("text", ["", "a", "x" * 100_000, "".join(chr(200 + i % 9000) for i in range(40_000))])
def test_chunks_join_to_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(exactdedup.chunks(F.col("text")).alias("c")).first().c
    assert "".join(got).encode("latin-1").decode() == text
    assert all(exactdedup.LEAST <= len(c) <= exactdedup.MOST for c in got[:-1])


def test_chunks_find_a_passage_wherever_it_lies(spark):
    r = random.Random(1)
    passage = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    texts = [(passage,), ("lead " + passage,), (passage[3:],)]
    got = [set(x.c) for x in spark.createDataFrame(texts, "text string").select(exactdedup.chunks(F.col("text")).alias("c")).collect()]
    assert len(got[0] & got[1]) > 0.8 * len(got[0]) and len(got[0] & got[2]) > 0.8 * len(got[0])
