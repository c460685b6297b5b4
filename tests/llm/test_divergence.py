"""The divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexibridge.llm import divergence

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(given, k=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in given:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    kept = {g: sorted(t for t, n in c.items() if n >= 3) for g, c in docs.items()}
    share = {}
    for g, s in counts:
        for name, c in ((s, counts[g, s]), (None, sum((counts[x] for x in counts if x[0] == g), Counter()))):
            size = sum(c[t] for t in kept[g]) + len(kept[g])
            share[g, name] = {t: 1 + 10**9 * (c[t] + 1) // size for t in kept[g]}
    out = []
    for g, s in counts:
        p, q = share[g, s], share[g, None]
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept[g] if counts[g, s][t] and p[t] > q[t]]
        pairs = [(sum((p[t] - share[g, o][t]) ** 2 // share[g, o][t] for t in kept[g]), o) for h, o in counts if h == g and o != s]
        for part, found, most in (("term", terms, k), ("pair", pairs, None)):
            for n, (value, item) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most], 1):
                out.append((g, s, part, item, value, n))
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def made(seed, n, sources):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Ze", "éa", "日", "ß") for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(n):
        s = r.randrange(sources)
        text = r.choice((" ", "-", "1", "\n")).join(r.choice(words[s * 7 :] if r.random() < 0.6 else words) for _ in range(r.randint(0, 40)))
        rows.append((r.choice((text, text, text, None)) if i % 9 == 0 else text, r.choice(("en", "de", None)), f"src{s}" if s else None))
    return rows


@pytest.mark.parametrize("k", [200, 5, 1])
def test_audit_equals_brute_force(spark, k):
    given = made(4, 260, 9)
    df = spark.createDataFrame([(*g, 1, "x", 2) for g in given], "text string, lang string, source string, n long, term string, total long").repartition(5)
    assert found(df, terms=k) == brute(given, k)


def test_awkward_and_empty_tables(awkward, nothing):
    assert found(awkward) == brute([tuple(r) for r in awkward.select("text", "lang", "source").collect()])
    assert found(nothing) == []


def test_groups_without_terms_and_single_sources(spark):
    given = [(None, "en", "a"), ("one two", "en", "b"), ("", "fr", "a"), ("x y", "de", "a"), ("x y", "de", "a"), ("x", "de", "a")]
    assert found(spark.createDataFrame(given, "text string, lang string, source string")) == brute(given)


def test_counts_of_parts_of_texts_add_up(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    rows = made(2, 60, 3)
    batches = [pa.record_batch([pa.array([g or "" for _, g, _ in part]), pa.array([s or "" for _, _, s in part]), pa.array([(t or "").encode() for t, _, _ in part], pa.binary())], names=["lang", "source", "text"]) for part in (rows[:25], rows[25:])]
    times, docs, want, held = Counter(), Counter(), Counter(), Counter()
    for batch in divergence._count(iter(batches)):
        for r in batch.to_pylist():
            times[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    for t, g, s in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        want.update((g or "", s or "", x.encode()) for x in terms)
        held.update((g or "", s or "", x.encode()) for x in set(terms))
    assert (times, docs) == (want, held)


def test_meetings_over_batches_of_any_size(monkeypatch):
    r = np.random.default_rng(3)
    rows = [(g, f"t{t}", f"s{s}", int(r.integers(50, 10**9)), 40 + s) for g in ("de", "en") for t in range(30) for s in sorted(r.choice(8, r.integers(1, 8), replace=False).tolist())]
    want = Counter()
    score = lambda a, b: (a - b) ** 2 // b
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] != b[2]:
                want[a[0], a[2], b[2]] += score(a[3], b[3]) - score(a[3], b[4]) - score(a[4], b[3]) + score(a[4], b[4])
    for size, held in ((1, 3), (7, 20), (1000, 1 << 20)):
        monkeypatch.setattr(divergence, "HELD_PAIRS", held)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "p", "p0"), x, strict=True)) for x in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = Counter()
        for batch in divergence._meetings(iter(batches)):
            for x in batch.to_pylist():
                got[x["lang"], x["source"], x["other"]] += x["extra"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
