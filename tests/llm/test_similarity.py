"""Near duplicates of texts and embeddings, components and fingerprints against brute force."""

import random
import re
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from lexibridge.llm import embdedup, fingerprint, neardup, queries
from lexibridge.llm.arrays import weighted
from lexibridge.llm.bagminhash import signatures
from lexibridge.llm.components import components

from .conftest import documents


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limit", [3, 50, 200_000])
def test_components_at_every_partition_size(spark, limit):
    r = random.Random(limit)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(40)] + [(900, i) for i in range(901, 960)] + [(5, 5)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    df = spark.createDataFrame([*edges, (None, 3)], "x long, y long").repartition(5)
    got = {x.id: x.component for x in components(df, "x", "y", limit).collect()}
    assert got == groups_of(nodes, [e for e in edges if e[0] != e[1]])


def test_no_edges_give_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows):
    """Class of every id: equal texts, and pairs of a weighted Jaccard similarity of at least 0.8."""
    bags = {i: shingles(t) for i, t in rows}
    ids = sorted(bags)
    texts = dict(rows)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] is not None and texts[a] == texts[b]:
                links.append((a, b))
            elif bags[a] and bags[b] and min(x := bags[a].total(), y := bags[b].total()) >= 0.8 * max(x, y):
                shared = (bags[a] & bags[b]).total()
                if shared >= 0.8 * (x + y - shared):
                    links.append((a, b))
    return groups_of(ids, links)


def changed(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(1000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Lone texts, small groups, a large group of copies and a large group of near copies."""
    r = random.Random(4)
    make = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(make(60)) for _ in range(60)]
    texts += ["the same text of a few words"] * 90
    for n in (2, 3, 5, 120):
        base = make(140)
        texts += [changed(r, base, r.choice((0, 1, 2, 3))) for _ in range(n)]
    for _ in range(30):
        base = make(100)
        texts += [" ".join(base), changed(r, base, r.randrange(1, 5))]
    chain = make(200)
    for k in range(12):
        texts.append(" ".join(chain[k * 6 :] + make(k * 6)))
    r.shuffle(texts)
    return list(enumerate(texts, 10))


def test_near_duplicates_equal_brute_force(spark, copies):
    got = neardup.near_duplicates(documents(spark, [(i, t, None) for i, t in copies])).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(copies)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_groups_are_compared_whole(spark, copies, monkeypatch):
    """Small blocks, and no bucket small enough to be listed."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK_CHARS", 5_000)
    got = neardup.near_duplicates(documents(spark, [(i, t, None) for i, t in copies])).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(copies)


def test_near_duplicates_of_documents(spark, data, docs):
    got = {r.doc_id: r.class_id for r in queries.op4_minhash_near_dedup(spark, data).collect()}
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_of_awkward_and_empty_tables(awkward, nothing):
    got = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicates(awkward).collect()}
    assert got == {i: (1 if i == 2 else i, i != 2) for i in range(1, 10)}
    kept = neardup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert neardup.near_duplicates(nothing).collect() == [] and neardup.deduplicate(nothing).collect() == []


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(1)
    a = " ".join(f"w{r.randrange(9)}" for _ in range(300))
    b = " ".join(a.split()[:220]) + " " + " ".join(f"w{r.randrange(9)}" for _ in range(120))
    x, y = shingles(a), shingles(b)
    want = (x & y).total() / (x | y).total()
    m = 8192
    s = signatures(*weighted([a, b, ""]), 3, m)
    assert abs((s[0] == s[1]).mean() - want) < 4.5 * (want * (1 - want) / m) ** 0.5
    assert not s[2].any()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string, id long, n long, vector string")


def test_embeddings_equal_sql(spark, data):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = sorted(db.execute(queries.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op8_embedding_near_dedup(spark, data).collect()) == want


def test_embeddings_equal_brute_force(spark):
    random_ = np.random.Generator(np.random.PCG64(3))
    rows, made = [], []
    for i in range(700):
        if i % 3 == 0 or not made:
            v = random_.standard_normal(32)
        else:
            v = made[int(random_.integers(len(made)))] + random_.standard_normal(32) * random_.choice([0, 0.05, 0.1, 0.2, 0.22])
        made.append(v)
        rows.append((i, v.tolist(), int(i % 2) if i % 11 else None, "k", 0, 0, ""))
    hub = random_.standard_normal(32)
    rows += [(2000 + i, (hub + random_.standard_normal(32) * 0.02).tolist(), 1, "k", 0, 0, "") for i in range(300)]
    rows += [(3000 + i, hub.tolist(), 1, "k", 0, 0, "") for i in range(50)]
    unit = {r[0]: np.array(r[1]) for r in rows}
    label = {r[0]: r[2] for r in rows}
    links = []
    ids = sorted(unit)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if label[a] is not None and label[a] == label[b] and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.98:
                links.append((a, b))
    degree, group = Counter(x for p in links for x in p), groups_of(ids, links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_vectors(vectors(spark, rows)).collect()}
    assert got == {i: (degree[i], group[i], group[i] == i) for i in ids}


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (3, [0.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_vectors(vectors(spark, [(*r, "k", 0, 0, "") for r in rows])).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False)} | {i: (0, i, True) for i in range(3, 12)}
    assert embdedup.near_vectors(vectors(spark, [])).collect() == []


def test_code_estimates_are_unbiased_and_bounds_hold():
    random_ = np.random.Generator(np.random.PCG64(8))
    x = random_.standard_normal((2000, 64))
    y = x + random_.standard_normal((2000, 64)) * 0.15
    unit = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y)])
    codes = embdedup.Codes(unit, 12, embdedup.tables_for(12, 0.98))
    a, b = np.arange(2000), np.arange(2000, 4000)
    truth = (unit[a] * unit[b]).sum(1)
    bound = codes.bound(a, b)
    assert (bound >= truth).mean() > 0.9999
    assert abs((bound - embdedup.SIGMAS * codes.error[a] - truth).mean()) < 0.005


def test_fingerprints_equal_brute_force(spark, data, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, data).collect()}
    assert len(got) == len(rows)
    near = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        import base64

        own, other, following = (fingerprint.digests([t.encode()])[0] for t in (text, edited, after[1]))
        assert (base64.b64decode(r.fingerprint), base64.b64decode(r.edited_fingerprint)) == (own, other)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, other), fingerprint.likeness(own, following))
        if text != after[1] and len(text) > 400:
            near.append((r.near_edited, r.near_next))
    edited, following = np.array(near).T
    assert (edited > following).mean() > 0.97 and np.median(edited) > 0.3 and np.median(following) < 0.1


def test_fingerprints_of_awkward_and_empty_tables(awkward, nothing):
    rows = fingerprint.fingerprint_documents(awkward).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == sorted((r.doc_id or -1, len(r.text or "")) for r in awkward.collect())
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[1] == prints[2] and len(prints[1]) == 1 and prints[3] == prints[4] == {""}
    assert fingerprint.fingerprint_documents(nothing).collect() == []


def test_vectors_of_extreme_size(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(n, [x * f for x in base], 1, "k", 0, 0, "") for n, f in enumerate((1.0, 1e250, 1e-250, 3e-160, 7e170))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_vectors(vectors(spark, rows)).collect()}
    assert got == {n: (4, 0) for n in range(5)}


def test_vectors_of_many_lengths(spark):
    """A pair of near vectors of each of 70 lengths."""
    rows = [(2 * n + k, [1.0] * n + [1.0 + k / 1000], 1, "k", 0, 0, "") for n in range(1, 71) for k in (0, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_vectors(vectors(spark, rows)).collect()}
    assert got == {2 * n + k: (1, 2 * n) for n in range(1, 71) for k in (0, 1)}


def test_many_short_texts_take_time_in_proportion():
    from time import process_time

    texts = [f"short text {i} {i * 7919 % 10007}".encode() for i in range(20_000)]
    start = process_time()
    got = fingerprint.digests(texts)
    assert process_time() - start < 2
    assert got[:50] == [fingerprint.digests([t])[0] for t in texts[:50]]


def test_fingerprints_chain_rows_without_ids(spark):
    rows = [(None, f"text without an id, number {i}", None) for i in range(40)] + [(i, f"text of document {i}", None) for i in range(15)] + [(7, "a second text of document 7", None), (None, None, None)]
    got = fingerprint.fingerprint_documents(documents(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t, _ in rows)
    named = sorted(((i, t) for i, t, _ in rows if i is not None), reverse=True)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.edited_sha256)
    for (i, t), (_, after) in zip(named, named[1:]):
        assert sha256(fingerprint.edited(t, after).encode()).hexdigest() in by_id[i]
    # Every row without an id is followed by another one, and the last by the first of all.
    rest = {t or "" for i, t, _ in rows if i is None} | {named[0][1]}
    assert all(any(h == sha256(fingerprint.edited(t, after).encode()).hexdigest() for t in rest for after in rest) for h in by_id[None])


def test_texts_of_one_document_are_kept_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = documents(spark, [(1, a, None), (1, b, None), (2, a, None), (3, b + " more", None), (4, "c d", None), (1, a, None)])
    got = sorted(tuple(r) for r in neardup.near_duplicates(rows).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert sorted((r.doc_id, r.text) for r in neardup.deduplicate(rows).collect()) == [(1, a), (1, b), (4, "c d")]
