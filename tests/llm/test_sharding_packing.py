"""Sharding and packing against brute force."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexibridge.llm import packing, sharding

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_shards(given, rows, shards):
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((i or -1, t or "") for i, t in given)
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "bytes", None)
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return [size[i] for i in range(shards)]


def test_shards_are_even(spark, docs):
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = sharding.shard_documents(docs).collect()
    sizes = check_shards(given, rows, 8)
    longest = max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= 2 * (longest + sum(sizes) / 8 * 0.02)


def test_equal_texts_lie_together(spark):
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(400)], "doc_id long, text string")
    where = defaultdict(set)
    for r in sharding.shard_documents(df).collect():
        where[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 7


def test_one_text_may_hold_most_rows(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"other {i}") for i in range(3000)], "doc_id long, text string")
    sizes = check_shards([tuple(r) for r in df.collect()], sharding.shard_documents(df).collect(), 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes)


def test_splitters_count_what_lies_below(spark):
    df = spark.createDataFrame([(i, f"t{i % 700}" * (i % 9)) for i in range(2000)], "doc_id long, text string")
    keys = df.select(sharding._key(df.text).alias("_k1"), sharding._key(df.doc_id).alias("_k2"), sharding.text_size(df.text).alias("_size"))
    rows = [((r[0] << sharding.HALF) | r[1], r[2]) for r in keys.collect()]
    total = sum(s for _, s in rows)
    cuts = sharding.find_splitters(keys, 16, 0.001)
    assert len(cuts) == 15
    for i, cut in enumerate(cuts, 1):
        below = [s for k, s in rows if k < cut.edge]
        assert (cut.size, cut.rows) == (sum(below), len(below))
        assert abs(cut.size - total * i / 16) <= max(s for _, s in rows) + total / 16 * 0.001


@pytest.mark.parametrize("parts", [1000, 10_000])
def test_many_parts(spark, parts, monkeypatch):
    df = spark.range(30_000).selectExpr("id AS doc_id", "repeat(cast(id % 20000 AS string), cast(id % 7 AS int)) AS text")
    monkeypatch.setattr(sharding, "shuffle_partitions", lambda _: parts)
    sizes = check_shards([tuple(r) for r in df.collect()], sharding.shard_documents(df).collect(), 8)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8


def test_sharding_of_awkward_and_empty_tables(awkward, nothing):
    check_shards([tuple(r) for r in awkward.select("doc_id", "text").collect()], sharding.shard_documents(awkward).collect(), 8)
    assert sharding.shard_documents(nothing).collect() == []


def one_by_one(lengths, capacity):
    """Best-fit decreasing, each piece on its own: the sorted fills of all sequences."""
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(capacity - n)
    return sorted(free)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice((1, 7, 50, 64))
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 400))]
    count = defaultdict(int)
    for n in lengths:
        count[n] += 1
    used, rows = defaultdict(int), packing.plan(dict(count), capacity)
    for k, (length, rank, first, offset, each) in enumerate(rows.tolist()):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else count[length]
        for piece in range(end - rank):
            s = first + piece // each
            assert used[s] == offset + piece % each * length
            used[s] += length
    assert sorted(capacity - u for u in used.values()) == one_by_one(lengths, capacity)


def check_packing(given, rows, capacity):
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, text in given:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want.append((i or -1, n, at, len(piece), crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == len(one_by_one([w[3] for w in want], capacity))


@pytest.mark.parametrize("capacity", [2048, 100])
def test_packing_equals_library_and_brute_force(docs, capacity):
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_packing(given, packing.pack_documents(docs, WORDS, 0, capacity).collect(), capacity)


def test_packing_of_awkward_and_empty_tables(awkward, nothing):
    check_packing([tuple(r) for r in awkward.select("doc_id", "text").collect()], packing.pack_documents(awkward, WORDS, 0, 2048).collect(), 2048)
    assert packing.pack_documents(nothing, WORDS, 0, 2048).collect() == []


ODD = ["", " ", "\n\n", "a\tb", "a b c", "don't", "DON'T", "É é é", "ﬁ ﬂ", "x<|endoftext|>y", "<|pad|>", "<| endoftext |>", "12345", "a1b2", "ß ẞ İ", "日本語 テスト", "🙂🙂", "\r\n", "a​b", "it's 'quoted'", " x", "µ²", "A.B,C;D", "\x00\x01"]


def test_word_ids_equal_library():
    library, own = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    texts = ODD + [a + b for a in ODD for b in ODD]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_encode_as_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), packing.WordIds(path)
        texts = ["Two  words, 3 signs!", "a\nb\n\nc", "don't é 日本 🙂", "<|endoftext|>", "", "x" * 5000 + " y"]
        for _ in range(2):
            assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert own.by_words == (name == "word_bpe_49k.json")


def test_many_slices_rank_as_few(spark, monkeypatch):
    rows = spark.range(3000).select("id", (F.col("id") % 7 + 1).alias("length"))
    monkeypatch.setattr(packing, "SLICE_PIECES", 3)
    got = packing.pack(rows, 10).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 10
    assert len(by_sequence) == -(-sum(r.length for r in got) // 10)
