"""Token counts and byte-level BPE against the public libraries."""

import base64
from functools import cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexibridge.llm import bytebpe, queries, tokencount

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

ODD = ["", " ", "  ", "a  b   c", " a", "a ", "\n", "a\n\nb", "▁", "a▁b", "▁▁", "<s>", "</s> x", "<unk>", "<0x41>", "ﬁ é é", "日本語", "🙂", "\t", "a\tb", " ", "  x", "1234567", "don't", "we'll they've 's'", "'s's", " 's", "\r\n", "  \n  x", "x  y", "\x00", "ß", "aaaaaaaaaaaaaaaaaaaaaaaa", "??!!..", "​", "٣٤ ½ Ⅷ"]
TEXT = st.text(alphabet=st.sampled_from(list("ab eE's.,\n\t 1é▁日🙂́ lrvtdm")), max_size=40)


@cache
def counter():
    return tokencount.PrefixCounter(PIECES)


@cache
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@cache
def encoder():
    return bytebpe.Encoder(RANKS)


@cache
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_counts(texts):
    totals, kept = counter().count(texts, 5)
    for text, n, k in zip(texts, totals, kept, strict=True):
        assert n == len(pieces().encode(text)), repr(text)
        assert k == max(i for i in range(len(text) + 1) if len(pieces().encode(text[:i])) <= 5), repr(text)


def check_ids(texts):
    for text, ids in zip(texts, encoder().encode(texts), strict=True):
        own = np.frombuffer(ids, "<u4")
        assert own.tolist() == library().encode_ordinary(text), repr(text)
        offsets = encoder().token_offsets(own)
        assert encoder().decode(own, offsets) == text.encode()
        half = len(own) // 2
        assert encoder().decode(own[half:], offsets[half:]) == text.encode()[offsets[half] :]


def test_odd_texts_count_as_library():
    check_counts(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_any_texts_count_as_library(texts):
    check_counts(texts)


def test_tables_hold_every_prefix(docs):
    words = {w for r in docs.limit(5).collect() for w in r.text.split()[:60]}
    for w in words:
        assert counter().table(" " + w) == [0] + [len(pieces().encode("x\n" + (" " + w)[:i])) - len(pieces().encode("x\n")) for i in range(1, len(w) + 2)] or " " + w not in counter().totals


def test_documents_count_as_library(spark, data, docs):
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, data).collect()}
    for r in docs.collect():
        n = len(pieces().encode(r.text))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 4096)


def test_counts_of_awkward_and_empty_tables(awkward, nothing):
    rows = tokencount.count_tokens(awkward, PIECES).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((r.doc_id or -1, len(pieces().encode(r.text or ""))) for r in awkward.collect())
    assert tokencount.count_tokens(nothing, PIECES).collect() == []


def test_odd_texts_encode_as_library():
    check_ids(ODD)
    check_ids([a + b for a in ODD for b in ODD])


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT | st.text(max_size=20), max_size=4))
def test_any_texts_encode_as_library(texts):
    check_ids(texts)


def test_documents_encode_as_library(spark, data, docs):
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, data).collect()}
    for r in docs.collect():
        ids = np.array(library().encode_ordinary(r.text), "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), sha256(ids.tobytes()).hexdigest(), sha256(r.text.encode()).hexdigest())


def test_encoding_of_awkward_and_empty_tables(awkward, nothing):
    encoded = bytebpe.encode_documents(awkward, RANKS)
    want = sorted((r.doc_id or -1, np.array(library().encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in awkward.collect())
    assert sorted((r.doc_id or -1, bytes(r.ids), bytes(r.decoded)) for r in encoded.collect()) == want
    assert sorted((r.doc_id or -1, bytes(r.ids), bytes(r.decoded)) for r in bytebpe.decode_documents(encoded, RANKS).collect()) == want
    assert bytebpe.encode_documents(nothing, RANKS).collect() == []


def timed(work):
    from time import process_time

    start = process_time()
    work()
    return process_time() - start


def test_long_runs_count_as_library():
    texts = [" " * n + tail for n in [*range(1, 70), 1000] for tail in ("", "x", "é", "日本", "\n", " .")]
    check_counts([t for t in texts if len(t) < 100])
    totals, _ = counter().count(texts, 5)
    assert totals == [len(pieces().encode(t)) for t in texts]
    for n, tail in ((200, ""), (1000, "word"), (77, "日x"), (300, "...")):
        word = " " * n + tail
        assert counter().table(word) == [len(pieces().encode("a\n" + word[:i])) - len(pieces().encode("a\n")) for i in range(len(word) + 1)]


def test_time_of_long_runs_is_in_proportion():
    blanks, letters, han = "a" + " " * 100_000 + "b", "letterrun" * 22_223, "語日本漢字" * 12_000
    counter(), encoder()
    assert timed(lambda: counter().count([blanks], 4096)) < 2
    assert timed(lambda: encoder().encode([letters])) < 2
    assert timed(lambda: encoder().encode([han])) < 2
    assert timed(lambda: counter().count([letters[:100_000]], 4096)) < 2
    assert timed(lambda: counter().count([han], 4096)) < 2
    assert counter().count([letters, blanks, han], 1)[0] == [len(pieces().encode(t)) for t in (letters, blanks, han)]
    for text in (letters, han):
        assert np.frombuffer(encoder().encode([text])[0], "<u4").tolist() == library().encode_ordinary(text)


def test_caches_keep_no_long_words():
    counter().count(["x" * 5000, "y" * 70], 5)
    counter().count(["short"], 5)
    encoder().encode(["z" * 5000])
    assert max(map(len, counter().totals)) <= tokencount.CACHE_LONGEST and max(map(len, encoder().known)) <= bytebpe.CACHE_LONGEST
