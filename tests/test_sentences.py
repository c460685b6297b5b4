"""The sentence expression against hand-made texts and a plain scan of every dot."""

import re

from pyspark.sql import functions as F

from lexibridge.functions import sentences as S
from lexibridge.operators import segmenting

GOLDEN = [
    ("Pi is 3.14 today. See No. 10 for more.", ["Pi is 3.14 today.", "See No. 10 for more."]),
    ("One\ntwo. Three\n\nfour", ["One two.", "Three", "four"]),
    ("Mr. Smith met Dr. Jones. They talked.", ["Mr. Smith met Dr. Jones.", "They talked."]),
    ("The U.S. Treasury said so. J. K. Rowling wrote.", ["The U.S. Treasury said so.", "J. K. Rowling wrote."]),
    ("Apples, pears, etc. The end", ["Apples, pears, etc.", "The end"]),
    ("In 2024. The year", ["In 2024.", "The year"]),
    ("1. Definitions\nText goes on here.", ["1. Definitions", "Text goes on here."]),
    ("你好。世界！真的？", ["你好。", "世界！", "真的？"]),
    ('He said "Stop!" and left. Then ("why?") he ran', ['He said "Stop!"', "and left.", 'Then ("why?")', "he ran"]),
    ("See file.txt now. ok then. Yes", ["See file.txt now. ok then.", "Yes"]),
    ("e.g. one, i.e. two. Done...Really", ["e.g. one, i.e. two.", "Done...", "Really"]),
    ("item iv. of the list. End", ["item iv. of the list.", "End"]),
    ("", []),
    (None, []),
    ("  \n ", []),
]


def test_golden_sentences(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", S.sentences("t").alias("s")).collect()}
    for i, (text, want) in enumerate(GOLDEN):
        assert got[i] == want, text


def ends(text, at):
    """Whether the dot at this place ends a sentence, by looking at it alone."""
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] == "."):
        start -= 1
    word, rest = text[start:at], text[at + 1 :]
    after = rest.lstrip()
    following = (re.match("[A-Za-z]+", after) or [""])[0].lower()
    if word and word[-1].isdigit():
        return not rest[:1].isdigit() and not (not text[text.rfind("\n", 0, start) + 1 : start].strip() and after)
    if word.lower() in S.ABBREVIATIONS:
        return not after or (following in S.STARTERS and following not in ("a", "an"))
    if re.fullmatch("[A-Z]", word):
        return False
    if re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", word):
        if re.match(r"[^\W\d_]\.", rest):
            return False
        return not after or after[0] in "-–—" or (after[0] not in "([（【" and following not in S.CONTINUATIONS and (after[0].isupper() or "㐀" <= after[0] <= "鿿"))
    if re.fullmatch("(?i)[ivxlcdm]+", word):
        return False
    return not (rest[:1].isascii() and rest[:1].isalnum()) and not (rest[:1].isspace() and after[:1].islower())


def test_dots_of_documents_are_judged_as_by_a_scan(spark, data):
    texts = [" ".join((r.text or "").split()) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    texts = [t[:3000] for t in texts] + ["A. B. C. D.E. F. a.b. U.S.A. – x. St. John No. 5 is vol. 3. V. Next (p. 4). End", "x.Y. z. Inc. The co. went. Fig. 2.3. shows. i.e. so. 12. a. B"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(S.sentences("t").alias("s")).collect()]
    for text, own in zip(texts, got, strict=True):
        want, start, i = [], 0, 0
        text = text.strip()
        while i < len(text):
            if text[i] in S.ENDINGS and (text[i] != "." or ends(text, i)):
                while i < len(text) and text[i] in S.ENDINGS:
                    i += 1
                while i < len(text) and text[i] in S.CLOSERS:
                    i += 1
                want.append(text[start:i].strip())
                start = i
            else:
                i += 1
        want.append(text[start:].strip())
        squeeze = lambda xs: [re.sub(r"\s+([。！？!?.，,、；;：:）)\]}])", r"\1", x) for x in xs if x]
        assert own == squeeze(want)


def test_segments_are_numbered_through_the_document(spark):
    units = spark.createDataFrame([("p", 0, "h", "One. Two."), ("p", 1, None, " "), ("p", 2, None, "Three"), ("q", 0, None, "x")], "path string, unit int, key string, text string")
    got = segmenting.segments(units).orderBy("path", "seg_idx").collect()
    assert [(r.path, r.unit, r.sentence, r.seg_idx, r.source_text) for r in got] == [("p", 0, 0, 0, "One."), ("p", 0, 1, 1, "Two."), ("p", 2, 0, 2, "Three"), ("q", 0, 0, 0, "x")]
    assert segmenting.segments(units.where(F.lit(False))).collect() == []


def cut_simply(text):
    """The simpler rules, sign by sign."""
    out, start, i, last = [], 0, 0, len(text)
    while i < last:
        c, ends = text[i], False
        if c in S.SIMPLE_ENDINGS:
            ends = True
        elif c == "." and (i + 1 == last or text[i + 1] in " \n\r\t"):
            so_far = text[start:i]
            word = re.search(r"(?:[^\W\d_]|\.)*\Z", so_far).group().rstrip(".").lower()
            leads = re.fullmatch(r"\d+|[a-zA-Z]|[ivxIVX]+", so_far.lstrip())
            counts = i + 1 < last and so_far.split()[-1:] and so_far.split()[-1].isdigit()
            ends = not leads and word not in S.SIMPLE_ABBREVIATIONS and not counts
        i += 1
        if ends:
            while i < last and text[i] in S.SIMPLE_ENDINGS + ".":
                i += 1
            while i < last and text[i] in S.SIMPLE_CLOSERS:
                i += 1
            out, start = [*out, text[start:i]], i
    return [*out, text[start:]] if start < last else out


SIMPLE = [
    ("One. Two", ["One.", " Two"]),
    ("1. Scope. Next", ["1. Scope.", " Next"]),
    ("See No. 5. Then etc. more", ["See No. 5. Then etc. more"]),
    ('He said "Stop!" and left. x', ['He said "Stop!"', " and left.", " x"]),
    ("你好。」世界！.etc. 真的", ["你好。」", "世界！.", "etc. 真的"]),
    ("i.e. this. v1.2 is file.txt now.", ["i.e. this.", " v1.2 is file.txt now."]),
    ("", []),
    (None, []),
]


def test_simple_sentences(spark):
    import random

    draw = random.Random(5)
    bits = ["a", "iv", "No", "etc", "e.g", "word", "12", "3", ".", ".", "..", " ", " ", "\n", "!", "。", "”", ")", '"', "　", "é", "x1", ",", "i"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 14))) for _ in range(20000)]
    want = [(t, w) for t, w in SIMPLE] + [(t, cut_simply(t)) for t in texts]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "i int, t string").repartition(8)
    for r in df.select("i", S.simple_sentences("t").alias("s")).collect():
        assert r.s == want[r.i][1], want[r.i]


def test_simple_spans_cover_long_texts(spark):
    long = "word, other " * 100_000
    rows = [("p", 0, long), ("p", 1, "A b.  \n"), ("p", 2, None), ("q", 0, "😀 is. No"), ("q", 1, "." * 300_000)]
    got = segmenting.simple_spans(spark.createDataFrame(rows, "path string, unit int, text string")).orderBy("path", "unit", "sentence").collect()
    assert [(r.path, r.unit, r.sentence, r.start, r.end) for r in got] == [("p", 0, 0, 0, len(long)), ("p", 1, 0, 0, 4), ("p", 1, 1, 4, 7), ("q", 0, 0, 0, 5), ("q", 0, 1, 5, 8), ("q", 1, 0, 0, 300_000)]
    assert [r.display_text for r in got[1:5]] == ["A b.", "", "😀 is.", "No"]


def test_simple_spans_of_documents(spark, data):
    from lexibridge.plans import catalogue

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in catalogue.queries()["simple_sentence_spans"](spark, data).orderBy("doc_id", "sentence").collect():
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start : r.end])
    assert got == {i: cut_simply(t) for i, t in texts.items() if t}
