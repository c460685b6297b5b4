r"""Source divergence audit: which terms a source uses more than its language does, and how far sources differ.

Terms are counted where their texts lie, so that a task sends one row for each term of a group.
Only terms in at least three documents of their language are kept.

Terms of a group are searched by upper bounds. Terms of one count in the group and of like
counts in the language are a bucket; its least possible language probability bounds what any of its terms
can score. Buckets are opened best bound first until they hold k terms; then every bucket whose bound is
not strictly below the k-th score found is opened, and no unseen term can belong to the result.

Pairs of sources are worked out from postings. A term that neither of two sources uses scores the same for all
such terms, one that a single source uses depends on its count and the other's size alone; both are summed up from
the histograms of counts. Only where sources meet in a posting is a correction added, in whole arrays.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.llm.common import materialise

ONE = 1_000_000_000
#: A term is kept if so many documents of its language have it; so many terms are reported for a group.
DOCUMENTS, TERMS = 3, 200
#: Terms that a task counts before it passes its counts on, bytes of a text that it looks at at once, and pairs that it holds.
HELD_TERMS, PIECE, HELD_PAIRS = 400_000, 4_000_000, 1 << 21
#: Letters and all that is not ASCII belong to terms; capital ASCII letters are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time."""
    start = 0
    while start < len(text):
        stop = len(text) if len(text) - start <= PIECE else text.find(b" ", start + PIECE)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term in what a task has read of a group."""
    times: dict[tuple[str, str], Counter] = {}
    held: dict[tuple[str, str], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in times.items():
            size = len(terms)
            yield pa.record_batch(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64()), pa.array([held[lang, source][t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        times.clear()
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = times.setdefault((lang, source), Counter())
            own: set[bytes] = set()
            for words in _pieces(text.translate(_FOLD)):
                terms.update(words)
                own.update(words)
            held.setdefault((lang, source), Counter()).update(own)
        if sum(map(len, times.values())) > HELD_TERMS:
            yield from flush()
    yield from flush()


def _share(n: Column | str, size: Column | str, kept: Column | str) -> Column:
    """1 + floor(10^9 (n + 1) / (size + kept)); the product may exceed 64 bits."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.call_function("div", (col(n) + 1).cast("decimal(20,0)") * F.lit(ONE), (col(size) + col(kept)).cast("decimal(20,0)")).cast("long") + 1


def _score(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, other, extra): what sources that share terms score beyond what their sizes and counts alone give.

    Rows (lang, term, source, p, p0) come sorted by lang and term; p0 is the share of a term that the source lacks.
    """
    names: dict[tuple[str, str], int] = {}
    sums: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        codes, values = (np.concatenate(x) for x in zip(*sums, strict=True)) if sums else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        codes, at = np.unique(codes, return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, at, values)
        return codes, total

    def rows(codes: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        known = list(names)
        left, right = (codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist()
        return pa.record_batch([pa.array([known[x][0] for x in left], pa.string()), pa.array([known[x][1] for x in left], pa.string()), pa.array([known[x][1] for x in right], pa.string()), pa.array(total)], names=["lang", "source", "other", "extra"])

    def meet(term: np.ndarray, who: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        sizes = np.diff(np.append(starts, len(term)))
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        ends = np.cumsum(size)
        at = 0
        while at < len(term):
            # At least one posting, and as many as have a bounded number of partners.
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_PAIRS, side="right")))
            left = np.repeat(np.arange(at, stop), size[at:stop])
            right = np.arange(len(left)) - np.repeat(np.cumsum(size[at:stop]) - size[at:stop], size[at:stop]) + first[left]
            other = left != right
            left, right = left[other], right[other]
            score = lambda a, b: (a - b) ** 2 // b
            a, a0, b, b0 = p[left], p0[left], p[right], p0[right]
            sums.append(((who[left] << 32) | who[right], score(a, b) - score(a, b0) - score(a0, b) + score(a0, b0)))
            sums[:] = [reduced()]
            at = stop

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if t.num_rows:
            lang, term = t.column("lang").to_pylist(), t.column("term").to_pylist()
            # The last term may go on in the next batch.
            stop = t.num_rows
            while stop and (lang[stop - 1], term[stop - 1]) == (lang[-1], term[-1]):
                stop -= 1
            rest = t.slice(stop)
            _number(t.slice(0, stop), names, meet)
            if sums and len(sums[0][0]) > HELD_PAIRS:
                yield rows(*sums.pop())
                names.clear()
    if rest is not None:
        _number(rest, names, meet)
    yield rows(*reduced())


def _number(t: pa.Table, names: dict[tuple[str, str], int], meet: Callable[..., None]) -> None:
    """Number the sources and the runs of equal terms of `t`, and let them meet."""
    if t.num_rows:
        lang, term = t.column("lang").to_pylist(), t.column("term").to_pylist()
        who = np.array([names.setdefault(k, len(names)) for k in zip(lang, t.column("source").to_pylist(), strict=True)], np.int64)
        run = np.cumsum([i > 0 and (lang[i], term[i]) != (lang[i - 1], term[i - 1]) for i in range(t.num_rows)])
        meet(run, who, t.column("p").to_numpy(), t.column("p0").to_numpy())


def audit(docs: DataFrame, documents: int = DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of `docs`.

    Part `pair` has each other source of the language with the summed score over all kept terms; part `term` the
    `terms` best of the terms that the group uses more than its language. Ranks follow the value, ties the item's UTF-8 bytes.
    A null text, lang or source is ''. Groups whose language keeps no terms score 0 in every pair. Repeated rows count as documents
    of their own. Only these three columns are read, so others may have any names; an empty table gives no rows.
    """
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    counted = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    by_term = Window.partitionBy("lang", "term")
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = summed.select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("docs"), F.sum("n").over(by_term).alias("total"), (F.min("source").over(by_term) == F.col("source")).alias("lead"))
    kept = materialise(spread.where(F.col("docs") >= documents).drop("docs"))

    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("lead").cast("long")).alias("leads"))
    of_lang = of_group.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("leads").alias("kept"))
    joined = read.select("lang", "source").distinct().join(of_group.drop("leads"), ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("size", "lang_size", "kept")}
    stats = materialise(joined.withColumns(zero).withColumn("p0", F.when(F.col("kept") > 0, _share(F.lit(0), "size", F.greatest("kept", F.lit(1))))))

    postings = materialise(kept.join(stats, ["lang", "source"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", "lang_size", "kept", "p0", _share("n", "size", "kept").alias("p")))
    return _best_terms(postings, terms).unionByName(_pairs(postings, stats))


def _best_terms(postings: DataFrame, k: int) -> DataFrame:
    """The k best terms of each group by bounds of buckets."""
    p, q = F.col("p"), F.col("q")
    least = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("total")) - 1)
    more = postings.select("lang", "source", "term", "p", _share("total", "lang_size", "kept").alias("q"), _share(least, "lang_size", "kept").alias("low")).where("p > q")
    bounded = more.withColumn("bound", _score(p, F.col("low")))
    buckets = bounded.groupBy("lang", "source", "bound").agg(F.count("*").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy("lang", "source").orderBy(F.col("bound").desc()).rowsBetween(Window.unboundedPreceding, -1))
    opened = buckets.select("lang", "source", "bound", F.coalesce(ahead, F.lit(0)).alias("ahead")).where(F.col("ahead") < k).groupBy("lang", "source").agg(F.min("bound").alias("bar"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("term"))

    def best(open_from: DataFrame) -> DataFrame:
        scored = bounded.join(open_from, ["lang", "source"]).where("bound >= bar").select("lang", "source", "term", _score(p, q).alias("value"))
        return scored.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= k)

    # All scores here are of terms with p > q, so that a group of fewer than k opens everything.
    kth = best(opened).groupBy("lang", "source").agg(F.count("*").alias("found"), F.min("value").alias("least")).select("lang", "source", F.when(F.col("found") == k, F.col("least")).otherwise(0).alias("bar"))
    return best(materialise(kth)).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language."""
    extra = postings.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_meetings, "lang string, source string, other string, extra long")
    extra = extra.groupBy("lang", "source", "other").agg(F.sum("extra").alias("extra"))
    # Counts of a group are few against its terms: at most the root of twice its size differ.
    counts = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("held")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "held")).alias("counts"))
    groups = materialise(stats.join(counts, ["lang", "source"], "left").select("lang", "source", "kept", "p0", "counts"))
    one, two = groups, groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("counts").alias("other_counts"))
    both = one.join(two, "lang").where("source <> other")
    neither = _score(F.col("p0"), F.col("q0"))
    none = F.array().cast("array<struct<p: bigint, held: bigint>>")
    summed = lambda held, score: F.aggregate(F.coalesce(F.col(held), none), F.lit(0).cast("long"), lambda to, c: to + c.held * (score(c.p) - neither))
    alone = F.col("kept") * neither + summed("counts", lambda p: _score(p, F.col("q0"))) + summed("other_counts", lambda q: _score(F.col("p0"), q))
    valued = both.select("lang", "source", "other", F.when(F.col("kept") > 0, alone).otherwise(0).alias("alone")).join(extra, ["lang", "source", "other"], "left")
    ranked = valued.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("alone") + F.coalesce("extra", F.lit(0))).alias("value"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))))
