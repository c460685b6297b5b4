"""Translation-memory operators: exact and fuzzy lookup, vector lookup, upserts, clean-up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.functions import sequences as Q
from lexibridge.functions import similarity as S
from lexibridge.functions import text as T
from lexibridge.operators import vectorindex as X

#: Recall and result sizes of fuzzy lookup, and the smallest cosine of vector lookup.
TRIGRAM_RECALL, RESULTS, VECTOR_RECALL, VECTOR_FLOOR = 3, 5, 6, 0.45
THRESHOLD = 0.8
#: Where ratios from a half on count, texts that are less alike by trigrams match by chance: no match by definition (the bar of the trigram look-up too).
TRIGRAM_FLOOR = 0.3
#: The highest score of texts that are not equal.
MISMATCH_CEILING = 0.99
#: Entries of the memory that one task meets at once.
ENTRY_BLOCK = 4096
#: Pairs of a query and an entry, and trigrams that they share, that are counted at once.
CELLS, POSTINGS = 2**20, 2**21
#: Facts about signs that texts are first compared by, and rows that are compared at once.
FACTS, ROWS = 384, 128


def in_scope(entries: DataFrame, collections: list | None) -> DataFrame:
    """Entries of the listed collections: None means all, an empty list none."""
    return entries if collections is None else entries.where(F.col("collection_id").isin(collections) if collections else F.lit(False))


def exact_matches(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """`segments` (with source_hash) with the matching entry of lowest collection and id, or nulls.

    Entries are reduced to one per hash before the join, so repeated segments meet one row each.
    """
    best = entries.withColumn("source_hash", T.source_hash("source_text")).groupBy("source_hash").agg(F.min(F.struct("collection_id", "entry_id", "target_text")).alias("m"))
    return segments.join(best, "source_hash", "left").select(*segments.columns, F.col("m.entry_id").alias("entry_id"), F.col("m.target_text").alias("target_text"))


def fuzzy_allowed(c: Column | str) -> Column:
    """Fuzzy lookup is for texts with letters or digits that are no bare numbering."""
    return T.has_searchable_content(c) & ~T.is_structural_fragment(c)


def trigram_candidates(queries: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, recall: int = TRIGRAM_RECALL) -> DataFrame:
    """The `recall` most similar entries by trigrams for every query text.

    queries: query_id, text; entries: entry_id, source_text. Gives query_id, entry_id, similarity,
    rank; similarity is at least min(max(threshold, 0.01), 0.3) and the length lies in the band.
    """
    bar = min(max(threshold, 0.01), 0.3)
    scored = _met(queries, entries).drop("text").mapInArrow(trigram_scorer(bar, recall), f"{_ids(queries, entries)}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= recall)


def _ids(queries: DataFrame, entries: DataFrame) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (entries, "entry_id")))


def _met(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Every query beside every entry: rows in order of (block, chunk, kind), entries (kind 0) before queries, with match text, trigrams and length band.

    Entries are cut into blocks of at most about ENTRY_BLOCK, and queries into chunks; each chunk streams past each block, which counts
    the trigrams that it shares with every entry from the block's postings and keeps the query's best few. Texts move once a block.
    No pair is left out here.
    """
    # Trigrams as numbers: sets of them intersect without touching strings.
    numbered = lambda df: df.withColumns({"grams": F.transform(S.word_trigrams("text"), lambda g: F.xxhash64(g)), "length": F.length("text").cast("long")})
    blocks = max(1, -(-entries.count() // ENTRY_BLOCK))
    chunks = 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    asked = queries.where(fuzzy_allowed("text")).select(every(blocks).alias("block"), part("query_id", chunks).alias("chunk"), F.lit(1).alias("kind"), "query_id", none(entries, "entry_id"), T.match_or_normalized("text").alias("text"))
    held = entries.select(every(chunks).alias("chunk"), "entry_id", "source_text").select(part("entry_id", blocks).alias("block"), "chunk", F.lit(0).alias("kind"), none(queries, "query_id"), "entry_id", T.match_or_normalized("source_text").alias("text"))
    # A chunk is a partition: hashed keys would leave some partitions with several chunks and others with none.
    met = numbered(held.unionByName(asked).repartitionById(chunks, F.col("chunk").cast("int")).sortWithinPartitions("block", "chunk", "kind"))
    low, high = T.length_band(F.col("length"))
    return met.select("block", "chunk", "kind", "query_id", "entry_id", "text", "grams", "length", low.alias("low"), high.alias("high"))


class _Block:
    """The entries of one block by what trigrams they hold, in order of their ids."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.index(table := _by_id(rows))
        self.ids = table["entry_id"]

    def index(self, table: pa.Table) -> None:
        self.length = table["length"].to_numpy()
        grams = [np.asarray(g, np.int64) for g in table["grams"].to_pylist()]
        self.sizes = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.entry = np.repeat(np.arange(len(grams)), self.sizes)[order]
        self.grams, self.start, self.degree = np.unique(flat[order], return_index=True, return_counts=True)

    def shared(self, rows: pa.RecordBatch, share: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """How many trigrams each row (down) shares with each entry (across), and how many each row has; 0 for rows that share less than `share` of theirs with any entry.

        Where `share` is large, a row's rarest trigrams tell first: an entry that shares so many of all shares some of those.
        """
        lists, n = rows.column("grams"), len(self.sizes)
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        if not len(self.grams) or not len(flat):
            return np.zeros((len(sizes), n), np.int64), sizes
        at, row = np.minimum(np.searchsorted(self.grams, flat), len(self.grams) - 1), np.repeat(np.arange(len(sizes)), sizes)
        known = self.grams[at] == flat
        if share >= 0.5:
            needed = np.ceil(sizes * share - 1e-6).astype(np.int64)
            some = np.maximum(needed // 3, 1)
            order = np.lexsort((np.where(known, self.degree[at], 0), row))
            rare = np.empty(len(flat), bool)
            rare[order] = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row] < (sizes - needed + some)[row]
            rare &= known
            known &= (self.postings(at[rare], row[rare], len(sizes)) >= some[:, None]).any(1)[row]
        return self.postings(at[known], row[known], len(sizes)), sizes

    def postings(self, at: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
        """How many of the trigrams (their places `at`, by row) of each of `count` rows each entry holds."""
        n, start, degree = len(self.sizes), self.start[at], self.degree[at]
        both = np.zeros((count, n), np.int64)
        # As many rows at a time as come to so many postings.
        edges = np.flatnonzero(np.diff(np.cumsum(np.bincount(row, degree, count)) // POSTINGS)) + 1
        for first, last in zip([0, *edges], [*edges, count], strict=True):
            own = slice(*np.searchsorted(row, [first, last]))
            many = degree[own]
            # Places of all postings one after the other.
            place = np.arange(many.sum()) + np.repeat(start[own] - np.cumsum(many) + many, many)
            both[first:last] = np.bincount(np.repeat((row[own] - first) * n, many) + self.entry[place], minlength=(last - first) * n).reshape(-1, n)
        return both

    def best(self, rows: pa.RecordBatch, bar: float, recall: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its best few entries: (row, entry, similarity)."""
        both, sizes = self.shared(rows)
        likeness = both / np.maximum(sizes[:, None] + self.sizes[None, :] - both, 1)
        low, high = (rows.column(c).to_numpy()[:, None] for c in ("low", "high"))
        row, entry = np.nonzero((likeness >= bar) & (self.length >= low) & (self.length <= high))
        score = likeness[row, entry]
        order = np.lexsort((entry, -score, row))
        row, entry, score = row[order], entry[order], score[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) < recall
        return row[few], entry[few], score[few]


def _by_id(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows).sort_by("entry_id").combine_chunks()


def trigram_scorer(bar: float, recall: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `_met` to the best few entries of each query in each block by trigrams."""
    return _scorer(_Block, lambda block, rows: block.best(rows, bar, recall), "similarity")


def _scorer(build: Callable[[list[pa.RecordBatch]], _Block], best: Callable[[_Block, pa.RecordBatch], tuple], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `_met` to what `best` gives (row, entry by its place in the block's ids, score) of the queries and the block that `build` makes of its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("block", "chunk", "kind")])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == stop:
                    continue
                if (at := tuple(marks[:2, start])) != key:
                    key, parts, block = at, [], None
                if marks[2, start] == 0:
                    parts.append(batch.slice(start, stop - start))
                    continue
                if not parts:
                    continue
                block = block or build(parts)
                step = max(16, CELLS // len(block.sizes))
                for first in range(start, stop, step):
                    rows = batch.slice(first, min(step, stop - first))
                    row, entry, score = best(block, rows)
                    ids = block.ids.take(pa.array(entry))
                    yield pa.record_batch([rows.column("query_id").take(pa.array(row)), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(score)], names=["query_id", "entry_id", name])

    return run


#: What rounding may raise a score by at most.
SLACK = 1e-4


class _Texts(_Block):
    """The different texts of one block, each with its first few entries by id: more entries of one text can be no query's best few."""

    def __init__(self, rows: list[pa.RecordBatch], results: int):
        table = _by_id(rows)
        self.ids, held = table["entry_id"], {}
        for place, text in enumerate(table["text"].to_pylist()):
            if len(own := held.setdefault(text, [])) < results:
                own.append(place)
        self.texts, self.results = sorted(held, key=len), results
        self.places = [held[text] for text in self.texts]
        self.index(table.take([own[0] for own in self.places]))
        self.signs = Q.Signs(self.texts)
        counts = self.signs.counts()
        self.most = int(counts.max())
        self.counts = counts.astype(np.min_scalar_type(self.most))
        # A text has at least so many signs of a kind: the commonest of these facts, whose products count what two texts have in common.
        self.peaks = counts.max(0)
        kind = np.repeat(np.arange(Q.KINDS), self.peaks)
        least = np.arange(len(kind)) - np.repeat(np.cumsum(self.peaks) - self.peaks, self.peaks) + 1
        held = np.array([(counts[:, k] >= t).sum() for k, t in zip(kind, least, strict=True)], np.int64)
        told = np.lexsort((least, -held))[:FACTS]
        self.kind, self.least = kind[told], least[told]
        self.facts = self.told(counts)
        self.rest = self.length - self.facts.sum(1)

    def told(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.kind] >= self.least).astype(np.float32)

    def alike(self, hit: np.ndarray, own: np.ndarray, counts: np.ndarray, need: float) -> None:
        """Marks in `hit` the pairs of a row (down) and an entry (across) that may reach a ratio of `need` by their lengths and signs.

        Signs beyond what the facts tell count as common as far as both texts have any, so that no pair is lost.
        """
        # Entries are in order of lengths: those that may reach a ratio lie side by side.
        share = max(need, 1e-9) / 2
        first, last = np.searchsorted(self.length, own * (share / (1 - share)) - 1), np.searchsorted(self.length, own * ((1 - share) / share) + 1)
        order, half = np.argsort(own, kind="stable"), self.length * (need / 2) - 1e-3
        for start in range(0, len(own), ROWS):
            at = order[start : start + ROWS]
            low, high = first[at[0]], last[at[-1]]
            if low < high:
                facts = self.told(counts[at])
                rest = np.minimum(counts[at], self.peaks).sum(1) - facts.sum(1)
                common = facts @ self.facts[low:high].T + np.minimum(rest[:, None], self.rest[low:high])
                hit[at, low:high] |= common >= own[at, None] * (need / 2) + half[low:high]

    def pairs(self, rows: pa.RecordBatch, counts: np.ndarray, need: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (with how many signs of each kind they have) and entries of the same length band that may reach `need` by their trigrams, or their lengths and signs: (row, entry, similarity)."""
        both, sizes = self.shared(rows, floor or need)
        # As many shared trigrams of both texts' make a similarity of `least`.
        least = floor or need
        part = least / (1 + least)
        hit, own = both >= sizes[:, None] * part + (self.sizes * part - 1e-6), rows.column("length").to_numpy()
        if not floor:
            self.alike(hit, own, counts, need)
        row, entry = np.nonzero(hit)
        both = both[row, entry]
        likeness = both / np.maximum(sizes[row] + self.sizes[entry] - both, 1)
        low, high = (rows.column(c).to_numpy()[row] for c in ("low", "high"))
        own, other = own[row], self.length[entry]
        kept = (other >= low) & (other <= high) & (likeness >= floor) & ((likeness >= need) | (2 * np.minimum(own, other) >= need * (own + other)))
        return row[kept], entry[kept], likeness[kept]

    def matches(self, rows: pa.RecordBatch, threshold: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its best few entries of all that reach the threshold: (row, place in ids, score).

        A ratio is at most what the lengths, then the signs, then the longest common subsequence of two texts allow:
        it is worked out for the pairs that may still reach the threshold and the row's best few.
        """
        need, signs = threshold - SLACK, Q.Signs(rows.column("text").to_pylist())
        counts = signs.counts()
        row, entry, likeness = self.pairs(rows, counts, need, floor)
        counts, chars = np.minimum(counts, self.most).astype(self.counts.dtype), signs.length[row] + self.length[entry]
        bound = 2 * np.minimum(counts[row], self.counts[entry]).sum(1, dtype=np.int64) / chars
        # What trigrams decide, or signs rule out, is done.
        open_ = np.flatnonzero((bound >= need) & (likeness < MISMATCH_CEILING))
        bound[open_] = 2 * Q.common_lengths(signs, self.signs, row[open_], entry[open_], need * chars[open_] / 2) / chars[open_]
        bound = np.maximum(bound, likeness)
        left = np.flatnonzero(bound >= need)
        left = left[np.lexsort((-bound[left], row[left]))]
        out, row = [], row[left]
        edges = np.flatnonzero(row[1:] != row[:-1]) + 1
        for start, stop in zip([0, *edges], [*edges, len(row)], strict=True):
            if start < stop:
                pairs = left[start:stop]
                best = self.few(signs.texts[row[start]], zip(entry[pairs].tolist(), likeness[pairs].tolist(), bound[pairs].tolist(), strict=True), threshold)
                out += [(row[start], place, -score) for score, place in best]
        row, place, score = zip(*out, strict=True) if out else ((), (), ())
        return np.array(row, np.int64), np.array(place, np.int64), np.array(score, np.float64)

    def few(self, text: str, pairs: Iterable[tuple[int, float, float]], threshold: float) -> list[tuple[float, int]]:
        """The best few of a text's pairs (entry, similarity, bound) in falling order of bounds, as (-score, place)."""
        best: list[tuple[float, int]] = []
        least = threshold - SLACK
        for entry, score, bound in pairs:
            if bound < least:
                break
            # Scores of unlike texts end at the ceiling, and equal texts are alike by trigrams already.
            if score < MISMATCH_CEILING:
                score = max(score, Q.ratio_from(text, self.texts[entry], least))
            score = Q.rounded(score if text == self.texts[entry] else min(score, MISMATCH_CEILING))
            if score >= threshold:
                best = sorted(best + [(-score, place) for place in self.places[entry]])[: self.results]
                if len(best) == self.results:
                    least = max(least, -best[-1][0] - SLACK)
        return best


def fuzzy_scorer(threshold: float, results: int, floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `_met` to the best few entries of each query in each block by score."""
    return _scorer(lambda parts: _Texts(parts, results), lambda block, rows: block.matches(rows, threshold, floor), "score")


def fuzzy_matches(queries: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, results: int = RESULTS, vectors: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """The `results` best of all entries by score: query_id, entry_id, score, rank.

    score: the better of trigram similarity and sequence ratio, raised by the vector score where `vectors` (query_id, entry_id, score)
    has one, rounded to four digits, at most 0.99 unless the match texts are equal; results below the threshold go.
    Every query meets every entry whose length lies in the band; no entry is left out for its rank by trigrams. Only where
    `floor` is given, entries that are less alike by trigrams are no matches, whatever their ratio.
    """
    found = _met(queries, entries).mapInArrow(fuzzy_scorer(threshold, results, floor), f"{_ids(queries, entries)}, score double")
    if vectors is not None:
        asked = queries.where(fuzzy_allowed("text")).select("query_id", T.match_or_normalized("text").alias("a"))
        pairs = vectors.select("query_id", "entry_id", F.col("score").alias("vector")).join(asked, "query_id").join(entries.select("entry_id", T.match_or_normalized("source_text").alias("b")), "entry_id")
        low, high = T.length_band(F.length("a"))
        similarity = F.when(F.length("b").between(low, high), S.jaccard(S.word_trigrams("a"), S.word_trigrams("b")))
        score = S.blend(F.greatest(similarity, S.sequence_ratio("a", "b")), F.col("vector"))
        capped = F.when(F.col("a") == F.col("b"), score).otherwise(F.least(score, F.lit(MISMATCH_CEILING)))
        raised = pairs.select("query_id", "entry_id", F.round(capped, 4).alias("score")).where(F.col("score") >= threshold)
        # A vector never lowers a score: of a pair found both ways the higher one holds.
        found = found.unionByName(raised).groupBy("query_id", "entry_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= results)


def vector_matches(queries: DataFrame, entries: DataFrame, floor: float = VECTOR_FLOOR, recall: int = VECTOR_RECALL) -> DataFrame:
    """The `recall` nearest entries by cosine of a stated query set: query_id, entry_id, score, rank.

    Both sides are (id, vector). Every query meets every entry, block by block as matrices: an index of one cell leaves out none.
    """
    return X.nearest(queries, X.build(entries, cells=1), floor, recall)


def word_overlap(queries: DataFrame, entries: DataFrame, floor: float = 0.2, results: int = 5) -> DataFrame:
    """Entries by the share of their distinct words that a query holds: query_id, entry_id, score, rank.

    An entry that a query holds a share of `floor` of has one of its rarest words in the query, if so many are
    looked at that the rest falls short (prefix filtering): only those are joined, then the pair is scored once.
    """
    words = lambda c: F.transform(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")), lambda w: F.xxhash64(w))
    q = queries.select("query_id", words("text").alias("own"))
    e = entries.select("entry_id", words("source_text").alias("words")).where(F.size("words") > 0)
    each = q.select("query_id", F.explode("own").alias("word"))
    frequency = each.groupBy("word").agg(F.count("*").alias("f"))
    long = e.select("entry_id", F.size("words").alias("n"), F.explode("words").alias("word")).join(frequency, "word", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("entry_id").orderBy("f", "word"))
    rare = long.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * floor - 1e-9) + 1) & (F.col("f") > 0)).select("entry_id", "word")
    pairs = each.join(rare, "word").select("query_id", "entry_id").distinct()
    scored = pairs.join(q, "query_id").join(e, "entry_id").select("query_id", "entry_id", (F.size(F.array_intersect("own", "words")) / F.size("words")).alias("score")).where(F.col("score") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= results)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str, keep: bool = False) -> DataFrame:
    """The merged table with an `action` column: created, updated, unchanged.

    Of rows of one key in `incoming` the last by `order` wins, or the first with keep=True; with
    keep=True existing rows stay as they are, else they are overwritten.
    """
    value = [c for c in incoming.columns if c not in (*keys, order)]
    pick = F.min_by if keep else F.max_by
    last = incoming.groupBy(*keys).agg(pick(F.struct(*value), order).alias("new"))
    old = existing.select(*keys, F.struct(*value).alias("old"))
    merged = old.join(last, keys, "full")
    chosen = F.coalesce("old", "new") if keep else F.coalesce("new", "old")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull() | F.lit(keep), "unchanged").otherwise("updated")
    return merged.select(*keys, *[chosen[v].alias(v) for v in value], action.alias("action"))


def majority_vote(entries: DataFrame, key: str, target: str, recency: str, id_: str) -> DataFrame:
    """One row per key: the target that most rows of the key have, of its rows the latest, then the least id."""
    votes = entries.withColumn("votes", F.count("*").over(Window.partitionBy(key, target)))
    order = Window.partitionBy(key).orderBy(F.desc("votes"), F.desc(recency), id_)
    return votes.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def signature(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """A digest of every group's rows that does not depend on their order: sums of row hashes, hashed.

    Unlike a hash over a collected list it aggregates partially and holds no group in one place.
    """
    # Sums, not exclusive ors: repeated rows must not cancel.
    h = F.xxhash64(*columns)
    return rows.groupBy(group).agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), h).cast("decimal(38,0)"))), 256).alias("signature"))


def length_bucket(length: Column) -> Column:
    """Lower end of the length range by which a search table is partitioned."""
    out = F.lit(0)
    for low in (17, 41, 81, 161, 321):
        out = F.when(length >= low, low).otherwise(out)
    return out
