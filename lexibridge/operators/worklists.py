"""Work lists of segments: scopes, groups for review, references, batches and checks of outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.functions import text as T

#: Statuses that each scope of machine translation takes.
SCOPES = {"fuzzy_only": ["fuzzy"], "none_only": ["none"], "all": ["fuzzy", "none"], "all_with_exact": ["exact", "fuzzy", "none"]}


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def in_translation_scope(segments: DataFrame, scope: str) -> DataFrame:
    """Segments of a scope; `empty_target_only` takes those without a target, an unknown scope is an error."""
    return segments.where(_blank("target_text")) if scope == "empty_target_only" else segments.where(F.col("status").isin(SCOPES[scope]))


def is_protected(exact: Column) -> Column:
    """Segments that a model must leave alone: with a target, and confirmed or exact."""
    return ~_blank("target_text") & (F.coalesce(F.col("confirmed"), F.lit(False)) | F.coalesce(exact, F.lit(False)))


def may_propagate(confirmed_only: bool = True) -> Column:
    """Segments that may go to equal sources: not disabled, with a target, confirmed where the policy asks for it."""
    wanted = ~F.coalesce(F.col("sync_disabled"), F.lit(False)) & ~_blank("target_text")
    return wanted & F.coalesce(F.col("confirmed"), F.lit(False)) if confirmed_only else wanted


def has_several_styles(metadata: str = "metadata") -> Column:
    """Segments whose metadata (JSON with runs of formats) name more than one format."""
    runs = F.from_json(metadata, "struct<runs:array<struct<format:string>>>")["runs"]
    return F.coalesce(F.size(F.array_distinct(F.filter(F.transform(runs, lambda r: r["format"]), lambda f: f.isNotNull()))) > 1, F.lit(False))


def review_groups(segments: DataFrame) -> DataFrame:
    """(language, source_hash, source_text, variants, copies, first_segment): equal sources for one review.

    Members stay in `segments`, to be joined by the hash: a group may hold a third of all rows and is never collected.
    """
    rows = segments.withColumn("source_hash", T.source_hash("source_text"))
    per = rows.groupBy("language", "source_hash", "target_text").agg(F.count("*").alias("n"), F.min(F.struct("segment_id", "source_text")).alias("first"))
    return per.groupBy("language", "source_hash").agg(F.min("first").alias("f"), F.count_if(~_blank("target_text")).alias("variants"), F.sum("n").alias("copies")).select("language", "source_hash", F.col("f.source_text").alias("source_text"), "variants", "copies", F.col("f.segment_id").alias("first_segment"))


def with_references(groups: DataFrame, memory: DataFrame, glossary: DataFrame) -> DataFrame:
    """Review groups with the target of the memory's best entry (source_hash, entry_id, target_text) and the glossary spans
    (first_segment, spans) of their text, nulls where there are none."""
    best = memory.groupBy("source_hash").agg(F.min_by("target_text", "entry_id").alias("memory_target"))
    return groups.join(best, "source_hash", "left").join(glossary.select("first_segment", "spans"), "first_segment", "left")


def latest_failed(reports: DataFrame) -> DataFrame:
    """(batch_id, segment_id) of the errors in the newest report of every batch: reports (batch_id, report_id, created_at, failed: array)."""
    newest = reports.groupBy("batch_id").agg(F.max_by("failed", F.struct("created_at", "report_id")).alias("failed"))
    return newest.select("batch_id", F.explode("failed").alias("segment_id")).distinct()


def latest_review(baselines: DataFrame, items: DataFrame) -> DataFrame:
    """Baselines (segment_id, ...) with the verdict and text of their segment's newest review item, nulls without one."""
    newest = items.groupBy("segment_id").agg(F.max_by(F.struct("verdict", "reviewed_text"), F.struct("created_at", "item_id")).alias("i"))
    return baselines.join(newest, "segment_id", "left").select(*baselines.columns, "i.verdict", "i.reviewed_text")


def task_type(status: str = "status", source: str = "source_text") -> Column:
    """Kind of a task: numeric for fragments of digits and marks alone, fuzzy by status, else normal."""
    numeric = F.col(source).rlike(r"[0-9]") & ~F.col(source).rlike(r"\p{L}")
    return F.when(numeric, "numeric").when(F.col(status) == "fuzzy", "fuzzy").otherwise("normal")


def greedy_batches(rows: DataFrame, keys: list[str], order: list[str], size: str, most_items: int, most_size: int, together: list[str] | None = None) -> DataFrame:
    """`rows` with batch (from 0 in every key): in order, each opens a new batch if the last one is full.

    A batch holds at most `most_items` rows and `most_size` of `size` in all; a row that is larger has a batch for itself.
    together: rows that agree in these columns and follow each other stay in one batch if they fit one.
    The rows of a key pass through one task in order as a stream that keeps only the open batch's sums, or
    one run of `together`; no group is held.
    """
    together = together or []
    names = [f.name for f in rows.schema.fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = place = None
        items = total = batch = 0
        held: list[tuple] = []

        def close() -> Iterator[tuple]:
            nonlocal items, total, batch
            count, weight = len(held), sum(h[1] for h in held)
            whole = count <= most_items and weight <= most_size
            if whole and items and (items + count > most_items or total + weight > most_size):
                batch, items, total = batch + 1, 0, 0
            for row, own in held:
                if items and (items + 1 > most_items or total + own > most_size):
                    batch, items, total = batch + 1, 0, 0
                items, total = items + 1, total + own
                yield (*row, batch)
            held.clear()

        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                at = dict(zip(names, row, strict=True))
                now, here = tuple(at[k] for k in keys), tuple(at[c] for c in together) if together else object()
                if now != key or here != place or len(held) >= most_items:
                    out += close()
                if now != key:
                    key, items, total, batch = now, 0, 0, 0
                place = here
                held.append((row, int(at[size] or 0)))
            yield pd.DataFrame(out, columns=[*names, "batch"]).astype(object)
        yield pd.DataFrame(list(close()), columns=[*names, "batch"]).astype(object)

    spread = rows.repartition(*keys) if keys else rows.coalesce(1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", batch long"
    return spread.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


# What a translation must keep, in order or as a bag.
SYMBOLS = r"([※★☆●○■□▲△▼▽◆◇→←↑↓√×÷±°©®™§¶])"
FORMULAS = r"(⟦MATH_[0-9]+⟧)"
FORMAT_TAGS = r"(</?(?:b|i|u|sub|sup|strong|em)>)"


def output_fault(source: str = "source_text", target: str = "target_text") -> Column:
    """Why a machine translation is refused: empty, numeric, symbols, formulas, tags, lines; null if it may stay.

    Symbols and formulas keep their order, format tags their number, line breaks theirs, and fragments of
    digits and marks stay as they are.
    """
    both = lambda p: (F.regexp_extract_all(source, F.lit(p), 1), F.regexp_extract_all(target, F.lit(p), 1))
    s, t = T.normalize_text(source), T.normalize_text(target)
    numeric = F.col(source).rlike("[0-9]") & ~F.col(source).rlike(r"\p{L}")
    (a, b), (c, d), (e, f) = both(SYMBOLS), both(FORMULAS), both(FORMAT_TAGS)
    lines = lambda x: F.regexp_count(F.coalesce(F.col(x), F.lit("")), F.lit("\n"))
    return (
        F.when(t == "", "empty")
        .when(numeric & (s != t), "numeric")
        .when((F.size(a) > 0) & (a != b), "symbols")
        .when((F.size(c) > 0) & (c != d), "formulas")
        .when((F.size(e) > 0) & (F.array_sort(e) != F.array_sort(f)), "tags")
        .when((lines(source) > 0) & (lines(source) != lines(target)), "lines")
    )


def reference_tasks(segments: DataFrame, scope: str, empty_only: bool = False) -> DataFrame:
    """Segments with `wanted`: whether translation from references takes them."""
    wanted = F.col("status").isin(SCOPES[scope])
    return segments.withColumn("wanted", F.coalesce(wanted & _blank("target_text") if empty_only else wanted, F.lit(False)))


def header_rows(rows: DataFrame, language: str, source: str, most: int = 20) -> DataFrame:
    """(sheet, row, score): of the first `most` rows of every sheet the one most like a header. A row scores its filled cells,
    3 for each cell that matches the pattern `language` and 2 for each that matches `source`; of equal rows the first."""
    hits = lambda p: F.size(F.filter("cells", lambda c: F.coalesce(F.lower(F.trim(c)).rlike(p), F.lit(False))))
    score = F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")) + 3 * hits(language) + 2 * hits(source)
    best = rows.where(F.col("row") <= most).withColumn("score", score).groupBy("sheet").agg(F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("b"))
    return best.select("sheet", "b.row", "b.score")


# The letters of scripts, and the languages that are written in them.
LETTERS = {"zh": r"[\x{3400}-\x{9FFF}]", "ja": r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]", "ko": r"[\x{AC00}-\x{D7AF}]", "ru": r"[\x{0400}-\x{04FF}]", "uk": r"[\x{0400}-\x{04FF}]", "ar": r"[\x{0600}-\x{06FF}]", "fa": r"[\x{0600}-\x{06FF}]", "ur": r"[\x{0600}-\x{06FF}]"}
OTHER_LETTERS = r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}\x{0600}-\x{06FF}]"


def expected_script(language: Column, text: Column) -> Column:
    """Whether a translation is in the script of its language. Fewer than three letters of the known scripts tell nothing
    and pass; a language in another script than these must not have three letters of them or more, and more than Latin ones."""
    text = F.coalesce(text, F.lit(""))
    primary = F.lower(F.substring_index(language, "-", 1))
    latin, others = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(OTHER_LETTERS))
    out = F.when(latin + others < 3, True)
    for k, pattern in LETTERS.items():
        out = out.when(primary == k, text.rlike(pattern))
    return out.otherwise((others < 3) | (others <= latin))


def anchored(text: Column, anchor: Column) -> Column:
    """struct(state, start): where an anchor lies in a text (from 0): unique, ambiguous, normalized (found only with
    white space made one and case ignored; no place) or unlocatable."""
    times = F.when(F.coalesce(anchor, F.lit("")) == "", 0).otherwise((F.length(text) - F.length(F.replace(text, anchor, F.lit("")))) / F.greatest(F.length(anchor), F.lit(1)))
    loose = F.contains(F.lower(T.normalize_text(text)), F.lower(T.normalize_text(anchor))) & (T.normalize_text(anchor) != "")
    state = F.when(times == 1, "unique").when(times > 1, "ambiguous").when(F.coalesce(loose, F.lit(False)), "normalized").otherwise("unlocatable")
    return F.struct(state.alias("state"), F.when(times == 1, F.position(anchor, text) - 1).cast("int").alias("start"))


def first_in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
