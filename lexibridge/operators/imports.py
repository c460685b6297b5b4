"""What an import does to a table: created, updated, skipped; conflicts, copies and replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.functions import text as T
from lexibridge.functions.guides import han_share


def plan_import(incoming: DataFrame, existing: DataFrame, note: str | None = None) -> DataFrame:
    """Every distinct incoming row with the entry that it meets and its action.

    incoming: place, source_text, target_text (and `note`); existing: entry_id and the same. Of rows with
    one normalised source the last counts. An entry is met by the hash of the normalised source, else by the source text itself;
    the hash goes first. action: created without an entry, skipped if nothing differs, else updated.
    """
    value = ["source_text", "target_text", *([note] if note else [])]
    last = incoming.where(F.coalesce(F.trim("target_text"), F.lit("")) != "").withColumn("source_hash", T.source_hash("source_text")).where(T.normalize_text("source_text") != "").groupBy("source_hash").agg(F.max_by(F.struct("place", *value), "place").alias("r")).select("source_hash", "r.*")
    held = existing.withColumn("source_hash", T.source_hash("source_text"))
    old = F.struct("entry_id", *value)
    by_hash = held.groupBy("source_hash").agg(F.min_by(old, "entry_id").alias("h"))
    by_text = held.groupBy("source_text").agg(F.min_by(old, "entry_id").alias("t"))
    met = last.join(by_hash, "source_hash", "left").join(by_text, "source_text", "left").withColumn("e", F.coalesce("h", "t"))
    same = F.lit(True)
    for c in value:
        same &= F.col(c).eqNullSafe(F.col(f"e.{c}"))
    action = F.when(F.col("e").isNull(), "created").when(same, "skipped").otherwise("updated")
    return met.select("place", *value, F.col("e.entry_id").alias("entry_id"), action.alias("action"))


def save_terms(incoming: DataFrame, existing: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(conflicts, table): incoming terms whose source an entry has with another target, and the table after
    the save; without `overwrite` entries in conflict stay as they are. Keys are normalised sources in lower case."""
    key = F.lower(T.normalize_text("source_text"))
    new = incoming.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.max_by(F.struct("source_text", "target_text"), "place").alias("n"))
    old = existing.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct("source_text", "target_text"), "entry_id").alias("o"))
    both = old.join(new, "key", "full")
    conflicts = both.where("o.target_text <> n.target_text").select("key", F.col("o.target_text").alias("target_text"), F.col("n.target_text").alias("new_target_text"))
    kept = F.coalesce("n", "o") if overwrite else F.coalesce("o", "n")
    return conflicts, both.select("key", kept["source_text"].alias("source_text"), kept["target_text"].alias("target_text"))


def replaced(existing: DataFrame, incoming: DataFrame, profile: str = "profile_id") -> DataFrame:
    """The table after all entries of the incoming profiles gave way to the incoming ones."""
    return existing.join(incoming.select(profile).distinct(), profile, "left_anti").unionByName(incoming.select(*existing.columns))


def copied(entries: DataFrame, source: str, target: str) -> DataFrame:
    """The entries under another language pair."""
    return entries.withColumns({"source_language": F.lit(source), "target_language": F.lit(target)})


def merged_terms(extracted: DataFrame, limit: int = 300) -> DataFrame:
    """(place, term): extracted terms (place, term) once each by their normalised form in lower case, the first of each,
    the first `limit` (within 1..300) by place."""
    key = F.lower(T.normalize_text("term"))
    first = extracted.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min_by(F.struct("place", "term"), "place").alias("t"))
    return first.select("t.place", "t.term").orderBy("place").limit(min(max(limit, 1), 300))


def is_term(source: Column | str) -> Column:
    """Whether a source is a term and no sentence: without closing marks, and at most 15 characters if it
    is mostly Han (over three tenths), else at most five words and 50 characters."""
    s = F.col(source) if isinstance(source, str) else source
    trimmed = F.trim(s)
    han = F.regexp_count(trimmed, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    fits = F.when(han > F.length(trimmed) * 0.3, F.length(trimmed) <= 15).otherwise((words <= 5) & (F.length(trimmed) <= 50))
    return fits & ~s.rlike("[.。!！?？;；]")


def alternating_pairs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, place, source_text, target_text, level): paragraphs (doc_id, place, text) of less than a tenth Han that the
    next paragraph, of more than three tenths, translates; level: term or segment."""
    order = Window.partitionBy("doc_id").orderBy("place")
    rows = paragraphs.where(F.trim("text") != "").withColumn("next", F.lead("text").over(order))
    return rows.where((han_share(F.col("text")) < 0.1) & (han_share(F.col("next")) > 0.3)).select("doc_id", "place", F.trim("text").alias("source_text"), F.trim("next").alias("target_text"), F.when(is_term("text"), "term").otherwise("segment").alias("level"))


def lineage(rows: DataFrame, batch: str) -> DataFrame:
    """Rows marked with the import batch that they came by."""
    return rows.withColumn("import_batch_id", F.lit(batch))


def rebuilt(entries: DataFrame) -> DataFrame:
    """Entries with their derived columns made anew: normalised text, hash, words, length bucket. One pass, no pages of keys."""
    from lexibridge.operators.memory import length_bucket

    return entries.withColumns({"source_normalized": T.normalize_text("source_text"), "source_hash": T.source_hash("source_text"), "source_words": T.source_words("source_text"), "length_bucket": length_bucket(F.length(T.normalize_text("source_text")))})


def entry_counts(changes: DataFrame, *keys: str) -> DataFrame:
    """Entries of every base from signed changes (keys, sign): what counters kept by deltas come to, 0 left out."""
    return changes.groupBy(*keys).agg(F.sum("sign").alias("entries")).where("entries <> 0")
