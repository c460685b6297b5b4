"""Structured Streaming forms of the incremental operators.

Every function takes and returns DataFrames, streaming or not, so a batch over the same
rows gives what the stream converges to. Event time and watermarks replace wall clocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexibridge.functions import text as T
from lexibridge.functions.similarity import hashed_embedding

#: A collection is matched again at so many pending changes, or when the oldest is so old.
REMATCH_ROWS, REMATCH_MINUTES = 200, 15
LATE = "1 day"


def deduplicated(events: DataFrame, key: str = "event_key", at: str = "ts", late: str = LATE) -> DataFrame:
    """Each event key once within the watermark: appends are idempotent."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def recorded(events: DataFrame) -> DataFrame:
    """Edits worth recording: not without text, and not without change unless a model made them."""
    changed = ~F.col("before_text").eqNullSafe(F.col("after_text")) | F.col("source").isin("llm", "llm_review")
    return events.where((F.coalesce("after_text", F.lit("")) != "") & changed).withColumn("target_was_empty", F.coalesce("before_text", F.lit("")) == "").withColumn("words", F.greatest(F.lit(0), F.col("words")))


def daily_activity(events: DataFrame, at: str = "ts", late: str = LATE) -> DataFrame:
    """(user_id, day, requests, first_seen, last_seen) by tumbling days of event time."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    days = rows.groupBy("user_id", F.window(at, "1 day").alias("w")).agg(F.count("*").alias("requests"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return days.select("user_id", F.to_date("w.start").alias("day"), "requests", "first_seen", "last_seen")


def status_counters(changes: DataFrame, *keys: str) -> DataFrame:
    """Counters kept up by signed changes: (sign, flag columns as booleans)."""
    flags = [f.name for f in changes.schema.fields if f.dataType.typeName() == "boolean"]
    return changes.groupBy(*keys).agg(F.sum("sign").alias("rows"), *[F.sum(F.when(F.col(f), F.col("sign")).otherwise(0)).alias(f) for f in flags])


def sliding_activity(events: DataFrame, every: str, length: str, at: str = "ts", late: str = LATE) -> DataFrame:
    """(user_id, start, stop, requests) by windows of `length` that begin every `every`; windows without events are left out."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy("user_id", F.window(at, length, every).alias("w")).agg(F.count("*").alias("requests")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "requests")


def sessions(events: DataFrame, gap: str, at: str = "ts", late: str = LATE) -> DataFrame:
    """(user_id, start, last, requests) of runs of events without a pause of `gap` or more."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("requests"), F.max(at).alias("last")).select("user_id", F.col("w.start").alias("start"), "last", "requests")


def memory_outbox(segments: DataFrame) -> DataFrame:
    """Confirmed segments with a target as memory upserts, the last of every collection, languages and source hash:
    collection_id, source_language, target_language, source_hash, source_text, target_text, updated_at, coalesced."""
    due = segments.where("confirmed AND trim(coalesce(target_text, '')) <> ''").withColumn("source_hash", T.source_hash("source_text")).where(T.normalize_text("source_text") != "")
    keys = ["collection_id", "source_language", "target_language", "source_hash"]
    return coalesced(due.select(*keys, "source_text", "target_text", "updated_at"), keys, "updated_at")


#: Times that a change is tried before it is laid aside.
ATTEMPTS = 3


def outbox_states(attempts: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """(key, state, attempts) of tries (key, at, ok): done after one that was well, failed after `most`, else pending."""
    sums = attempts.groupBy("key").agg(F.count("*").alias("attempts"), F.bool_or("ok").alias("ok"))
    return sums.select("key", F.when(F.col("ok"), "done").when(F.col("attempts") >= most, "failed").otherwise("pending").alias("state"), "attempts")


def refreshed(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """`segments` after a rematch with (segment_id, matched_text, score, matched_target): unconfirmed ones take their match
    and score, an empty target takes the matched target; version counts up and `changed` says so where anything differs.
    Confirmed ones stay."""
    new = matches.select("segment_id", F.struct("matched_text", "score", "matched_target").alias("m"))
    both = segments.join(new, "segment_id", "left")
    free = ~F.coalesce("confirmed", F.lit(False)) & F.col("m").isNotNull()
    empty = F.trim(F.coalesce("target_text", F.lit(""))) == ""
    to = {"matched_text": F.when(free, F.col("m.matched_text")).otherwise(F.col("matched_text")), "score": F.when(free, F.col("m.score")).otherwise(F.col("score")), "target_text": F.when(free & empty, F.col("m.matched_target")).otherwise(F.col("target_text"))}
    changed = F.lit(False)
    for c, v in to.items():
        changed |= ~F.col(c).eqNullSafe(v)
    rest = [c for c in segments.columns if c not in (*to, "version")]
    return both.select(*rest, *[v.alias(c) for c, v in to.items()], (F.col("version") + changed.cast("int")).alias("version"), changed.alias("changed"))


def backfilled(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """`rows` with `column` filled where it is null: what batches until nothing changes come to, in one pass."""
    return rows.withColumn(column, F.coalesce(F.col(column), value))


def stale_embeddings(entries: DataFrame, version: int) -> DataFrame:
    """(entry_id, embedding, version) of the entries whose embedding is missing, of another version or of another text: what a
    sync writes. entries: entry_id, source_text, embedded_hash, embedded_version."""
    stale = entries.where(~F.col("embedded_version").eqNullSafe(F.lit(version)) | ~F.col("embedded_hash").eqNullSafe(T.source_hash("source_text")))
    return stale.select("entry_id", hashed_embedding("source_text").alias("embedding"), F.lit(version).alias("version"))


def rematch_triggers(changes: DataFrame, at: str = "ts", rows: int = REMATCH_ROWS, minutes: int = REMATCH_MINUTES, late: str = LATE) -> DataFrame:
    """(collection_id, pending, oldest): emitted when a collection has enough pending changes or the
    oldest of them is old enough by event time; the count then starts anew. For streams.

    late: how far behind the newest event a change may come and still count; time-outs wait as long.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, oldest = state.get if state.exists else (0, None)
        if not state.hasTimedOut:
            for part in batches:
                pending += len(part)
                least = int(part["at_ms"].min())
                oldest = least if oldest is None else min(oldest, least)
        due = pending >= rows or state.hasTimedOut
        if due and pending:
            state.remove()
            yield pd.DataFrame({"collection_id": [key[0]], "pending": [pending], "oldest": [oldest]})
        elif pending:
            state.update((pending, oldest))
            state.setTimeoutTimestamp(max(oldest + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    timed = changes.withWatermark(at, late).withColumn("at_ms", F.unix_millis(at))
    return timed.groupBy("collection_id").applyInPandasWithState(step, "collection_id long, pending long, oldest long", "pending long, oldest long", "append", GroupStateTimeout.EventTimeTimeout)


def affected_segments(segments: DataFrame, changed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(segment_id, entry_id, similarity): the segments that changed memory entries may give another match, and by which.

    segments: segment_id, source_text, confirmed; changed: entry_id, source_text, as batches of a memory's changes come. Confirmed segments keep what they
    have. A segment is affected by equal hash (similarity 1, the least such entry) or as one whose rarest trigrams a changed entry
    shares; all others are left alone. Each distinct text is looked up once, however many segments hold it.
    """
    from lexibridge.operators.memory import trigram_candidates

    open_ = segments.where(~F.coalesce(F.col("confirmed"), F.lit(False))).select("segment_id", T.source_hash("source_text").alias("query_id"), "source_text")
    texts = open_.groupBy("query_id").agg(F.min("source_text").alias("text"))
    equal = changed.groupBy(T.source_hash("source_text").alias("query_id")).agg(F.min("entry_id").alias("entry_id")).join(texts.select("query_id"), "query_id", "left_semi")
    like = trigram_candidates(texts, changed, threshold).join(equal, ["query_id", "entry_id"], "left_anti").select("query_id", "entry_id", "similarity")
    found = equal.select("query_id", "entry_id", F.lit(1.0).alias("similarity")).unionByName(like)
    return open_.select("segment_id", "query_id").join(found, "query_id").select("segment_id", "entry_id", "similarity")


def coalesced(outbox: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key of a change feed: the latest, with how many it stands for."""
    value = [c for c in outbox.columns if c not in (*keys, at)]
    last = outbox.groupBy(*keys).agg(F.max_by(F.struct(*value), at).alias("v"), F.max(at).alias(at), F.count("*").alias("coalesced"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in value], at, "coalesced")


def signed_changes(changes: DataFrame, before: str, after: str, name: str) -> DataFrame:
    """Every change as a retraction of the value before and an addition of the value after: `name`, change (-1 or 1), and the other columns.

    A change from a value to itself gives both; a null on one side gives no row for it.
    """
    sides = F.array(F.struct(F.col(before).alias(name), F.lit(-1).cast("long").alias("change")), F.struct(F.col(after).alias(name), F.lit(1).cast("long").alias("change")))
    others = [c for c in changes.columns if c not in (before, after)]
    return changes.select(*others, F.inline(sides)).where(F.col(name).isNotNull())


def upsert_into(path: str, keys: list[str], order: str):
    """A foreachBatch function that merges every batch into the Parquet table at `path`.

    Each batch writes a new version beside the old; a batch that is repeated after a failure gives the same table, and the
    version is the batch's number. The column `order` stays in the table, so that an older row of a later batch changes nothing. For large
    tables see `deltas`, which writes what has changed alone.
    """
    from lexibridge.streaming.deltas import latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = sorted((r[0] for r in _versions(spark, path) if r[0] < number), reverse=True)
        rows = spark.read.parquet(f"{path}/v={versions[0]}").unionByName(batch) if versions else batch
        latest(keys, order)(rows).write.mode("overwrite").parquet(f"{path}/v={number}")

    return merge


def _versions(spark, path: str) -> list[tuple[int]]:
    """Numbers of the versions that are complete, from the table's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return [(int(s.getPath().getName()[2:]),) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
