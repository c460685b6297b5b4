from lexibridge.plans import streams
from lexibridge.streaming import deltas, incremental


def test_recorded_edits(spark):
    rows = [("a", "a", "manual", 3), ("a", "a", "llm", 3), ("", "b", "tm", -1), ("a", "", "tm", 1)]
    got = incremental.recorded(spark.createDataFrame(rows, "before_text string, after_text string, source string, words int")).collect()
    assert [(r.source, r.words, r.target_was_empty) for r in got] == [("llm", 3, False), ("tm", 0, True)]


def test_rematch_trigger_by_count(spark, data):
    got = streams.stream_rematch_trigger(spark, data).collect()
    assert all(r.pending >= 1 for r in got)


def test_upsert_batches_converge(spark, tmp_path):
    merge = incremental.upsert_into(f"file://{tmp_path}/t", ["k"], "o")
    one = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v long, o long")
    two = spark.createDataFrame([("b", 3, 2)], "k string, v long, o long")
    merge(one, 0)
    for _ in range(2):  # a repeated batch changes nothing
        merge(two, 1)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t/v=1").select("k", "v").collect()} == {("a", 1), ("b", 3)}
    merge(spark.createDataFrame([("a", 9, 0), ("c", 4, 1)], "k string, v long, o long"), 2)  # an older row of a later batch
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t/v=2").select("k", "v").collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_shuffled_late_and_repeated_batches_equal_one(spark, tmp_path):
    import random

    r = random.Random(4)
    rows = [(f"k{r.randrange(40)}", i, r.randrange(30)) for i in range(400)]
    want = {}
    for k, v, o in rows:
        want[k] = max(want.get(k, (-1, -1)), (o, v))
    schema = spark.createDataFrame([], "k string, v long, o long").schema
    for seed in range(2):
        path, merge = f"file://{tmp_path}/d{seed}", deltas.latest(["k"], "o")
        random.Random(seed).shuffle(rows)
        add = deltas.writer(path, ["k"], merge, 8)
        for number in range(4):
            batch = spark.createDataFrame(rows[number * 100 : number * 100 + 100], schema)
            add(batch, number)
            if number == 2:
                assert deltas.compact(spark, path, schema, ["k"], merge, 8) == 2
                add(batch, number)
                assert deltas.obsolete(spark, path) == [f"{path}/delta={n}" for n in range(3)]
        got = {x.k: (x.o, x.v) for x in deltas.read(spark, path, schema, merge).collect()}
        assert got == want
        assert deltas.compact(spark, path, schema, ["k"], merge, 8) == 3 and deltas.compact(spark, path, schema, ["k"], merge, 8) is None
        assert {x.k: (x.o, x.v) for x in deltas.read(spark, path, schema, merge).collect()} == want
    assert deltas.read(spark, f"file://{tmp_path}/none", schema, merge).collect() == []


def test_counters_that_cancel_out_stay_gone(spark, tmp_path):
    changes = spark.createDataFrame([(1, None, "new"), (1, "new", "done"), (2, None, "new"), (3, "done", "done")], "i int, b string, a string")
    signed = incremental.signed_changes(changes, "b", "a", "status").drop("i")
    path, merge = f"file://{tmp_path}/c", deltas.summed(["status"], "change")
    add = deltas.writer(path, ["status"], merge, 4)
    add(signed, 0)
    assert {tuple(r) for r in deltas.read(spark, path, signed.schema, merge).collect()} == {("new", 1), ("done", 1)}
    add(spark.createDataFrame([("new", -1)], signed.schema), 1)
    deltas.compact(spark, path, signed.schema, ["status"], merge, 4)
    assert {tuple(r) for r in deltas.read(spark, path, signed.schema, merge).collect()} == {("done", 1)}


def test_rematch_triggers_count_every_change(spark, tmp_path):
    """Late changes count; what is emitted and what stays pending are all changes."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(minutes=i)) for i in range(450)] + [(2, start + timedelta(minutes=i)) for i in range(3)]
    table = spark.createDataFrame(rows, "collection_id long, ts timestamp")
    table.where("minute(ts) < 30").coalesce(1).write.parquet(f"{tmp_path}/in")
    table.where("minute(ts) >= 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams._completed(incremental.rematch_triggers(stream, minutes=10_000), "append").collect()
    # Every change of the one collection came in two parts of more than 200: both fire at once, whole.
    assert sum(r.pending for r in got if r.collection_id == 1) == 450
    assert all(r.pending >= 200 for r in got if r.collection_id == 1)


def test_stale_embeddings_and_backfill(spark):
    from pyspark.sql import functions as F

    from lexibridge.functions import text as T

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "entry_id int, source_text string")
    rows = rows.withColumn("embedded_hash", F.when(F.col("entry_id") < 3, T.source_hash("source_text"))).withColumn("embedded_version", F.when(F.col("entry_id") != 2, 1))
    assert sorted(r.entry_id for r in incremental.stale_embeddings(rows, 1).collect()) == [2, 3]


def test_sessions_end_at_a_pause(spark):
    rows = spark.sql("SELECT 1 AS user_id, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp'2024-01-01 00:09:00' UNION ALL SELECT 1, timestamp'2024-01-01 00:20:00'")
    assert sorted(r.requests for r in incremental.sessions(rows, "10 minutes").collect()) == [1, 2]


def test_affected_segments(spark):
    segments = [(1, "Hello world again", False), (2, "hello  world again", True), (3, "Hello world again", None), (4, "quite another text", False), (5, "Hello world anew", False)]
    changed = [(10, "Hello world again"), (11, "Hello world again"), (12, "unrelated")]
    got = incremental.affected_segments(spark.createDataFrame(segments, "segment_id long, source_text string, confirmed boolean"), spark.createDataFrame(changed, "entry_id long, source_text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.segment_id, {})[r.entry_id] = round(r.similarity, 2)
    # Equal texts first, by the least entry; confirmed and unlike segments are left alone.
    assert set(found) == {1, 3, 5} and found[1] == {10: 1.0, 11: 1.0} == found[3]
    assert found[5] and max(found[5].values()) < 1
