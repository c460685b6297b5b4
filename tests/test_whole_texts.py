"""Queries that meet documents by whole texts: texts that merely begin alike stay apart."""

import pytest

from lexibridge.plans import catalogue

START = "The same long beginning of more than forty characters, "


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Three documents of two texts with an equal beginning."""
    folder = str(tmp_path_factory.mktemp("alike"))
    rows = [(1, START + "first", "en", "src1", 60), (2, START + "second", "de", "src2", 61), (3, START + "first ", "en", "src2", 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_whole_texts_are_keys(spark, alike):
    run = lambda name: catalogue.queries()[f"{name}_whole"](spark, alike).collect()
    assert {(r.doc_id, r.target, r.votes) for r in run("dedupe_majority_vote")} == {(1, "en", 2), (2, "de", 1)}
    assert [tuple(r) for r in run("duplicate_group_stats")] == [(3, 0, 1, 1, 0)]
    assert sorted((r.target, r.action) for r in run("upsert_overwrite")) == [("de", "unchanged"), ("en", "created")]
    assert sorted((r.target, r.action) for r in run("upsert_keep")) == [("de", "unchanged"), ("en", "created")]
    assert sorted((r.target, r.entries, r.bases) for r in run("merge_bases_last_wins")) == [("de", 1, 1), ("en", 2, 2)]


def test_whole_texts_are_sources(spark, alike):
    run = lambda name: catalogue.queries()[f"{name}_whole"](spark, alike).collect()
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{alike}/labels.parquet")
    turns = [(1, 0, "user", "red apple pie"), (1, 1, "assistant", "a"), (2, 0, "user", "red apple tart"), (2, 1, "assistant", "b"), (3, 0, "user", "Red  apple pie"), (3, 1, "assistant", "c"), (4, 0, "user", "red apple pie"), (4, 1, "assistant", "d"), (5, 0, "user", "red apple and four more words"), (5, 1, "assistant", "e"), (6, 0, "user", "red apple and four more words"), (6, 1, "assistant", "f")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{alike}/conversations.parquet")
    assert [(r.members, r.id, r.target_text) for r in run("propagation_winner")] == [(2, 1, "T1")]
    assert sorted((r.id, r.tier) for r in run("convergence_winner")) == [(1, 0), (2, 2)]
    assert [tuple(r) for r in run("term_conflicts")] == [("red apple pie", 2, 2)]
    assert sorted((r.source_key, r.targets, r.segments) for r in run("context_inconsistency")) == [("red apple and four more words", 2, 2), ("red apple pie", 3, 3)]


def test_acronym_in_documents_with_underscores(spark, tmp_path):
    rows = [(1, "snake_case and THE end, THE", "en"), (2, "the_end", "en"), (3, "THE_X", "en"), (4, "OTHER", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.text_id, r.hits) for r in catalogue.queries()["term_acronym_case"](spark, str(tmp_path)).collect()} == {(1, 2), (3, 1)}


def test_character_pairs_do_not_move_by_place(spark, tmp_path):
    """Texts move once at most, whatever their length: no exchange holds a row a place; results by brute force."""
    from lexibridge.plans import repetition as R

    texts = {3: "ab ab\nab", 5: "xyab𝒳𝒴", 4: "𝒳𝒴𝒳𝒴", 9: "a", 8: "", 7: None, 6: "new " * 500}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    units = {k: ["".join(p) for p in zip(t, t[1:])] for k, v in texts.items() if len(t := "".join((v or "").split())) > 1}
    want = {}
    for k, own in units.items():
        crossing = {u for j, other in units.items() if j < k for u in other}
        covers = lambda hit, own=own: len({p + d for p, u in enumerate(own) if hit(p, u) for d in (0, 1)})
        want[k] = (len(own), covers(lambda p, u, own=own: u in own[:p]), covers(lambda p, u, c=crossing: u in c))
    found = R.repetition_char_intervals(spark, str(tmp_path))
    assert {r.file_id: (r.units, r.internal_units, r.cross_units) for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
