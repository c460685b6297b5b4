"""The corpus pipeline on the smallest tables, stage by stage."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lexibridge.llm import langid, neardup, quality


def test_entry_registers_all_operators():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_keep_columns_and_take_effect(spark, data, docs, tmp_path):
    labels, now = spark.read.parquet(f"{data}/labels.parquet"), docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, data)
        assert out.columns == docs.columns
        path = f"file://{tmp_path}/{n}"
        out.write.parquet(path)
        after, before = {r.doc_id for r in spark.read.parquet(path).collect()}, {r.doc_id for r in now.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality.score(now, quality.train(now, labels)).collect() if r.kept}
        elif name == "language":
            want = {r.doc_id for r in langid.identify(now).collect() if not r.rejected}
        else:
            want = {r.doc_id for r in neardup.near_duplicates(now).collect() if r.kept}
        assert after == want <= before
        now = spark.read.parquet(path)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in now.collect()}
    assert np.mean([i in kept for i, q in marks.items() if q == 0]) < 0.3
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} == kept
    library, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r.doc_id: r.text for r in now.collect()}
    for i in kept:
        assert sum(r.length for r in rows if r.doc_id == i) == len(library.encode(texts[i], add_special_tokens=False).ids) + 1


def test_pipeline_of_awkward_and_empty_tables(spark, data, awkward, nothing):
    for table in (awkward, nothing):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, data)
        assert now.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert nothing is not table or now.collect() == []
