"""The vector index against all pairs."""

import math

import numpy as np
import pytest

from lexibridge.functions import languages
from lexibridge.operators import vectorindex as X


def clustered(seed, n, width=12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((9, width))
    return [(centres[r.integers(9)] + 0.5 * r.standard_normal(width)).tolist() for _ in range(n)]


@pytest.mark.parametrize(("floor", "cells"), [(0.45, None), (-1.0, 40), (0.9, 7)])
def test_results_equal_all_pairs(spark, floor, cells):
    vectors = clustered(1, 900)
    vectors[100:105] = [vectors[50]] * 5  # copies: ties go by id
    vectors[7], vectors[8], vectors[9] = [0.0] * 12, None, [math.nan] * 12
    vectors[10] = [x * 1e200 for x in vectors[11]]
    rows = list(enumerate(vectors))
    entries = spark.createDataFrame(rows, "entry_id long, vector array<double>").repartition(6)
    queries = spark.createDataFrame(rows[::30] + [(7, vectors[7]), (10, vectors[10])], "query_id long, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.entry_id, round(r.score, 9)) for r in X.nearest(queries, X.build(entries, cells), floor).collect())
    units = {i: np.array(v) / max(map(abs, v)) for i, v in rows if v and any(v) and all(map(math.isfinite, v))}
    units = {i: v / np.linalg.norm(v) for i, v in units.items()}
    want = []
    for q in sorted({*range(0, 900, 30), 7, 10} & set(units)):
        near = sorted((-round(float(units[q] @ v), 9), i) for i, v in units.items() if i != q and units[q] @ v >= floor)[:6]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    assert got == want


def test_cells_that_cannot_hold_a_result_are_skipped(spark):
    rows = list(enumerate(clustered(2, 800)))
    index = X.build(spark.createDataFrame(rows, "entry_id long, vector array<double>"), 30)
    queries = X._units(spark.createDataFrame(rows[:20], "query_id long, vector array<double>"), "query_id")
    bounds = X._bounds(queries, index)
    assert bounds.where("bound < 0.9").count() > 0.5 * bounds.count()


def test_empty_sides(spark):
    entries, queries = spark.createDataFrame([], "entry_id long, vector array<double>"), spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert X.nearest(queries, X.build(entries)).collect() == []
    assert X.nearest(queries.limit(0), X.build(queries.withColumnRenamed("query_id", "entry_id"))).collect() == []


def test_samples_of_files(spark):
    pieces = [(1, 0, "ab  c"), (1, 1, None), (1, 2, " "), (1, 3, "defgh"), (1, 4, "x"), (2, 0, ""), (3, 0, "y" * 50)]
    got = {r.f: r["sample"] for r in languages.language_samples(spark.createDataFrame(pieces, "f long, p long, t string"), "f", "p", "t", 8).collect()}
    assert got == {1: "ab c def", 2: "", 3: "y" * 8}
