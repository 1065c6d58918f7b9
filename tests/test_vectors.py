"""Exact vector search over partitions against all products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.operators import vectors as op


def brute(rows, asked, k):
    out = []
    for q, e in asked:
        if e is not None:
            s = sorted((-round(float(np.dot(np.float64(np.float32(e)), np.float64(np.float32(v)))), 6), d) for d, v in rows if v is not None and d is not None)
            out += [(q, d, -x, r) for r, (x, d) in enumerate(s[:k], 1)]
    return sorted(out)


def frames(spark, rows, asked):
    as_lists = lambda some: [(i, None if v is None else [float(x) for x in v]) for i, v in some]
    return (
        spark.createDataFrame(as_lists(rows), "doc_id long, embedding array<float>"),
        spark.createDataFrame(as_lists(asked), "query_id long, embedding array<float>"),
    )


def same(got, want):
    got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect())
    assert [(q, d, r) for q, d, _, r in got] == [(q, d, r) for q, d, _, r in want]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in want], abs=2e-6)


def test_clustered_vectors_leave_cells_unread(spark, monkeypatch):
    monkeypatch.setattr(op, "CELL", 40)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 6
    rows = [(i, centres[i % 12] + rng.normal(size=16) * 0.3) for i in range(900)]
    # One vector of a third of all rows, of different lengths and with ties; odd rows.
    rows += [(1000 + i, centres[0]) for i in range(450)] + [(3000, None), (None, centres[1]), (3001, np.zeros(16))]
    asked = [(i, centres[i] + rng.normal(size=16) * 0.3) for i in range(12)] + [(50, None), (51, np.zeros(16)), (52, -centres[3])]
    docs, queries = frames(spark, rows, asked)
    index = op.VectorIndex.build(docs)
    assert index.vectors.count() == 1351
    # Equal vectors stand at one distance of one centre: slots split them.
    assert index.cells.agg(F.max("n")).first()[0] < 100
    top, read = op.knn(index, queries, 10)
    same(top, brute(rows, asked, 10))
    pairs, seen = read.first()
    assert pairs == 14 * 1351 and seen < 0.5 * pairs


def test_few_vectors(spark):
    rows, asked = [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(7, [0.5, 0.6]), (8, [-1.0, 0.0])]
    docs, queries = frames(spark, rows, asked)
    same(op.knn(op.VectorIndex.build(docs), queries, 5)[0], brute(rows, asked, 5))
    assert op.knn(op.VectorIndex.build(docs.limit(0)), queries, 5)[0].count() == 0
    assert op.knn(op.VectorIndex.build(docs), queries.limit(0), 5)[0].count() == 0
