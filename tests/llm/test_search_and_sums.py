"""Top-k search and fingerprints against brute force."""

import random

import numpy as np
import pytest
from common import AWKWARD, docs, records

from gleaner.llm import fingerprint, topk


def brute(vectors, k):
    out = []
    for i, v in vectors.items():
        near = sorted((-round(float(np.dot(v, w)), 9), j) for j, w in vectors.items() if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, round(-s, 6)) for r, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("sparse", [False, True])
def test_topk_is_exact_over_many_shards(spark, sparse):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 6)) * (rng.random((300, 6)) < 0.4 if sparse else 1)
    rows[10:20] = rows[0]  # ties
    vectors = {i: rows[i] for i in range(300)}
    got = topk.topk(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"), 5, shard_rows=16)
    assert sorted((r.query_id, r.rank, r.neighbor_id, r.score + 0.0) for r in got.collect()) == [(a, b, c, pytest.approx(d, abs=2e-6)) for a, b, c, d in brute(vectors, 5)]


def test_topk_of_some_queries(spark):
    rng = np.random.default_rng(7)
    vectors = {i: v for i, v in enumerate(rng.normal(size=(150, 5)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = topk.topk(df, 4, shard_rows=8, asks="id % 20 = 0")
    want = [x for x in brute(vectors, 4) if x[0] % 20 == 0]
    assert sorted((r.query_id, r.rank, r.neighbor_id, r.score + 0.0) for r in got.collect()) == [(a, b, c, pytest.approx(d, abs=2e-6)) for a, b, c, d in want]
    assert topk.topk(df, 4, asks="id < 0").count() == 0


def test_topk_stops_early():
    """With one list that decides, the bound falls at once and few rows are scored."""
    rng = np.random.default_rng(1)
    vectors = np.c_[np.r_[np.full(20, 100.0), rng.random(4000)], rng.random(4020) * 1e-3]
    scored = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                scored.append(len(key))
            return super().__getitem__(key)

    best = np.full((1, 3), -np.inf), np.full((1, 3), -1, np.int64)
    topk.descend(np.array([[1.0, 0.0]]), np.array([-5]), vectors.view(Counting), np.arange(4020), 3, best)
    assert 0 < sum(scored) < 1000


def test_topk_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [1.0, 1.0], 0), (None, [1.0, 1.0], 0), (3, None, 0), (4, [], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0], 0), (9, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = records(topk.topk(df, 10), "query_id", "rank", "neighbor_id", "score")
    assert got == [(1, 1, 2, 1.0), (1, 2, 9, 0.0), (2, 1, 1, 1.0), (2, 2, 9, 0.0), (9, 1, 1, 0.0), (9, 2, 2, 0.0)]
    assert topk.topk(df.limit(0)).count() == 0


def test_fingerprints_ignore_order(spark):
    rng = random.Random(3)
    parts = [f"paragraph {i % 7} of text" for i in range(20)]
    shuffled = rng.sample(parts, 20)
    df = docs(spark, [(1, "\n".join(parts), "a"), (2, "\n\n ".join(shuffled), "a"), (3, "\n".join(parts[1:]), "a"), *[(i and i + 10, t, s) for i, t, s in AWKWARD]])
    made = {}
    for r in fingerprint.fingerprints(df).collect():
        made.setdefault(r.doc_id, []).append(r)
    assert made[1][0].fingerprint == made[2][0].fingerprint != made[3][0].fingerprint
    zeros = "0" * (8 * fingerprint.LANES)
    assert made[11][0].state == made[12][0].state == made[13][0].state == zeros
    assert len(made[16]) == 2 and made[16][0] == made[16][1] and None in made
    groups = records(fingerprint.equal_documents(fingerprint.fingerprints(df)), "doc_ids")
    assert groups == [([1, 2],), ([16, 17],)]
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_fingerprints_insert_and_delete(spark):
    before = fingerprint.fingerprints(docs(spark, [(1, "a\nb\nb", "s"), (2, "c", "s"), (4, "q", "s")]))
    changes = spark.createDataFrame([(1, "z", True), (1, " b", False), (2, "c", False), (3, "new", True), (None, "x", True), (4, "", True), (4, None, True)], "doc_id long, paragraph string, added boolean")
    after = records(fingerprint.update_states(before, changes), "doc_id", "n_paragraphs", "state", "fingerprint")
    want = records(fingerprint.fingerprints(docs(spark, [(1, "b\nz\na", "s"), (2, "", "s"), (3, "new", "s"), (4, "q", "s")])), "doc_id", "n_paragraphs", "state", "fingerprint")
    assert after == want


def test_every_state_is_kept(spark):
    made = fingerprint.fingerprints(docs(spark, [(1, "a", "s"), (1, "b", "t"), (None, "c", "s"), (None, "d", "s"), (5, "e", "s"), (5, "e", "s")]))
    changes = spark.createDataFrame([(1, "z", True), (None, "x", True)] + [(7, "hot", True)] * 300 + [(7, "hot", False)] * 299, "doc_id long, paragraph string, added boolean")
    columns = ("doc_id", "n_paragraphs", "state", "fingerprint")
    got = records(fingerprint.update_states(made, changes.repartition(3)), *columns)
    want = fingerprint.fingerprints(docs(spark, [(1, "a\nz", "s"), (1, "z\nb", "t"), (None, "c", "s"), (None, "d", "s"), (5, "e", "s"), (5, "e", "s"), (7, "hot", "s")]))
    assert got == records(want, *columns)
    assert records(fingerprint.update_states(made, changes.limit(0)), *columns) == records(made, *columns)
    assert fingerprint.update_states(made.limit(0), changes.limit(0)).count() == 0
    assert records(fingerprint.update_states(made.limit(0), changes), "doc_id", "n_paragraphs") == [(1, 1), (7, 1)]
