"""Raking and sampling."""

import numpy as np
import pandas as pd
import pytest
from common import AWKWARD, docs
from pyspark.sql import functions as F

from gleaner.llm import mixing


def test_marginals_meet_targets():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, v, t, int(rng.integers(500, 900))) for s in "ab" for v in "xyz" for t in "pq"], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"a": 3, "b": 2}, "lang": {"x": 0.3, "y": 0.3, "z": 0.4}, "topic": {"p": 0.55, "q": 0.45}}
    w, said = mixing.rake(cells, targets, 0.3, 0.7)
    assert np.allclose(said["reached"], said["goal"]) and np.allclose(said["goal"], said["wanted"]) and said["sweeps"][0] < 1000
    assert (w <= cells["tokens"]).all() and abs(w.sum() - 0.3 * cells["tokens"].sum()) < 1e-6
    for part, goal in targets.items():
        got = pd.Series(w).groupby(cells[part]).sum() / w.sum()
        assert np.allclose(got.to_numpy(), np.array([goal[k] for k in got.index]) / sum(goal.values()), atol=1e-6)


def test_sample_meets_targets(spark):
    df = docs(spark, [(i, "word " * (20 + i % 40), "big" if i % 10 else "small") for i in range(6000)])
    got = mixing.sample(df, targets={"source": {"big": 0.8, "small": 0.2}}, fraction=0.4).toPandas()
    tokens = got.groupby("source")["n_chars"].sum()
    assert abs(tokens["small"] / tokens.sum() - 0.2) < 0.03
    none = mixing.sample(df, targets={"source": {"big": 1}}, fraction=0.4).toPandas()
    assert set(none["source"]) == {"big"}


def test_targets_above_what_there_is_are_cut():
    present, shares = np.array([10.0, 100.0, 1000.0, 5.0]), np.array([1.0, 1.0, 2.0, 0.0])
    assert np.allclose(mixing.cut(present, shares, 400.0), [10, 100, 290, 0])
    assert np.allclose(mixing.cut(present, shares, 20.0), [5, 5, 10, 0])
    assert np.allclose(mixing.cut(present, shares, 9999.0), [10, 100, 1000, 0])
    assert mixing.cut(np.empty(0), np.empty(0), 0.0).size == 0 and not mixing.cut(present, np.zeros(4), 5.0).any()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_default_targets_are_met(spark, sf):
    """Also where many cells are drawn whole."""
    said = mixing.marginals(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).toPandas()
    assert np.allclose(said["reached"], said["goal"], rtol=1e-6) and (said["goal"] <= said["present"] * (1 + 1e-9)).all()
    for _, one in said.groupby("part"):
        assert abs(one["goal"].sum() / one["present"].sum() - 0.5) < 1e-9


def test_targets_that_exclude_each_other_are_reported(spark):
    df = docs(spark, [(1, "a " * 50, "x"), (2, "b " * 50, "y")]).withColumn("lang", F.when(F.col("source") == "x", "one").otherwise("two"))
    said = {(r.part, r.value): r for r in mixing.marginals(df, targets={"source": {"x": 0.9, "y": 0.1}, "lang": {"one": 0.1, "two": 0.9}}, fraction=0.2).collect()}
    assert abs(said["source", "x"].reached - said["source", "x"].goal) > 1 and said["source", "x"].sweeps < 20_000


def test_rows_without_id_or_text(spark, tmp_path):
    rows = [(None, "word " * 30, "a"), (None, "", "a"), (None, None, None)] + [(i, "", "b") for i in range(2000)] + [(9000 + i, "x " * 20, "b") for i in range(50)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.query(spark, str(tmp_path)).toPandas()
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(str(i) for i in got["doc_id"].fillna(-1).astype(int)) == sorted(str(-1 if r.doc_id is None else r.doc_id) for r in mixing.sample(df).collect())
    empty = got[got["tokens"] == 0]
    assert (empty["probability"] == 0.5).all() and 850 < len(empty) < 1150


def test_awkward(spark):
    df = docs(spark, AWKWARD)
    assert mixing.sample(df, fraction=1.0, temper=1.0).columns == df.columns
    assert mixing.sample(df, fraction=1.0, temper=1.0).count() == len(AWKWARD)
    drawn = [r.doc_id for r in mixing.sample(df, fraction=0.5).collect()]
    assert drawn.count(6) in (0, 2)
    assert mixing.sample(df.limit(0)).count() == 0
