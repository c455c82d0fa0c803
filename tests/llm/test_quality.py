"""The classifier: held-out accuracy, the solver, awkward rows."""

import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
from common import AWKWARD, docs, records

from gleaner.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy():
    text = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    labels = [x for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["doc_id"] in text]
    rows = [quality.features(text[x["doc_id"]]) for x in labels]
    held = np.array([x["doc_id"] % 5 == 0 for x in labels])
    for head, least in (("quality", 0.95), ("toxic", 0.95)):
        y = np.array([1.0 if (x[head] > 0) == (head == "quality") else -1.0 for x in labels])
        w, b = quality.fit_head([r for r, h in zip(rows, held) if not h], y[~held])
        s = np.array([w[r].sum() + b for r, h in zip(rows, held) if h])
        assert ((s >= 0) == (y[held] > 0)).mean() > least
        assert (s[y[held] > 0] >= 0).mean() > 0.97 and (s[y[held] < 0] < 0).mean() > 0.8


def strings(text):
    """The n-grams themselves."""
    words = re.findall(r"[a-z0-9_]+|[^\sa-z0-9_]+", text.lower())
    pairs = list(zip(words, words[1:]))
    return {*words, *pairs, *([None] if any(a == b for a, b in pairs) else [])}


def brute(texts, y, c=1.0):
    """A scoring function over n-grams that aren't hashed; plain steps on the dual of the hinge loss until it rests."""
    sets = [strings(t) for t in texts]
    names = sorted(set().union(*sets), key=repr)
    x = np.array([[g in s for g in names] for s in sets], float)
    pos, neg = x[y > 0].sum(0), x[y < 0].sum(0)
    ratio = np.log((pos / pos.sum() + 16 / x.sum()) / (neg / neg.sum() + 16 / x.sum()))
    extended = lambda m: (e := np.c_[m * ratio, np.ones(len(m))]) / np.linalg.norm(e, axis=1)[:, None]
    z = extended(x) * y[:, None]
    top, alpha = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum())), np.zeros(len(y))
    gram = z @ z.T
    rate = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + rate * (1 - gram @ alpha), 0, top)
    v = alpha @ z
    return lambda new: np.array([(np.array([g in s for g in names]) * ratio) @ v[:-1] + v[-1] for s in map(strings, new)])


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    good, bad, any_ = [f"good{i}" for i in range(12)], [f"bad{i}" for i in range(12)], [f"word{i}" for i in range(30)]

    def text(own):
        words = [rng.choice(own if rng.random() < 0.3 else any_) for _ in range(rng.randint(4, 25))]
        return " ".join(words + words[-1:] * (own is bad and rng.random() < 0.4))

    rows = [(i, text(good if i % 3 else bad), "s") for i in range(90)] + [(200, "", "s"), (201, None, "s"), (202, "nothing known here", "s"), (None, "bad1 bad1 bad2", "s")]
    labels = [(i, int(rng.random() < 0.95) if i % 3 else 0, int(i % 7 == 0)) for i in range(60)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = dict((i, t) for i, t, _ in rows)
    every = [t or "" for _, t, _ in rows]
    want = []
    for column, sign in ((1, 1), (2, -1)):
        y = np.array([1.0 if (x[column] > 0) == (sign > 0) else -1.0 for x in labels])
        want.append(brute([texts[i] for i, *_ in labels], y)(every))
    model = quality.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.score(docs(spark, rows), model).collect()}
    for (i, _, _), a, b in zip(rows, *want):
        # the scaling by ratios turns a tolerance of 0.01 into more
        assert abs(got[i].quality_score - a) < 0.05 * max(1, abs(a)) and abs(got[i].toxic_score - b) < 0.05 * max(1, abs(b))
        assert got[i].keep == (a >= 0 and b >= 0) or min(abs(a), abs(b)) < 0.1
    kept = quality.query(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i in got if got[i].keep)


def test_dual_solution_is_optimal():
    """The primal objective at the solver's weights, as it ships, is that of the best ones."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 12)).astype(np.uint32) for _ in range(200)]
    y = np.array([1.0 if (r < 12).sum() > 4 else -1.0 for r in rows])
    ratio = quality.log_count_ratio(rows, y)
    x = np.zeros((200, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
        x[i, 30] = 1
        x[i] /= np.sqrt((x[i] ** 2).sum())
    share = np.where(y > 0, 100 / (y > 0).sum(), 100 / (y < 0).sum())
    cost = lambda v: 0.5 * v @ v + (share * np.maximum(0, 1 - y * (x @ v))).sum()
    w, b = quality.fit_head(rows, y)
    v = np.r_[np.divide(w[:30], ratio[:30], out=np.zeros(30), where=ratio[:30] != 0), b].astype(float)
    z, alpha = x * y[:, None], np.zeros(200)
    for _ in range(20_000):
        alpha = np.clip(alpha + (1 - z @ (alpha @ z)) / np.linalg.norm(z, 2) ** 2, 0, share)
    least = alpha.sum() - 0.5 * (alpha @ z) @ (alpha @ z)
    assert least - 1e-6 <= cost(v) <= 1.005 * least


def test_a_few_labels_make_a_model(spark):
    df = docs(spark, [(i, "fine words here" if i < 4 else "awful stuff there", "s") for i in range(8)])
    labels = spark.createDataFrame([(i, int(i < 4), 0) for i in range(7)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in quality.keep_good(df, labels).collect()) == [0, 1, 2, 3]


def test_repeats_have_a_number_of_their_own():
    assert quality.REPEAT in quality.features("so very very bad") and quality.REPEAT not in quality.features("so very bad very")
    ids = quality.features("a b a b c")
    assert len(ids) == len(set(ids)) == 6 and max(ids) < quality.SIZE


def test_awkward(spark):
    df = docs(spark, AWKWARD)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 1), (99, 1, 0), (None, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() <= len(AWKWARD)
    assert quality.keep_good(df, labels.limit(0)).count() == len(AWKWARD)  # no model keeps all
    assert quality.keep_good(df.limit(0), labels).count() == 0


def test_no_matter_how_dealt(spark):
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert records(quality.keep_good(df, labels), "doc_id") == records(quality.keep_good(df.repartition(7), labels.repartition(3)), "doc_id")
